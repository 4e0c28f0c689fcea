"""Readers: delimited, line JSON, JSON documents, HTML tables, JDBC, feature parquet."""

from __future__ import annotations

from html.parser import HTMLParser
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark import schemas

DELIMITED = {".csv", ".data", ".item", ".user", ".base", ".test"}
CORRUPT = "_corrupt_record"


def read_delimited(
    spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False, encoding: str = "UTF-8"
) -> DataFrame:
    """Delimited text with an explicit schema; the extension decides whether it is allowed."""
    ext = PurePosixPath(path).suffix.lower()
    if ext not in DELIMITED:
        raise ValueError(f"no reader for extension '{ext}'")
    return (
        spark.read.schema(schema).option("sep", sep).option("header", header).option("encoding", encoding)
        .option("ignoreLeadingWhiteSpace", False).option("mode", "FAILFAST").csv(path)
    )


def read_ratings_bundle(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The three rating files: tab-separated ratings, pipe-separated latin-1 items, pipe-separated users."""
    return {
        "ratings": read_delimited(spark, f"{base}/u.data", schemas.RATINGS, "\t"),
        "movies": read_delimited(spark, f"{base}/u.item", schemas.MOVIES, "|", encoding="ISO-8859-1"),
        "users": read_delimited(spark, f"{base}/u.user", schemas.USERS, "|"),
    }


def read_ndjson(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Line JSON, blank lines skipped. ``strict`` fails on a broken line; else it lands in a column."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kept = f"{schema}, {CORRUPT} string"
    return spark.read.schema(kept).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """``{mal_id, data}`` lines unwrapped to one row per payload."""
    return read_ndjson(spark, path, schemas.CRAWL_LINE).select("mal_id", "data.*")


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file holding one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_document_store(spark: SparkSession, path: str, schema: str, required: str = "email") -> DataFrame:
    """A file ``{"_default": {id: doc}}`` as rows; documents without ``required`` are dropped."""
    whole = spark.read.text(path, wholetext=True)
    docs = F.map_values(F.from_json("value", f"struct<_default:map<string,struct<{schema}>>>")["_default"])
    rows = whole.select(F.explode(docs).alias("d")).select("d.*")
    return rows.filter(F.col(required).isNotNull() & (F.col(required) != ""))


def read_jdbc(
    spark: SparkSession, url: str, query: str, column: str, low: int, high: int, partitions: int, fetch: int = 10_000
) -> DataFrame:
    """Partitioned JDBC scan; each partition reads its own key range with a bounded fetch size."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
        .option("partitionColumn", column).option("lowerBound", low).option("upperBound", high)
        .option("numPartitions", partitions).option("fetchsize", fetch).load()
    )


def read_features(df: DataFrame, ts_col: str) -> DataFrame:
    """A feature frame with its time column cast and renamed to ``event_timestamp``."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp_ntz")).withColumnRenamed(ts_col, "event_timestamp")


class _FirstTable(HTMLParser):
    """Cells of the first table of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.depth = 0
        self.done = False
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if self.done:
            return
        if tag in ("td", "th") and self.depth == 1 and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.cell is not None and not self.done:
            self.cell.append(data)


def first_table(html: str | None) -> list[list[str]]:
    parser = _FirstTable()
    parser.feed(html or "")
    return [r for r in parser.rows if r]


def html_table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, row_no, cells): rows of the first table of every page."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = [
                (i, n, cells)
                for i, html in zip(pdf[id_col], pdf[html_col])
                for n, cells in enumerate(first_table(html))
            ]
            yield pd.DataFrame(out, columns=[id_col, "row_no", "cells"])

    has_table = F.lower(html_col).contains("<table")
    return pages.filter(has_table).select(id_col, html_col).mapInPandas(
        parse, f"{id_col} bigint, row_no int, cells array<string>"
    )
