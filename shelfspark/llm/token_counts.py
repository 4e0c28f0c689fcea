"""Token counts behind a cache of digests.

The content of a document is normalised (runs of white space become one space,
none at the ends, which no count of this tokenizer depends on) and digested. The
cache is a Parquet table of (tokenizer digest, content digest, n_tokens) in the
shared folder. Digests without an entry are encoded, each distinct content once,
and appended; then all documents join their counts. A version of the tokenizer
is the digest of its file, so another file never meets old counts.

Inside a task, contents are cut at white space, where this kind of tokenizer
always has a border, and each distinct chunk is encoded by the library once
while it is remembered.

Results for odd input: a null text counts as empty (0 bytes, 0 tokens). Repeated
rows each get a row. An empty table gives no rows, and writes nothing. Two jobs
that append the same digest at once leave two equal entries; reading the cache
takes one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.llm.byte_bpe import Memo
from shelfspark.llm.rows import join_hot, text_bytes, texts
from shelfspark.runtime import cut_lineage, scratch_path

LIMIT = 2048
REMEMBERED = 300_000
_CACHE = "tokenizer string, digest binary, n_tokens long"
_loaded: dict[str, ChunkCounter] = {}


class ChunkCounter:
    """Counts of texts as sums over their chunks between white space.

    Right for tokenizers that drop white space and never join what it separates.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = Memo(remembered)

    def counts(self, contents: list[bytes]) -> list[int]:
        split = [c.split() for c in contents]
        young = self.memo.young
        found = [list(map(young.get, chunks)) for chunks in split]
        new = {c for chunks, counts in zip(split, found, strict=True) if None in counts for c, n in zip(chunks, counts, strict=True) if n is None}
        known = {c: n for c in new if (n := self.memo.old.get(c)) is not None}
        missing = [c for c in new if c not in known]
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            coded = self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)
            known.update((c, len(e)) for c, e in zip(part, coded, strict=True))
        for c, n in known.items():
            self.memo.put(c, n)
        return [
            sum(counts) if None not in counts else sum(known[c] if n is None else n for c, n in zip(chunks, counts, strict=True))
            for chunks, counts in zip(split, found, strict=True)
        ]


def counter(path: str) -> ChunkCounter:
    if path not in _loaded:
        _loaded[path] = ChunkCounter(path)
    return _loaded[path]


def content(text: bytes) -> bytes:
    return b" ".join(text.split())


def file_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer; empty where nothing has been written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    kept = spark.read.schema(_CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = text_bytes(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([hashlib.sha256(content(t)).digest() for t in raw], pa.binary())],
            names=["doc_id", "n_bytes", "digest"],
        )


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents by digest, once for each batch."""
    for batch in batches:
        distinct = {hashlib.sha256(c).digest(): c for c in map(content, text_bytes(batch.column(0)))}
        yield pa.RecordBatch.from_arrays([pa.array(distinct.keys(), pa.binary()), pa.array(distinct.values(), pa.binary())], names=["digest", "content"])


def token_counts(
    docs: DataFrame, path: str, cache: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; adds what was not yet known to the table at ``cache``."""
    spark, version = docs.sparkSession, file_digest(path)
    rows = texts(docs, id_col, text_col)
    keyed = cut_lineage(rows.mapInArrow(_digests, "doc_id long, n_bytes long, digest binary"), "digests")
    known = read_cache(spark, cache, version)
    missing = cut_lineage(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "missing")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).counts
        for batch in batches:
            contents = batch.column(1).to_pylist()
            counts = [n for at in range(0, len(contents), 256) for n in count(contents[at : at + 256])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.string()), batch.column(0), pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"]
            )

    if not missing.isEmpty():
        unknown = rows.select("text").mapInArrow(_contents, "digest binary, content binary").join(missing, "digest", "left_semi")
        once = unknown.dropDuplicates(["digest"])
        once.mapInArrow(encode, _CACHE).write.mode("append").parquet(cache)
        known = read_cache(spark, cache, version)
    counted = join_hot(keyed, known, "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark: SparkSession) -> str:
    """A path in the shared folder for a cache of one run."""
    return scratch_path(spark, "token-counts")
