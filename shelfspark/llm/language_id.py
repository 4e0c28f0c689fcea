"""Language of documents: Bayesian fusion of text, declared language, address suffix and host.

* Text: byte trigrams, scored against one distribution for each language and a
  flat one for "no language". Their average counts as at most ``TRIALS``
  independent observations, since neighbouring trigrams are not independent.
* Declared language: as reliable as it agrees with the text over all rows.
* Address suffix: country codes with one main language.
* Host: shares of the languages found in the texts of a host, smoothed towards
  those of its domain, these towards those of all rows; counted by grouped
  aggregation over all rows.

Every declared language with ``LEAST_ROWS`` texts in the whole table is a class. The
distributions are fitted on at most ``SAMPLE`` rows, shared out evenly among them, but up to
``LEAST_SHARE`` rows of each (the smallest hashes) and about ``SHARE_BYTES`` of text; all other
numbers come from all rows.

Results for odd input: a null text counts as empty; a text without trigrams has
no text evidence, takes its language from the other evidence, and is not
accepted. Null or unknown declared languages, hosts and addresses give no
evidence. Repeated rows get equal results. Without any declared language nothing
can be fitted: then ``language`` is null and texts that are not empty are
accepted. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfspark.llm.rows import bounded_batches, join_hot
from shelfspark.runtime import cut_lineage

SAMPLE = 4000
LEAST_ROWS = 5
LEAST_SHARE = 50
SHARE_BYTES = 8 << 20
BUCKETS = 1 << 16
TRIALS = 100
NO_LANGUAGE = "und"
NO_LANGUAGE_PRIOR = 0.01
SMOOTHING = 20.0
_PIECE = 1 << 21
#: Texts that a task holds as Python strings.
TOGETHER = 256

#: Country codes with one main language.
SUFFIX_LANGUAGE = {
    "ar": "es", "at": "de", "au": "en", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr",
    "ie": "en", "mx": "es", "nz": "en", "pe": "es", "uk": "en", "us": "en",
}
SUFFIX_TRUST = 0.8


def host_of(address: Column) -> Column:
    """Lower-case host of an address, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def trigrams(data: np.ndarray) -> np.ndarray:
    """A bucket for each three neighbouring bytes."""
    wide = data.astype(np.uint32)
    return ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def prepared(text: str) -> bytes:
    return b" " + " ".join(text.lower().split()).encode() + b" " if text else b""


def fit(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """Languages, and for each bucket the log probability under each of them and under no language."""
    counts: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for language, text in rows:
        data = np.frombuffer(prepared(text), np.uint8)
        if len(data) > 2:
            counts.setdefault(language, np.zeros(BUCKETS))
            counts[language] += np.bincount(trigrams(data), minlength=BUCKETS)
            seen[language] = seen.get(language, 0) + 1
    languages = sorted(c for c, n in seen.items() if n >= min(LEAST_ROWS, max(seen.values())))
    tables = [np.log((counts[c] + 0.05) / (counts[c].sum() + 0.05 * BUCKETS)) for c in languages]
    return languages, np.array([*tables, np.full(BUCKETS, -np.log(BUCKETS))], np.float32)


def score(texts: list[str], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log probability of each text under each table, and its number of trigrams."""
    totals, sizes = np.zeros((len(texts), len(tables))), np.zeros(len(texts), np.int64)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        starts = np.cumsum([0, *(len(p) for _, p in held)])
        buckets = trigrams(np.frombuffer(b"".join(p for _, p in held), np.uint8))
        # from each start to the last full trigram of the piece; what spans two pieces falls into the odd places
        edges = np.minimum(np.column_stack([starts[:-1], starts[1:] - 2]).ravel(), len(buckets) - 1)
        owners = [i for i, _ in held]
        for k, table in enumerate(tables):
            values = np.append(table[buckets], np.float32(0))
            edges[-1] = len(buckets)
            np.add.at(totals[:, k], owners, np.add.reduceat(values, edges, dtype=np.float64)[::2])

    for i, text in enumerate(texts):
        data = prepared(text)
        sizes[i] = max(0, len(data) - 2)
        for at in range(0, len(data) - 2, _PIECE):
            held.append((i, data[at : at + _PIECE + 2]))
            size += len(held[-1][1])
        if size >= _PIECE:
            flush()
            held, size = [], 0
    if held:
        flush()
    return totals / np.maximum(sizes, 1)[:, None], sizes


def _sample(rows: DataFrame, most: int) -> list[tuple[str, str]]:
    named = rows.filter(F.col("declared").isNotNull() & F.col("text").rlike(r"\S"))
    counts = named.groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
    languages = [r["declared"] for r in counts.filter(F.col("n") >= LEAST_ROWS).select("declared").collect()]
    if not languages:  # a few rows of each
        languages = [r["declared"] for r in counts.orderBy(F.desc("n"), "declared").limit(most).collect()]
    if not languages:
        return []
    each = max(LEAST_SHARE, most // len(languages))
    hashed = named.filter(F.col("declared").isin(languages)).withColumn("o", F.xxhash64("id", "text", F.lit("language")))
    order = W.partitionBy("declared").orderBy("o")
    first = hashed.select("declared", "o", F.octet_length("text").cast("long").alias("size")).withColumn("place", F.row_number().over(order))
    first = first.filter(F.col("place") <= each)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).filter((F.col("place") <= LEAST_ROWS) | (F.col("before") < SHARE_BYTES))
    # at most ``each`` rows of a language; equal rows are read once
    picked = first.groupBy("declared", "o").agg(F.count(F.lit(1)).alias("times"))
    found = hashed.select("declared", "o", F.left("text", F.lit(SHARE_BYTES // LEAST_ROWS)).alias("text")).join(F.broadcast(picked), ["declared", "o"])
    found = found.dropDuplicates(["declared", "o"]).orderBy("declared", "o")
    return [(r["declared"], r["text"]) for r in found.toLocalIterator() for _ in range(r["times"])]


def _logs(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str | None = None, host: str | None = None,
    address: str | None = None, sample: int = SAMPLE,
) -> DataFrame:
    """doc_id, raw_sha256, declared, host, text_language, language, probability, accepted."""
    bounded_batches(docs.sparkSession)
    none = F.lit(None).cast("string")
    where = host_of(F.col(f"`{address}`")) if address else F.col(f"`{host}`").cast("string") if host else none
    says = F.nullif(F.lower(F.trim(F.regexp_extract(F.col(f"`{declared}`").cast("string"), r"^\s*([A-Za-z]+)", 1))), F.lit("")) if declared else none
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), says.alias("declared"),
        where.alias("host"),
    )
    languages, tables = fit(_sample(rows, sample))
    if not languages:
        return rows.select(
            F.col("id").alias("doc_id"), F.sha2("text", 256).alias("raw_sha256"), "declared", "host", none.alias("text_language"),
            none.alias("language"), F.lit(None).cast("double").alias("probability"), (F.trim("text") != "").alias("accepted"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TOGETHER) for whole in batches for at in range(0, whole.num_rows, TOGETHER)):
            texts = batch.column(1).to_pylist()
            means, sizes = score(texts, tables)
            digests = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            scores = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(tables), means.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), digests, batch.column(2), batch.column(3), scores, pa.array(sizes)],
                names=["id", "raw", "declared", "host", "means", "trigrams"],
            )

    scored = rows.mapInArrow(run, "id long, raw binary, declared string, host string, means array<double>, trigrams long")
    names = F.array(*[F.lit(c) for c in [*languages, NO_LANGUAGE]])
    top = F.when(F.col("trigrams") > 0, F.get(names, (F.array_position("means", F.array_max("means")) - 1).cast("int")))
    scored = cut_lineage(scored.withColumn("text_language", top), "language-scores")

    # how often each language is found on a host, in its domain, and in all rows
    found = [F.sum(F.when(F.col("text_language") == c, 1).otherwise(0)).cast("double").alias(f"n{i}") for i, c in enumerate(languages)]
    agreed = F.sum(F.when(F.col("text_language") == F.col("declared"), 1).otherwise(0))
    known = F.col("declared").isin(languages) & F.col("text_language").isin(languages)
    totals = scored.agg(*found, agreed.alias("agreed"), F.sum(F.when(known, 1).otherwise(0)).alias("compared")).first()
    everywhere = np.array([totals[f"n{i}"] or 0 for i in range(len(languages))]) + 1
    shares = everywhere / everywhere.sum()
    trust = ((totals["agreed"] or 0) + 9) / ((totals["compared"] or 0) + 10)
    counted = [f"n{i}" for i in range(len(languages))]
    hosts = scored.filter("host is not null").groupBy("host").agg(*found).withColumn("domain", domain_of(F.col("host")))
    domains = hosts.groupBy("domain").agg(*[F.sum(c).alias("d" + c) for c in counted])

    def smoothed(counts: list[str], towards: list[Column]) -> list[Column]:
        size = sum((F.col(c) for c in counts), F.lit(0.0)) + SMOOTHING
        return [(F.col(c) + SMOOTHING * p) / size for c, p in zip(counts, towards, strict=True)]

    by_domain = smoothed(["d" + c for c in counted], [F.lit(float(s)) for s in shares])
    priors = hosts.join(domains, "domain").select("host", F.array(*[F.log(p) for p in smoothed(counted, by_domain)]).alias("prior"))

    prior = F.coalesce("prior", _logs(np.log(shares)))
    prior = F.concat(F.transform(prior, lambda p: p + float(np.log(1 - NO_LANGUAGE_PRIOR))), _logs([np.log(NO_LANGUAGE_PRIOR)]))
    wide = len(languages) + 1
    wrong = float(np.log((1 - trust) / max(1, len(languages) - 1))) if trust < 1 else -20.0
    suffix = F.substring_index("host", ".", -1)
    country = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    suffix_says = F.when(F.instr(F.coalesce("host", F.lit("")), ".") > 0, F.element_at(country, suffix)) if address else none
    flat = float(np.log(1 / wide))

    def evidence(said: Column, right: float, otherwise: float) -> Column:
        told = F.transform(names, lambda c: F.when(c == NO_LANGUAGE, F.lit(flat)).when(c == said, F.lit(right)).otherwise(F.lit(otherwise)))
        return F.when(said.isin(languages), told).otherwise(_logs([0.0] * wide))

    by_declared = evidence(F.col("declared"), float(np.log(trust)), wrong)
    by_suffix = evidence(suffix_says, float(np.log(SUFFIX_TRUST)), float(np.log((1 - SUFFIX_TRUST) / max(1, len(languages) - 1))))
    weight = F.least(F.col("trigrams"), F.lit(TRIALS)).cast("double")
    by_text = F.transform("means", lambda m: m * weight)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = join_hot(scored, priors, "host").withColumn("logs", plus(plus(by_text, prior), plus(by_declared, by_suffix)))
    best = F.array_max("logs")
    total = F.aggregate(F.transform("logs", lambda x: F.exp(x - best)), F.lit(0.0), lambda t, x: t + x)
    language = F.get(names, (F.array_position("logs", best) - 1).cast("int"))
    return fused.select(
        F.col("id").alias("doc_id"), F.lower(F.hex("raw")).alias("raw_sha256"), "declared", "host", "text_language", language.alias("language"),
        (1 / total).alias("probability"), ((language != NO_LANGUAGE) & (F.col("trigrams") > 0)).alias("accepted"),
    )
