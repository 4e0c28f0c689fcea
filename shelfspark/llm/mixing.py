"""Mixing sources to target weights: tokens per source, repetition rates, whole copies and one seeded Bernoulli copy.

Only DataFrame functions. The texts are read once, for the sizes; all else works
on (id, source, size). Shares are found by reshaping until no source is above its
limit: each round is one aggregate over the table of sources, of which a single
row comes back, so the number of sources is not bounded.

Results for odd input: null text has size 0; a null source is a source of its
own, behind the others; a source without words has target 0; documents without
words are taken with their source's rate like others, with 0 words. Rows without
id draw by their text. Repeated rows draw alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.llm.rows import WORD
from shelfspark.operators.skew import dense_index
from shelfspark.runtime import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix"
_BIG = "decimal(38,0)"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target of a table (source, size)."""
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    named = dense_index(totals, "source", "rank")
    after = totals.filter("source is not null").count()
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = totals.join(named, "source", "left").withColumn("rank", F.coalesce("rank", F.lit(after)))
    sources = cut_lineage(
        ranked.select("source", "source_size", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int")).alias("weight")), "weights"
    )
    limit = most * F.col("source_size")
    words, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    words, weight, full = words or 0, weight or 0, -1
    # shares: left words by left weight; a source whose share is above its limit leaves with the limit
    left_words, left_weight = words, weight
    while left_weight:
        above = F.col("weight").cast(_BIG) * F.lit(left_words).cast(_BIG) >= limit.cast(_BIG) * F.lit(left_weight).cast(_BIG)
        n, taken, gone = sources.filter(above).agg(F.count(F.lit(1)), F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == full:
            break
        full, left_words, left_weight = n, words - taken, weight - gone
    share = F.lit(left_words).cast("double") * F.col("weight") / F.lit(left_weight or 1).cast("double")
    return sources.select("source", "source_size", F.least(limit.cast("double"), share).alias("target"))


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the seed and the id, the same in every run."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(text)))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), named)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, raw_sha256, size, source_size, target, copies, taken for each row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc_id = F.col(f"`{id_col}`")
    sized = cut_lineage(
        docs.select(
            doc_id.alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), draw(seed, doc_id, text).alias("draw"),
            F.sha2(text, 256).alias("raw_sha256"),
        ),
        "sizes",
    )
    targets = source_targets(sized, weights, most)
    return with_copies(sized, targets)


def with_copies(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row with its source's target: whole copies by the rate, one more where the draw is below the fraction."""
    both = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.when(F.col("draw") < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return both.withColumn("copies", copies).select(
        "doc_id", "raw_sha256", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
