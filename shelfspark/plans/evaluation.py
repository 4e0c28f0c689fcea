"""Time-split evaluation of a recommender."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfspark.operators import interactions, metrics, recommend
from shelfspark.runtime import cut_lineage


def split_sides(log: DataFrame, min_user: int = 5, min_item: int = 5, test_frac: float = 0.2) -> tuple[DataFrame, DataFrame]:
    kept = cut_lineage(interactions.min_count_filter(log, min_user, min_item), "kept")
    split = cut_lineage(interactions.time_split(kept, test_frac), "split")
    return split.filter("split = 'train'"), split.filter("split = 'test'")


def popularity_baseline(log: DataFrame, k: int = 10, min_user: int = 5, min_item: int = 5) -> DataFrame:
    """Per user: P/R/NDCG@5 and @10, MRR and MAP@10 of the most popular unseen items."""
    train, test = split_sides(log, min_user, min_item)
    pop = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))
    order = recommend.popularity_order(pop)
    users = test.select("user_id").distinct()
    recs = recommend.popular_unseen(users, train, order, k)
    ranked = recs.select(F.col("user_id").alias("query"), "rank", F.col("item_id").alias("item"))
    relevant = test.select(F.col("user_id").alias("query"), F.col("item_id").alias("item"))
    return metrics.ranked_list_metrics(users.select(F.col("user_id").alias("query")), ranked, relevant, (5, k))


def averaged(per_query: DataFrame, digits: int = 4) -> DataFrame:
    cols = [c for c in per_query.columns if c != "query"]
    return per_query.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in cols])
