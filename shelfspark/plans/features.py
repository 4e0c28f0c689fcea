"""Feature views: clean -> time parts -> gap -> split -> encode -> scale -> text, as one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfspark.operators import features, interactions

# Columns of the rating view, in order.
RATING_VIEW = (
    "timestamp_year timestamp_month timestamp_day timestamp_hour timestamp_dayofweek timestamp_is_weekend "
    "time_since_last rating"
).split()


def rating_features(ratings: DataFrame) -> DataFrame:
    """(user_id, item_id, timestamp, rating) to the rating view; gap is per user, in seconds."""
    timed = features.time_features(ratings, ["timestamp"], drop_original=False)
    gapped = interactions.interaction_gap(timed, ["user_id"], "timestamp", "item_id")
    return gapped.select("user_id", "item_id", F.col("timestamp").alias("event_timestamp"), *RATING_VIEW)


def user_features(users: DataFrame, classes: dict[str, list]) -> DataFrame:
    """Users with one-hot columns for the given classes of each categorical column."""
    return features.onehot_encode(users, list(classes), classes)


def item_features(
    items: DataFrame, multilabel: str, date_col: str, text_col: str, key: str, max_features: int = 1000, classes: list | None = None
) -> DataFrame:
    """Items with 0/1 columns for the given genres, or all genres as a sparse vector, date parts and a dense TF-IDF array of the title."""
    if classes is None:
        encoded = features.multilabel_sparse(items, key, multilabel, features.fit_index(items, multilabel))
    else:
        encoded = features.multilabel_encode(items, multilabel, classes)
    wide = features.time_features(encoded, [date_col], drop_original=False)
    fitted = features.fit_tfidf(items, key, text_col, max_features)
    width = fitted.count()  # at most max_features
    vectors = features.dense_rows(features.tfidf(items, key, text_col, fitted), key, width)
    return wide.join(vectors.withColumnRenamed("vector", f"{text_col}_tfidf"), key, "left").drop(text_col)


def split_and_scale(df: DataFrame, key: list[str], columns: list[str], logged: list[str], method: str = "standard") -> DataFrame:
    """Hash split, log1p on ``logged``, then scaling fitted on the training rows only."""
    parts = features.log1p_columns(features.split_hash(df, key), logged)
    fitted = features.fit_scaler(parts.filter("split = 'train'"), columns, method)
    return features.apply_scaler(parts, columns, fitted)
