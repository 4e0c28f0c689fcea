"""Feature engineering: cleaning, time parts, encodings, scaling, TF-IDF, as-of joins, online tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfspark.functions.values import unit
from shelfspark.operators import skew
from shelfspark.runtime import cut_lineage

TOKEN = "[\\p{L}\\p{N}_]{2,}"


# --- cleaning -----------------------------------------------------------------


def clean_frame(df: DataFrame, datetime_cols: list[str] | None = None, max_null_rate: float = 0.8) -> DataFrame:
    """Drop mostly-null columns (measured first), all-null rows and duplicates; parse date columns.

    A date column with an unparseable value stays as it is.
    """
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    kept = [c for c in df.columns if rates[c] is None or rates[c] <= max_null_rate]
    out = df.select(*kept).dropna("all").dropDuplicates()
    dates = [c for c in datetime_cols or [] if c in kept]
    if not dates:
        return out
    bad = out.agg(
        *[
            F.sum((F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull()).cast("long")).alias(c)
            for c in dates
        ]
    ).first()
    for c in dates:
        if not bad[c]:
            out = out.withColumn(c, F.try_to_timestamp(F.col(c)))
    return out


def time_features(df: DataFrame, cols: list[str], drop_original: bool = True) -> DataFrame:
    """Year, month, day, hour, weekday (Monday 0) and weekend flag per time column."""
    for c in cols:
        t = F.col(c)
        df = df.withColumns(
            {
                f"{c}_year": F.year(t),
                f"{c}_month": F.month(t),
                f"{c}_day": F.dayofmonth(t),
                f"{c}_hour": F.hour(t),
                f"{c}_dayofweek": F.weekday(t),
                f"{c}_is_weekend": (F.weekday(t) >= 5).cast("int"),
            }
        )
    return df.drop(*cols) if drop_original else df


# --- splits -------------------------------------------------------------------


def split_hash(df: DataFrame, key: list[str], test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` from a seeded hash of the key: no shuffle, the same under any partitioning; size is approximate."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(10_000))
    return df.withColumn("split", F.when(bucket < int(test_frac * 10_000), "test").otherwise("train"))


def split_exact(df: DataFrame, key: list[str], test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` with exactly ceil(n * frac) test rows: the smallest seeded hashes.

    The cut is found by counting hash buckets and ranking only the bucket that
    holds it; the table itself is never sorted.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_b", F.shiftright("_h", 48))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    order = W.orderBy("_b")  # 65,536 bucket rows at most
    running = sizes.withColumn("upto", F.sum("n").over(order)).withColumn("before", F.col("upto") - F.col("n"))
    need = F.ceil(F.sum("n").over(W.partitionBy()) * F.lit(test_frac))
    cut = running.withColumn("need", need).filter("before < need and upto >= need").select(
        F.struct(F.col("_b").alias("cb"), (F.col("need") - F.col("before")).alias("take"))
    )
    # exactly one row, read as a scalar subquery
    tagged = hashed.withColumn("_c", cut.scalar()).withColumns({"cb": F.col("_c.cb"), "take": F.col("_c.take")}).drop("_c")
    edge = tagged.filter("_b = cb").select(*key, "_h", "take")
    chosen = (
        edge.withColumn("_r", F.row_number().over(W.orderBy("_h", *key))).filter("_r <= take").select(*key).withColumn("_in", F.lit(True))
    )
    is_test = (F.col("_b") < F.col("cb")) | ((F.col("_b") == F.col("cb")) & F.coalesce("_in", F.lit(False)))
    return (
        tagged.join(chosen, key, "left")
        .withColumn("split", F.when(is_test, "test").otherwise("train"))
        .select(*df.columns, "split")
    )


# --- encodings ----------------------------------------------------------------


#: A wide encoding has a column for each class, at most so many.
MOST_COLUMNS = 1000


def categories(df: DataFrame, col: str, most: int = MOST_COLUMNS) -> list:
    """Sorted distinct values for a wide encoding; more than ``most`` are an error, as the sparse encodings have no width."""
    found = df.select(F.col(col).alias("v")).filter("v is not null").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} classes: use onehot_sparse or multilabel_sparse")
    return sorted(r["v"] for r in found)


def fit_index(train: DataFrame, col: str) -> DataFrame:
    """(col, idx): sorted distinct values of a column, or of the elements of an array column, numbered from 0; a table of any size."""
    values = F.explode(col) if dict(train.dtypes)[col].startswith("array") else F.col(col)
    return cut_lineage(skew.dense_index(train.select(values.alias(col)), col), "index")


def _sparse(index: DataFrame, places: Column, out: str) -> Column:
    """A sparse vector as Spark ML stores it: size, ascending indices, values."""
    size = index.agg(F.count(F.lit(1)).cast("int")).scalar()
    return F.struct(size.alias("size"), places.alias("indices"), F.transform(places, lambda _: F.lit(1.0)).alias("values")).alias(out)


def onehot_sparse(df: DataFrame, col: str, index: DataFrame) -> DataFrame:
    """The column as a sparse 0/1 vector by its index; a null or unknown value gives an empty one."""
    found = df.join(index.withColumnRenamed("idx", "_idx"), col, "left")
    places = F.when(F.col("_idx").isNull(), F.array().cast("array<int>")).otherwise(F.array(F.col("_idx").cast("int")))
    return found.select(*[_sparse(index, places, c) if c == col else F.col(c) for c in df.columns])


def multilabel_sparse(df: DataFrame, key: str, col: str, index: DataFrame) -> DataFrame:
    """The array column as a sparse 0/1 vector by its index; ``key`` is unique. Unknown classes are left out."""
    each = df.select(key, F.explode(F.array_distinct(col)).alias(col)).join(index, col)
    # a list holds one number for each element of the row's array
    lists = each.groupBy(key).agg(F.array_sort(F.collect_list(F.col("idx").cast("int"))).alias("_places"))
    found = df.join(lists, key, "left")
    places = F.coalesce("_places", F.array().cast("array<int>"))
    return found.select(*[_sparse(index, places, c) if c == col else F.col(c) for c in df.columns])


def fit_labels(train: DataFrame, col: str) -> DataFrame:
    """(col, idx): sorted distinct text values numbered from 0; null reads as 'nan'."""
    as_text = train.select(F.coalesce(F.col(col).cast("string"), F.lit("nan")).alias(col))
    return skew.dense_index(as_text, col)


def label_encode(df: DataFrame, col: str, labels: DataFrame) -> DataFrame:
    """Column replaced by its label index; an unseen label raises when the row is read."""
    keyed = df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit("nan")))
    joined = keyed.join(labels.withColumnRenamed("idx", "_idx"), col, "left")
    unseen = F.raise_error(F.concat(F.lit(f"unseen label in {col}: "), F.col(col))).cast("long")
    return joined.withColumn(col, F.coalesce("_idx", unseen)).drop("_idx")


def onehot_encode(df: DataFrame, cols: list[str], fitted: dict[str, list]) -> DataFrame:
    """``col_value`` columns of 0.0/1.0; unknown values give all zeros."""
    new = {
        f"{c}_{v}": F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0) for c in cols for v in fitted[c]
    }
    return df.withColumns(new).drop(*cols)


def onehot_long(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, feature, value) without a width limit."""
    pairs = F.array(*[F.concat(F.lit(f"{c}_"), F.col(c).cast("string")) for c in cols])
    return df.select(key, F.explode(pairs).alias("feature")).filter("feature is not null").withColumn("value", F.lit(1.0))


def multilabel_encode(df: DataFrame, col: str, classes: list) -> DataFrame:
    """``col_class`` 0/1 columns for an array column, named by :func:`class_columns`."""
    names = class_columns(col, classes)
    return df.withColumns({names[v]: F.array_contains(col, v).cast("int") for v in classes}).drop(col)


def class_columns(col: str, classes: list) -> dict:
    """Class -> column name. Names differing only in case, which Spark would mix up, get a number."""
    names, used = {}, {}
    for v in classes:
        name = f"{col}_{v}"
        n = used[name.lower()] = used.get(name.lower(), 0) + 1
        names[v] = name if n == 1 else f"{name}~{n}"
    return names


def array_classes(df: DataFrame, col: str, most: int = MOST_COLUMNS) -> list:
    return categories(df.select(F.explode(col).alias(col)), col, most)


# --- scaling ------------------------------------------------------------------


def fit_scaler(train: DataFrame, cols: list[str], method: str = "standard") -> DataFrame:
    """One row of (shift, scale) per column. Constant columns scale by 1."""
    if method == "standard":
        stats = [(F.avg(c), F.stddev_pop(c)) for c in cols]
    elif method == "minmax":
        stats = [(F.min(c), F.max(c) - F.min(c)) for c in cols]
    else:
        raise ValueError("method is 'standard' or 'minmax'")
    out = []
    for c, (shift, scale) in zip(cols, stats):
        out += [shift.cast("double").alias(f"{c}__shift"), scale.cast("double").alias(f"{c}__scale")]
    return train.agg(*out)


def apply_scaler(df: DataFrame, cols: list[str], fitted: DataFrame) -> DataFrame:
    # an aggregate without keys: exactly one row, read as a scalar subquery
    joined = df.withColumn("_s", fitted.select(F.struct(*fitted.columns)).scalar())
    scaled = {}
    for c in cols:
        scale = F.col(f"_s.{c}__scale")
        scaled[c] = (F.col(c) - F.col(f"_s.{c}__shift")) / F.when(scale == 0, 1.0).otherwise(scale)
    return joined.withColumns(scaled).drop("_s")


def log1p_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """log(1 + x) on the given columns, or on every numeric one."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    return df.withColumns({c: F.log1p(c) for c in (cols or numeric) if c in df.columns})


# --- text ---------------------------------------------------------------------


def tokens(c: Column) -> Column:
    """Lower-case words of two or more word characters (Unicode)."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def term_counts(docs: DataFrame, key: str, col: str) -> DataFrame:
    return (
        docs.select(key, F.explode(tokens(F.col(col))).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def fit_tfidf(train: DataFrame, key: str, col: str, max_features: int = 1000) -> DataFrame:
    """(term, idx, idf): the most frequent terms in total, ties by term; idf = ln((1+n)/(1+df)) + 1."""
    counts = term_counts(train, key, col)
    top = (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
        .orderBy(F.desc("total"), F.asc("term"))
        .limit(max_features)
    )
    n = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0
    return top.withColumn("n", n).select(
        "term", (F.row_number().over(W.orderBy("term")) - 1).cast("long").alias("idx"), idf.alias("idf")
    )


def tfidf(docs: DataFrame, key: str, col: str, fitted: DataFrame) -> DataFrame:
    """(key, idx, term, weight): L2-normalised sparse rows; documents without a known term have none."""
    known = docs.select(key, F.explode(tokens(F.col(col))).alias("term")).join(
        F.broadcast(fitted), "term"  # at most max_features rows
    )
    counts = known.groupBy(key, "idx", "term").agg((F.count(F.lit(1)) * F.first("idf")).alias("raw"))
    # a document has at most max_features rows left
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return counts.select(key, "idx", "term", (F.col("raw") / norm).alias("weight"))


def dense_rows(weights: DataFrame, key: str, width: int) -> DataFrame:
    """Sparse (key, idx, weight) rows to one array of ``width`` per key (width is the vocabulary size)."""
    packed = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m"))
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("long")), F.lit(0.0))
    )
    return packed.select(key, vector.alias("vector"))


def hashed_vectors(df: DataFrame, col: str, out: str = "vector", dim: int = 64) -> DataFrame:
    """Offline default encoder: signed hashed word counts, L2-normalised, all in the JVM."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(TOKEN), F.lit(0))
    signs = {"_plus": 1, "_minus": 0}

    def signed(bit: int) -> Column:
        return F.filter("_words", lambda w: F.shiftright(F.crc32(w), 16).bitwiseAND(1) == bit)

    rows = df.withColumn("_words", words).withColumns({name: signed(bit) for name, bit in signs.items()})
    for name in signs:
        rows = HashingTF(numFeatures=dim, inputCol=name, outputCol=name + "_tf").transform(rows)
    counts = F.zip_with(vector_to_array("_plus_tf"), vector_to_array("_minus_tf"), lambda x, y: x - y)
    return rows.withColumn("_counts", counts).withColumn(out, unit(F.col("_counts"))).select(*df.columns, out)


def text_embed(df: DataFrame, col: str, out: str = "vector", encoder: Callable | None = None) -> DataFrame:
    """Unit vectors for a text column. ``encoder``: iterator of Series -> iterator of Series, in Arrow batches; any model."""
    if encoder is None:
        return hashed_vectors(df, col, out)
    import pandas as pd

    def embed(texts):
        yield from encoder(texts)

    embed.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(embed, "array<double>")(F.col(col)))


# --- item vectors ---------------------------------------------------------------


def item_features(cat: DataFrame, tags: str = "tags") -> DataFrame:
    """(mal_id, dim, weight): genre 1.0, tag weight / 100, the larger one when both name a dim."""
    genres = cat.select("mal_id", F.explode("genres").alias("dim"), F.lit(1.0).alias("weight"))
    tag = cat.select("mal_id", F.explode(tags).alias("t")).select(
        "mal_id", F.col("t.name").alias("dim"), (F.coalesce("t.weight", F.lit(0)) / 100).alias("weight")
    )
    return (
        genres.unionByName(tag.filter("dim is not null and dim <> ''"))
        .groupBy("mal_id", "dim")
        .agg(F.max("weight").alias("weight"))
    )


def feature_vocab(cat: DataFrame, tags: str = "tags") -> DataFrame:
    """(dim, idx): sorted union of genres and tag names."""
    return skew.dense_index(item_features(cat, tags), "dim")


def genre_vectors(cat: DataFrame) -> DataFrame:
    """(mal_id, dim, weight): binary genre rows, L2-normalised."""
    g = F.array_distinct("genres")
    return cat.select("mal_id", (F.lit(1.0) / F.sqrt(F.size(g))).alias("weight"), F.explode(g).alias("dim"))


# --- point in time ----------------------------------------------------------------


def asof_join(
    entities: DataFrame,
    features: DataFrame,
    keys: list[str],
    ts: str = "event_timestamp",
    ttl_seconds: float | None = None,
    max_rows: int = skew.MAX_ROWS_PER_KEY,
    tie: list[str] | None = None,
) -> DataFrame:
    """Latest feature row at or before each entity row's time, per key.

    Both sides are stacked and scanned once in time order, so the cost is one
    shuffle and no range join. At equal times the feature row comes first. Of
    feature rows of one key and time the one with the largest ``tie`` columns
    counts, by default that with the largest hash: the same in every plan.
    """
    cols = [c for c in features.columns if c not in (*keys, ts)]
    body = F.struct(F.col(ts).alias("_fts"), *cols)
    carried = [c for c in entities.columns if c not in (*keys, ts)]
    left = entities.select(*keys, ts, F.struct(F.lit(True).alias("_e"), *carried).alias("_row"))
    left = left.withColumn("_feat", F.lit(None).cast(features.select(body.alias("b")).schema["b"].dataType))
    right = features.select(*keys, ts, F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), body.alias("_feat"))
    stacked = left.unionByName(right).withColumn("_kind", F.col("_feat").isNull().cast("int"))
    order = [F.asc(ts), F.asc("_kind"), *[F.asc(f"_feat.{c}") for c in tie or []], F.xxhash64("_feat").asc()]
    known = skew.last_known(stacked, keys, order, "_feat", "_known", max_rows).filter("_kind = 1")
    live = F.col("_known._fts").isNotNull()
    if ttl_seconds is not None:
        age = F.col(ts).cast("timestamp").cast("double") - F.col("_known._fts").cast("timestamp").cast("double")
        live = live & (age <= ttl_seconds)
    return known.select(
        *keys,
        ts,
        *[F.col(f"_row.{c}").alias(c) for c in carried],
        *[F.when(live, F.col(f"_known.{c}")).alias(c) for c in cols],
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key: max_by combines map-side, so a hot key costs no more than a cold one."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def materialize(
    online: DataFrame | None, features: DataFrame, keys: list[str], ts: str, after, upto, tie: str | None = None
) -> DataFrame:
    """Features with after < ts <= upto, latest per key, laid over the online table."""
    window = features.filter(
        (F.col(ts) > F.lit(after).cast("timestamp_ntz")) & (F.col(ts) <= F.lit(upto).cast("timestamp_ntz"))
    )
    order = [ts] + ([tie] if tie else [])
    rows = window if online is None else online.unionByName(window)
    return latest_per_key(rows, keys, order)


def online_lookup(online: DataFrame, requested: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys with their features; unknown keys keep nulls."""
    return requested.join(online, keys, "left")
