"""Title resolution: exact on a normalised key, then substring, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfspark.functions import text

# Spoken abbreviations -> full titles.
ALIAS = {
    "aot": "Shingeki no Kyojin",
    "jjk": "Jujutsu Kaisen",
    "oregairu": "Yahari Ore no Seishun Love Comedy wa Machigatteiru",
}
GRAM = 3


def _grams(c: Column, n: int) -> Column:
    """Distinct character n-grams; empty for shorter text."""
    count = F.length(c) - (n - 1)
    return F.when(
        count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(c, i, F.lit(n))))
    ).otherwise(F.array().cast("array<string>"))


def substring_pairs(needles: DataFrame, needle: str, hay: DataFrame, key: str) -> DataFrame:
    """All (needle, key) with needle inside key; both inputs hold distinct text.

    Text containing the needle contains each of its grams, so the needle is
    looked up by its rarest gram only and verified afterwards. Needles shorter
    than the gram are looked up among grams of their own length.
    """
    size = F.least(F.length(needle), F.lit(GRAM))
    hay_grams = hay.select(
        key, F.explode(F.concat(*[_grams(F.col(key), n) for n in range(1, GRAM + 1)])).alias("gram")
    )
    counts = hay_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_keys"))
    by_size = F.when(size == 1, _grams(F.col(needle), 1)).when(size == 2, _grams(F.col(needle), 2))
    needle_grams = needles.select(needle, F.explode(by_size.otherwise(_grams(F.col(needle), GRAM))).alias("gram"))
    # a needle with a gram nowhere in the keys matches nothing: count it as 0 and drop the needle
    rated = needle_grams.join(counts, "gram", "left").select(
        needle, F.struct(F.coalesce("n_keys", F.lit(0)).alias("n"), "gram").alias("g")
    )
    rarest = rated.groupBy(needle).agg(F.min("g").alias("g")).filter("g.n > 0").select(needle, F.col("g.gram").alias("gram"))
    return rarest.join(hay_grams, "gram").filter(F.col(key).contains(F.col(needle))).select(needle, key).distinct()


def title_variants(cat: DataFrame) -> DataFrame:
    """(mal_id, variant, pos): every spelling of a title that the row carries."""
    none = F.array().cast("array<string>")
    parts = []
    for name, kind in dict(cat.dtypes).items():
        if name in ("title", "title_english", "title_japanese"):
            parts.append((["title", "title_english", "title_japanese"].index(name), F.array(name)))
        elif name == "title_synonyms":
            parts.append((3, F.coalesce(name, none)))
        elif name == "titles":
            parts.append((4, F.transform(F.coalesce(F.col(name), F.array().cast(kind)), lambda t: t["title"])))
    ordered = [c for _, c in sorted(parts, key=lambda p: p[0])]
    variants = F.filter(F.concat(*ordered), lambda v: v.isNotNull() & (v != ""))
    return cat.select("mal_id", F.posexplode(variants).alias("pos", "variant"))


def title_index(cat: DataFrame) -> DataFrame:
    """(key, mal_id, type): normalised spelling -> first catalog row (smallest id) that uses it."""
    keyed = title_variants(cat).withColumn("key", text.normalize(F.col("variant"))).filter("key <> ''")
    first = keyed.groupBy("key").agg(F.min("mal_id").alias("mal_id"))
    return first.join(cat.select("mal_id", "type"), "mal_id")


def resolve_titles(names: DataFrame, cat: DataFrame, name: str = "name") -> DataFrame:
    """(name, mal_id): best catalog row per name, unresolved names dropped.

    Text in parentheses is ignored and abbreviations expand. An exact key wins;
    else the shortest key containing the name, series before films.
    """
    index = title_index(cat)
    cleaned = text.normalize(F.regexp_replace(name, "\\(.*?\\)", ""))
    alias = F.create_map(*[F.lit(x) for kv in ALIAS.items() for x in kv])
    asked = (
        names.select(name)
        .distinct()
        .withColumn("key", cleaned)
        .withColumn("key", text.normalize(F.coalesce(F.try_element_at(alias, F.col("key")), F.col("key"))))
        .filter("key <> ''")
    )
    exact = asked.join(index, "key").select(name, "mal_id")
    rest = asked.join(index, "key", "left_anti").withColumnRenamed("key", "needle")
    pairs = substring_pairs(rest.select("needle").distinct(), "needle", index.select("key"), "key")
    ranked = pairs.join(index, "key").select(
        "needle",
        "mal_id",
        F.row_number()
        .over(W.partitionBy("needle").orderBy(F.length("key"), (F.col("type") != "TV").cast("int"), "mal_id", "key"))
        .alias("r"),
    )
    best = rest.join(ranked.filter("r = 1"), "needle").select(name, "mal_id")
    return exact.unionByName(best)
