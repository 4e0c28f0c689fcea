"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, rep string, size int, copies int, kind string, "
    "bucket string, block string, label int, node long, digest string, raw_sha256 string, kept boolean"
)


def words(n, seed=0, of=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def rows():
    long = words(9000, 3)
    plain = [
        (1, words(60, 1), "en", "a"), (2, words(60, 1), "en", "a"), (3, words(60, 1).replace(" ", "  \n", 3), "en", "b"),
        (4, None, None, None), (5, "", "", ""), (6, " ", "en", "a"), (7, "\t\n", None, "b"), (8, "one", "fr", "c"), (9, "one two", "fr", "c"),
        (10, long, "en", "a"), (11, long + " tail", "en", "a"), (12, long, "de", "d"), (13, words(200, 5), "en", "a"),
        (14, words(200, 5).replace("w", "v", 3), "en", "b"), (14, words(200, 5).replace("w", "v", 3), "en", "b"),
        (None, words(60, 1), "en", None), (None, "lost row", None, "z"), (None, "lost row", None, "z"), (15, "é日本🎉 'll  x y​", "xx", "é"),
        (16, "a" * 3000, "en", "b"), (17, "line\n" * 400, "en", "c"), (18, "<|endoftext|> and <|startoftext|>", "en", "c"), (14, "another text of id 14", "es", "a"),
    ]
    return [(*r, 0, -1, "x", 7, 3, "k", "b", "c", 1, 2, "d", "e", False) for r in plain]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
