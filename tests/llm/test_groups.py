"""Language, near copies, repeated strings, pages, toxicity, pipeline."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import byte_bpe, html_extract, language_id, minhash, queries, rows as common, suffix_dedup, toxicity
from tests.llm.cases import SCHEMA, frame, rows, words

DIR = "/root/testdata/sf0.001"


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- shared ---------------------------------------------------------------------------


def test_join_hot(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(4000)], "id int, key string")
    right = spark.createDataFrame([("hot", 1), ("k6", 2), ("none", 3)], "key string, v int")
    got = common.join_hot(left, right, "key")
    assert collected(got, "id", "key", "v") == collected(left.join(right, "key", "left"), "id", "key", "v")


# --- language -------------------------------------------------------------------------

SAMPLE = {
    "en": "the house of the king and the water that is with this thing on the road there was when they went",
    "fr": "la maison du roi et les eaux qui sont avec cette chose sur le chemin quand elles furent parties",
    "de": "das haus des königs und das wasser welches mit diesem ding auf der straße war als sie gingen",
}


def texts_of(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        language = rng.choice(list(SAMPLE))
        parts = SAMPLE[language].split()
        out.append((i, " ".join(rng.choices(parts, k=rng.randrange(12, 60))), language, f"https://www.site{rng.randrange(4)}.{'com' if language == 'en' else language}/x"))
    return out


def test_language_held_out(spark):
    some = texts_of(300, 1)
    hidden = [(i, t, lang if i % 2 else None, url) for i, t, lang, url in some]
    df = spark.createDataFrame(hidden, "doc_id long, text string, said string, url string")
    got = {r["doc_id"]: r for r in language_id.identify(df, declared="said", address="url").collect()}
    right = sum(got[i]["language"] == lang for i, _, lang, _ in some if i % 2 == 0)
    assert right >= 0.97 * 150 and all(r["accepted"] for r in got.values())


def test_language_evidence(spark):
    some = [(i, t, lang, url) for i, t, lang, url in texts_of(300, 2)]
    odd = [
        (1000, "", "fr", None), (1001, None, None, None), (1002, "0f9a 7c3e 00ff 1d2b 99ab 7731 5d5d a0a0 4e4e 8f8f 1234 9876", None, None), (1003, "Это русский текст о погоде и о книгах", None, None),
        (1004, "z", "de", "https://a.de/1"), (1004, "z", "de", "https://a.de/1"), (None, SAMPLE["fr"], "EN-us", "no address"),
    ]
    df = spark.createDataFrame(some + odd, "doc_id long, text string, said string, url string")
    got = defaultdict(list)
    for r in language_id.identify(df, declared="said", address="url").collect():
        got[r["doc_id"]].append(r)
    assert len(got[1004]) == 2 and {r["language"] for r in got[1004]} == {"de"}
    assert not got[1000][0]["accepted"] and got[1000][0]["language"] == "fr" and not got[1001][0]["accepted"]
    assert got[1002][0]["language"] == got[1003][0]["language"] == "und" and not got[1002][0]["accepted"]
    assert got[None][0]["language"] == "fr" and got[None][0]["declared"] == "en"


def test_language_scores_by_hand():
    languages, tables = language_id.fit([(lang, t) for _, t, lang, _ in texts_of(60, 3)])
    some = ["", "a", "the king", SAMPLE["de"] * 300, "x"]
    means, sizes = language_id.score(some, tables)
    for text, mean, size in zip(some, means, sizes, strict=True):
        data = np.frombuffer(language_id.prepared(text), np.uint8)
        assert size == max(0, len(data) - 2)
        if size:
            assert np.allclose(mean, tables[:, language_id.trigrams(data)].mean(axis=1, dtype=float), atol=1e-4)
    assert languages == sorted(SAMPLE)


def test_language_odd_tables(spark):
    assert language_id.identify(frame(spark, []), declared="lang", host="source").count() == 0
    assert language_id.identify(frame(spark), declared="lang", host="source").count() == len(rows())
    bare = frame(spark).withColumn("lang", F.lit(None).cast("string"))
    got = language_id.identify(bare, declared="lang", host="source")
    assert got.filter("language is not null").isEmpty() and got.filter("accepted").count() == len([r for r in rows() if (r[1] or "").strip(" ")])


def test_language_rare_in_a_large_table(spark):
    some = [(i, t, lang, None) for i, t, lang, _ in texts_of(12_000, 4)]
    greek = "το σπίτι του βασιλιά και το νερό που είναι με αυτό το πράγμα στον δρόμο όταν έφυγαν από εκεί"
    rare = [(20_000 + i, greek, "el", None) for i in range(5)] + [(None, greek.upper() + " ωραία", "el", None)] * 2
    df = spark.createDataFrame(some + rare, "doc_id long, text string, said string, url string")
    got = language_id.identify(df, declared="said", address="url").filter("doc_id is null or doc_id >= 20000").collect()
    assert len(got) == 7 and {(r["language"], r["accepted"]) for r in got} == {("el", True)}


# --- near copies ----------------------------------------------------------------------


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 1.0


def near_classes(pairs, least=0.8):
    bags = [bag(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(set)
    for i, b in enumerate(bags):
        for k in b or [None]:
            where[k].add(i)
    for i, b in enumerate(bags):
        for j in set().union(*(where[k] for k in b or [None])):
            if j < i and root(i) != root(j) and similarity(b, bags[j]) >= least:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(pairs)):
        groups[root(i)].append(pairs[i][0])
    return sorted(((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g), key=repr)


def variants(seed):
    """Chains and stars of near copies, with words changed."""
    rng = random.Random(seed)
    out = []
    for k in range(12):
        base = words(rng.randrange(40, 300), 100 * seed + k, 5000).split()
        for j in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(9)}"
            out.append(" ".join(copy))
            base = copy if j % 2 else base
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    pairs = variants(seed)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    got = minhash.near_copies(df)
    assert collected(got, "doc_id", "class_id", "class_size") == near_classes(pairs)


def test_near_copies_star(spark):
    """Copies of one text that lie far apart: links only of those that share edits, and few pairs verified."""
    rng = random.Random(9)
    base = words(150, 77, 5000).split()
    texts = [" ".join(base)]
    for k in range(260):
        copy = list(base if rng.random() < 0.8 else texts[-1].split())
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(4000)}"
        texts.append(" ".join(copy))
    for without in (0, 1):
        pairs = list(enumerate(texts[without:]))
        df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
        assert collected(minhash.near_copies(df), "doc_id", "class_id", "class_size") == near_classes(pairs)


def test_near_copies_whole_table(spark):
    pairs = [tuple(r) for r in queries.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text").collect()]
    got = queries.QUERIES["op5_near_copies"](spark, "/root/testdata/sf0.01")
    assert collected(got, "doc_id", "class_id", "class_size") == near_classes(pairs)


def test_near_copies_odd_rows(spark):
    got = minhash.near_copies(frame(spark))
    assert collected(got, "doc_id", "class_id", "class_size") == near_classes([(r[0], r[1]) for r in rows()])
    assert got.filter("kept").count() == got.groupBy("class_id", "class_size").count().count() + got.filter("class_id is null and kept").count() - (1 if got.filter("class_id is null").count() else 0)
    assert minhash.near_copies(frame(spark, [])).count() == 0


def test_signatures_are_unbiased():
    some = [b"the cat " * 500, b"the cat " * 300 + b"a dog", words(400, 1).encode(), words(400, 1).replace("w1 ", "z ").encode(), b"", b"one two"]
    hashes, doc, counts = minhash.multisets(*minhash.shingles(some))
    for i, text in enumerate(some):
        assert sorted(counts[doc == i].tolist()) == sorted(bag(text.decode()).values())
    points = minhash.signatures(hashes, doc, counts, len(some), places=4000)
    assert np.isinf(points[4]).all() and not np.isinf(points[[0, 1, 2, 3, 5]]).any()
    for a, b in ((0, 1), (2, 3), (0, 2)):
        exact = similarity(bag(some[a].decode()), bag(some[b].decode()))
        assert abs((points[a] == points[b]).mean() - exact) < 0.04


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(300, 500), (500, 400)]
    got = {r["node"]: r["label"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


# --- repeated strings -----------------------------------------------------------------


def removed(pairs, length=50):
    last = suffix_dedup._LAST
    first = {}
    data = [(last if i is None else i, (t or "").encode()) for i, t in pairs]
    for key, b in data:
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            first[g] = min(first.get(g, last), key)
    out = []
    for (doc_id, _), (key, b) in zip(pairs, data, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for j, y in enumerate(gone) if y and (j == 0 or not gone[j - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "bucket"), [(4000, 20_000), (1 << 22, 1 << 22), (500, 2000)])
def test_suffix_dedup(spark, monkeypatch, block, bucket):
    rng = random.Random(block)

    def letters(n):
        return "".join(rng.choices("abcdefghij ", k=n))

    passages = [letters(rng.randrange(50, 300)) for _ in range(12)] + ["x" * 200, "ab" * 150, letters(60) * 4]
    pairs = []
    for i in range(120):
        text = ""
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            text += letters(rng.randrange(120)) + (p[a : rng.randrange(a, len(p))] if rng.random() < 0.6 else p)
        pairs.append((i, text))
    pairs += [(500, None), (501, ""), (502, "é" * 60), (503, "é" * 61 + "q"), (None, passages[0]), (7, passages[1]), (7, passages[1]), (160, "x" * 5000), (161, "x" * 3000 + "y")]
    rng.shuffle(pairs)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(pairs)


def test_suffix_dedup_large_buckets_in_bounded_memory():
    """a bucket is compared a few names at a time, and a frequent name by the strings of its windows; marks stay the same."""
    import tracemalloc

    rnd = random.Random(4)
    line = b"a line of forty bytes that all of them have in it"
    chunks = [bytes(rnd.choices(b"abcdefgh ", k=400)) for _ in range(60)]
    docs = [b"".join([rnd.choice(chunks), bytes(rnd.choices(b"xyz", k=30)), line[: rnd.randint(30, 49)], rnd.choice(chunks)[: rnd.randint(50, 400)]]) for _ in range(1500)]
    names, doc, start, size, data, at = suffix_dedup.windows(docs)

    def covered(row, first, many):
        edge = np.zeros(len(data) + 1, int)
        np.add.at(edge, at[row] + first, 1)
        np.add.at(edge, at[row] + first + many, -1)
        return np.cumsum(edge) > 0

    want = covered(*suffix_dedup._marked(data, at, size, names, doc, 50))
    assert want.any()
    for most in (1 << 20, 20_000, 300):  # at last nearly every name counts as frequent
        assert (covered(*suffix_dedup._marked_in_parts(data, at, size, names, doc, 50, most)) == want).all()

    joined = suffix_dedup._gather(data, at, size)
    payload = suffix_dedup._pack(
        joined, size.astype(np.uint8), (names & np.uint64(0xFFFFFFFF)).astype(np.uint32), doc.astype(np.int32), start.astype(np.int32),
        np.arange(len(docs), dtype=np.int32), np.arange(len(docs)),
    )
    batch = suffix_dedup._rows([(0, "b", suffix_dedup._WINDOWS, payload)])
    list(suffix_dedup._find(50)(iter([batch])))  # tables that stay
    tracemalloc.start()
    list(suffix_dedup._find(50)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(joined) > 2_000_000 and peak < 22 * len(joined)


def test_suffix_dedup_tables(spark):
    got = queries.QUERIES["op4_suffix_dedup"](spark, DIR)
    pairs = [tuple(r) for r in queries.documents(spark, DIR).select("doc_id", "text").collect()]
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(pairs)
    odd = suffix_dedup.remove_repeats(frame(spark), with_texts=True)
    assert collected(odd, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed([(r[0], r[1]) for r in rows()])
    assert odd.filter(F.sha2("kept", 256) != F.col("kept_sha256")).isEmpty()
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_intervals():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choices("ab", k=30))
        order = sorted(range(30), key=lambda i: text[i:])
        common = [0]
        for a, b in zip(order, order[1:]):
            n = 0
            while max(a, b) + n < 30 and text[a + n] == text[b + n]:
                n += 1
            common.append(n)
        got = {(n, frozenset(order[i : j + 1])) for n, i, j in suffix_dedup.intervals(common, 2)}
        want = set()
        for i in range(30):
            for j in range(i + 2, 31):
                at = frozenset(k for k in range(30) if text.startswith(text[i:j], k))
                after = {text[k + j - i : k + j - i + 1] for k in at}
                if len(at) > 1 and (len(after) > 1 or "" in after):
                    want.add((j - i, at))
        assert got == want


# --- pages ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tree(spark):
    return html_extract.train(spark)


def test_tree_knows_its_table(tree):
    for page in html_extract.labelled_pages():
        blocks = html_extract.flat_blocks(page)
        for b, f in zip(blocks, html_extract.features(blocks), strict=True):
            assert html_extract.is_main(tree, f) == ("main-text" in b[0].split())


def test_pages_of_the_table(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.QUERIES["op6_main_text"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        parts = [re.sub(r"</?(?:b|a)[^>]*>", "", x).replace("<br>", " ") for x in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n\n".join(x for x in (" ".join(html.unescape(x).split()) for x in parts) if x)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want) and got[p["page_id"]]["url"] == p["url"]


LONG = "This is one of the long paragraphs of a story that goes on with more than twenty words in it so that it counts"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain & simple " + LONG, "plain & simple " + LONG),
        (f"<main><h1>T</h1><p>{LONG}<p>b&amp;c&nbsp;d<br>e</main><footer>f</footer>", f"T\n\n{LONG}\n\nb&c d e"),
        (f"<article><p>{LONG}</p><div class='ad'>buy</div><form>Name <input></form><aside>x</aside><p>end</article>", f"{LONG}\n\nend"),
        (f"<article><p>{LONG}<section class='comments'><p>{LONG}</section></article><script>if (a<b) '</p>'", LONG),
        (f"<header><h1>Site</h1></header><nav><a href=x>y</a></nav><article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n\n{LONG}"),
        (f"<article><p>a <b>b</b>c <a href='q>r'>d</a> {LONG}</p><!-- <p>no</p> --><ul><li>one</li><li>two</li></ul></article>", f"a bc d {LONG}\n\none\n\ntwo"),
        (f"<div id='cookie-notice'><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div><article><p>x</p></article>", "x"),
        ("<script>var a = 1;</script><style>p{}</style><title>t</title>", ""),
    ],
)
def test_layouts(tree, page, want):
    assert html_extract.main_text(page, tree) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html class='no-header'><body class='has-sidebar'><h2>T</h2><p>{LONG}</p></body></html>", f"T\n\n{LONG}"),
        (f"<body class='page sidebar'><article><p>{LONG}</p><p>end</p></article>", f"{LONG}\n\nend"),
        (f"<div class='with-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<div id='page' class='no-banner'><p>{LONG}</p></div>", LONG),
        (f"<article class='post has-header comments-open'><p>{LONG}</p><p>end</p></article>", f"{LONG}\n\nend"),
        (f"<body><form action='/'><div><p>{LONG}</p></div></form></body>", LONG),
        (f"<div><form><article><p>{LONG}</p><p>end</p></article></form></div>", f"{LONG}\n\nend"),
        (f"<div class='header-layout'><article><p>{LONG}</p></article><article><p>end</p></article></div>", f"{LONG}\n\nend"),
        (f"<div class='sidebar'><main><p>{LONG}</p><p>end</p></main></div>", f"{LONG}\n\nend"),
        (f"<article><p>{LONG} <span class='tags'>one</span> and <em class='notice'>two</em> three</p></article>", f"{LONG} one and two three"),
        (f"<article><p>{LONG}</p></article><section id='comments'><article><p>{LONG}</p></article></section><aside><article><p>{LONG}</p></article></aside>", LONG),
        (f"<main><article><p>{LONG}</p></article><div class='related-posts'><article><p>{LONG}</p></article></div></main>", LONG),
    ],
)
def test_wrappers_named_by_layout(tree, page, want):
    assert html_extract.main_text(page, tree) == want


MENU = "<div><ul><li><a>Home</a></li><li><a>About us</a></li></ul></div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>See the <a>full report</a> for all of the details.</p><p>{LONG}</p></article>", f"See the full report for all of the details.\n\n{LONG}"),
        (f"<article><p>{LONG} <a>two words</a></p></article>", f"{LONG} two words"),
        (f"{MENU}<article><p>{LONG}</p></article>", LONG),
        (f"{MENU}<div><h1>T</h1><p>{LONG}</p><p>{LONG} <a>with a link</a> in it</p></div>{MENU}", f"T\n\n{LONG}\n\n{LONG} with a link in it"),
        (f"{MENU}<div><p>{LONG}</p></div><div><p><a>{LONG}</a></p><p><a>{LONG}</a></p></div>", LONG),
        (f"<article><div class='market-share'><p>{LONG}</p></div></article>", LONG),
        (f"<div class='post'><div class='post-header'><h1>T</h1></div><p>{LONG}</p></div>", f"T\n\n{LONG}"),
        (f"<article><p class='byline'>by me</p><p>{LONG}</p><div class='search-results'><p>{LONG}</p></div></article>", f"by me\n\n{LONG}\n\n{LONG}"),
        (f"<article><p>{LONG}</p></article><div class='site-footer'><p>{LONG}</p></div><div class='comment-list'><p>{LONG}</p></div>", LONG),
    ],
)
def test_links_and_names_that_mislead(tree, page, want):
    assert html_extract.main_text(page, tree) == want


def test_tree_uses_sizes_and_neighbours(tree):
    def used(node):
        return {node[0]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    names = {html_extract.FEATURES[i] for i in used(tree)}
    assert names & {"words before", "words behind", "links before", "links behind"} and {"words", "links"} & names and "main" in names


def test_pages_odd_rows(spark):
    some = [(1, None, None, 5), (None, "u", "<p>" + "w " * 100000, 5), (2, "u", "", 5), (2, "u", "", 5), (3, "u", "<" * 5000 + "a<", 5), (4, "u", "<p <p <p '\"" * 50, 5)]
    df = spark.createDataFrame(some, "page_id long, url string, html string, text int")
    got = html_extract.extract(df).collect()
    assert len(got) == len(some) and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html_extract.extract(df.limit(0)).count() == 0


# --- toxicity -------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    found = queries.QUERIES["op8_toxicity"](spark, d).filter("held_out")
    insults = "idiot|stupid|moron|clown|trash|scum|loser|worthless|pathetic|disgusting"
    text = queries.documents(spark, d).select("doc_id", F.regexp_count(F.lower("text"), F.lit(rf"\b({insults})\b")).alias("n"))
    both = found.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").join(text, "doc_id").collect()
    seen = [r for r in both if r["toxic"] == 1 and r["n"] >= 2]
    clean = [r for r in both if r["toxic"] == 0 and r["n"] == 0]
    assert sum(r["predicted"] for r in seen) >= 0.9 * len(seen) > 0
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)


def toxic_texts():
    rng = random.Random(8)
    some, labels = [], []
    for i in range(400):
        text = words(rng.randrange(20, 80), i, 3000).split()
        if i % 4 == 0:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["blorgus", "snaffit"])
        some.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    return some, labels


def test_toxicity_sees_changed_insults(spark):
    some, labels = toxic_texts()
    odd = [(1000, "b l o r g u s and s.n.a.f.f.i.t you blorxgus"), (1001, "w1 w2 w3 w4"), (1002, None), (1003, ""), (1003, ""), (None, "blorgus " * 30000)]
    df = spark.createDataFrame(some + odd, "doc_id long, text string")
    score = defaultdict(list)
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (5000, 1)], "doc_id long, toxic int")
    for r in toxicity.score(df, marks).collect():
        score[r["doc_id"]].append(r["score"])
    assert len(score[1003]) == 2 and all(0 <= s <= 1 for found in score.values() for s in found)
    assert score[1000][0] > 0.5 and score[None][0] > 0.5
    assert score[1001][0] < 0.3 and score[1002][0] < 0.3 and score[1003][0] == score[1002][0]


def test_toxicity_without_labels(spark):
    some, labels = toxic_texts()
    df = spark.createDataFrame(some[:20], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(df, one).collect()} == {1.0}
    assert toxicity.score(frame(spark, []), one).count() == 0


def test_kernel():
    assert toxicity.kernel("idiot", "idiot") == pytest.approx(1)
    for changed in ("idxiot", "idot", "idioot"):
        assert toxicity.kernel("idiot", changed) > toxicity.LEAST > toxicity.kernel("idiot", "station")
    machine = toxicity.Landmarks(["idiot", "stupid"])
    tokens = [f"{a}{b}{c}" for a in ("id", "st", "tion") for b in ("io", "up", "x") for c in ("t", "id", "ing", "")]
    found = machine.learn(tokens)
    for t in tokens:  # the bound leaves nothing out; a word's map is as long as its strength
        best = max(toxicity.kernel(t, w) for w in machine.chosen)
        assert math.hypot(*found[t]) == pytest.approx(toxicity.strength(best) if best >= toxicity.LEAST else 0)


def kernel_by_enumeration(a, b):
    """All three-letter subsequences of two words with single letters and runs, each pair weighted."""

    def places(word):
        runs = ["\x02", *(m[0] for m in re.finditer(r"(.)\1*", word)), "\x03"]
        return [(at[-1] - at[0] + 1, [(runs[i][0], len(runs[i]) > 1) for i in at]) for at in itertools.combinations(range(len(runs)), 3)]

    total = 0.0
    for span, some in places(a):
        for other_span, others in places(b):
            if [c for c, _ in some] == [c for c, _ in others]:
                total += toxicity.DECAY ** (span + other_span) * toxicity.RUNS ** sum(r != q for (_, r), (_, q) in zip(some, others, strict=True))
    return total


def test_kernel_by_enumeration_and_positive_definite():
    rng = random.Random(5)
    some = ["hell", "heel", "but", "butt", "pop", "poop", "aabbaa", "idiot", "idxiot", *("".join(rng.choices("abcde", k=rng.randrange(3, 9))) for _ in range(20))]
    letters, runs = [toxicity.marked(w)[None] for w in some], [toxicity.run_marks(w)[None] for w in some]
    grid = np.array([[toxicity.shared(a, b, r, q)[0] for b, q in zip(letters, runs, strict=True)] for a, r in zip(letters, runs, strict=True)])
    want = [[kernel_by_enumeration(a, b) for b in some] for a in some]
    assert grid == pytest.approx(np.array(want), rel=1e-4)
    assert np.linalg.eigvalsh(grid)[0] > -1e-3 * grid.max()
    machine = toxicity.Landmarks(["hell", "heel", "but", "butt"])  # rows and root are of that kernel
    scaled = grid / np.sqrt(np.outer(np.diag(grid), np.diag(grid)))
    maps = machine.learn(["hell", "heel", "but", "butt"])
    at = [some.index(w) for w in machine.chosen]
    for i, a in enumerate(machine.chosen):
        for j, b in enumerate(machine.chosen):
            assert np.dot(maps[a], maps[b]) == pytest.approx(scaled[at[i], at[j]], abs=0.01)
    assert np.dot(maps["hell"], maps["heel"]) < 0.8 and np.dot(maps["but"], maps["butt"]) < 0.95


def test_toxicity_tells_runs_apart(spark):
    some, labels = [], []
    for i in range(400):
        text = words(30, i, 3000).split()
        for k in range(3 if i % 4 < 2 else 0):
            text[(9 * k + i) % 30] = ("hell", "butt")[k % 2] if i % 4 == 0 else ("heel", "but")[k % 2]
        some.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    odd = [(1000, "a heel but a heel"), (1001, "what the hell, butt, hell"), (1002, words(30, 7, 3000))]
    df = spark.createDataFrame(some + odd, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("score", F.lit("x"))
    marks = spark.createDataFrame([*labels, (8, 0)], "doc_id long, toxic int")  # 8 is labelled 1 and 0
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, marks).collect()}
    assert got[1001] > 0.5 and got[1000] < 0.3 and got[1002] < 0.3


INSULTS = ["idiot", "moron", "stupid", "trash", "clown", "worthless", "disgusting"]


def test_kernel_is_tolerant():
    rng = random.Random(12)
    for word in INSULTS:
        changed = [
            "x".join(word), "".join(c + rng.choice("bfhkqvxz") for c in word), "".join(c * 3 for c in word), "".join(c * 2 for c in word),
            f"youare{word}personandmore", f"{word}andsomemorelettersbehind", f"andsomemoreletters{word}", word[:2] + "q" + word[2:-1] + "kv" + word[-1], "bcdfghkmnp" * 1000 + word,
        ]
        for token in changed:
            found = toxicity.Landmarks([word]).learn([token])[token]
            assert found and 0 < math.hypot(*found) <= 1 + 1e-9, token
            assert len(token) > 4000 or math.hypot(*found) == pytest.approx(toxicity.strength(toxicity.kernel(token, word)), rel=1e-3), token
        for token in (f"{'x'.join(word)}person", f"you{'x'.join(word)}man"):  # at the limit, whatever the word's length
            assert toxicity.kernel(token, word) > 0.95 * toxicity.LEAST, token
    for word, clean in [("idiot", "idiom"), ("idiot", "station"), ("scum", "sum"), ("clown", "crown"), ("loser", "leoureleier")]:
        assert toxicity.kernel(clean, word) < toxicity.LEAST


def test_toxicity_compares_only_windows_that_can_be_close(monkeypatch):
    """op8: of random words few windows have enough of a landmark's letters; what is close stays as close as by all windows."""
    draw, landmarks = random.Random(8), ["worthless", "stupid", "idiot", "moron", "eeriness"]
    some = ["".join(draw.choice("wortheslupidmn") for _ in range(draw.randint(3, 14))) for _ in range(3000)]
    for word in landmarks:
        at = [(draw.randrange(len(word)), draw.choice("wortheslupidmn")) for _ in range(40)]
        some += [word, word * 2, "x" + word, word + "s", "x".join(word), f"some{word}thing", *(word[:i] + c + word[i:] for i, c in at), *(word[:i] + c + word[i + 1 :] for i, c in at)]
    some.append("o" * 9 + "abc" * 2000 + "worthless" + "abc" * 700)
    rows, shared = [], toxicity.shared
    machine = toxicity.Landmarks(landmarks)
    monkeypatch.setattr(toxicity, "shared", lambda some, *more: rows.append(len(some)) or shared(some, *more))
    found = machine.learn(sorted(set(some)))
    assert sum(rows) < 9_000
    for token in sorted(set(some[::7] + some[3000:-1])):
        best = max(toxicity.kernel(token, w) for w in landmarks)
        if abs(best - toxicity.LEAST) > 1e-4:
            assert math.hypot(*found[token]) == pytest.approx(toxicity.strength(best) if best >= toxicity.LEAST else 0, abs=1e-4), token
    assert math.hypot(*found[some[-1]]) > 0.4


def test_toxicity_sees_inserted_letters(spark):
    some, labels = [], []
    for i in range(600):
        text = words(size := 30 + i % 20, i, 3000).split()
        if i % 3 == 0:
            for k in range(4):
                text[(7 * k + i) % size] = INSULTS[(i // 3 + k) % len(INSULTS)]
        some.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    put = {"one": lambda w: w[:2] + "q" + w[2:], "two": lambda w: w[:2] + "q" + w[2:-1] + "k" + w[-1], "every": "x".join, "thrice": lambda w: "".join(c * 3 for c in w), "inside": lambda w: f"youare{w}personandmore"}
    held_out = [(1000 + i, " ".join([words(20, i), *map(f, INSULTS[:4]), words(20, i + 50)])) for i, f in enumerate(put.values())]
    clean = [(2000, "the idiom of the crown at the station"), (2001, words(50, 77, 3000))]
    df = spark.createDataFrame(some + held_out + clean, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[i] > 0.5 for i, _ in held_out), {k: got[1000 + i] for i, k in enumerate(put)}
    assert got[2000] < 0.3 and got[2001] < 0.3


# --- pipeline -------------------------------------------------------------------------


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "source_mix", "byte_bpe"]
    docs = queries.documents(spark, DIR)
    kept = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    owner = {}
    for doc_id, text in sorted(kept):
        owner.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text), doc_id)
    once = [(i, t) for i, t in kept if i in set(owner.values())]
    near = {d for d, c, _ in near_classes(once) if d == c}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = now
        now = stage(spark, before, DIR)
        assert now.columns == docs.columns
        if name == "exact_dedup":
            assert {r[0] for r in now.select("doc_id").collect()} == set(owner.values())
        if name == "near_dedup":
            assert {r[0] for r in now.select("doc_id").collect()} == near
        now = now.cache()
    copies = Counter(r[0] for r in now.select("doc_id").collect())
    assert set(copies) <= near and max(copies.values()) <= 3
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(queries.BYTE_RANKS)), special_tokens={})
    text = dict(kept)
    got = corpus_pipeline.run(spark, DIR).collect()
    assert Counter(r["doc_id"] for r in got) == copies
    assert all(r["n_tokens"] == len(library.encode_ordinary(text[r["doc_id"]])) for r in got)


def test_pipeline_odd_rows(spark):
    now = frame(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, DIR).cache()
        assert [c for c, _ in now.dtypes] == [c.split()[0] for c in SCHEMA.split(", ")]
    assert corpus_pipeline.STAGES[4][1](spark, now, DIR).count() == now.count()
    once = corpus_pipeline.without_copies(spark, frame(spark), DIR)
    assert once.count() == len({re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows()})
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0
