"""Exact copies, mix, byte pairs, token counts, fingerprints."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspark.llm import byte_bpe, exact_dedup, fingerprints, mixing, queries, token_counts
from tests.llm.cases import frame, rows, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DIR = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- exact copies ---------------------------------------------------------------------


def owners(pairs):
    groups = defaultdict(list)
    for doc_id, text in pairs:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids), sha(text)) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [64 << 20, 2000, 1])
def test_exact_dedup(spark, limit):
    df = frame(spark).repartition(3)
    got = exact_dedup.exact_dedup(df, trie_bytes=limit)
    assert collected(got, "doc_id", "keep_id", "group_size", "text_sha256") == owners([(r[0], r[1]) for r in rows()])
    kept = got.filter("kept").groupBy("text_sha256").count().collect()
    assert {r["count"] for r in kept} == {1} and len(kept) == len({r[3] for r in owners([(r[0], r[1]) for r in rows()])})
    assert got.filter("kept and keep_id is not null and doc_id <> keep_id").isEmpty()


def test_trie_against_dictionary():
    rng = random.Random(2)
    trie, count = exact_dedup.PatriciaTrie(), Counter()
    for row in range(3000):
        text = bytes(rng.choices(b"ab", k=rng.randrange(9))) * rng.choice([1, 1, 40])
        count[text] += 1
        trie.find(text, exact_dedup.Owner((0, row, row), 0, row, len(text), b"")).count += 1
    assert {t: o.count for t, o in trie.drain()} == count
    assert trie.held == 0 and not list(trie.drain())


def test_trie_counts_what_it_holds():
    """Short texts cost their nodes and owners too; a cut leaves at most what it was asked for, and loses nothing."""
    rng = random.Random(3)
    some = {rng.randbytes(rng.choice([0, 1, 2, 8])) for _ in range(4000)}
    trie = exact_dedup.PatriciaTrie()
    for row, text in enumerate(some):
        trie.find(text, exact_dedup.Owner((0, row, row), 0, row, len(text), b""))
    assert trie.held > len(some) * exact_dedup.OWNER_BYTES
    below = trie.held // 3
    out = [t for t, _ in trie.cut(below)]
    assert 0 < trie.held <= below and trie.held == exact_dedup._weight(trie.root) - exact_dedup.NODE_BYTES
    out += [t for t, _ in trie.cut()]
    assert trie.held == 0 and sorted(out) == sorted(some)


def test_normalised():
    for text in ("", " ", "a", " a\t\nb ", "\n\n", "a\x0bb\x0c", " a b"):
        assert exact_dedup.normalised(text.encode()).decode() == re.sub(r"[\x20\x09-\x0d]+", " ", text)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


# --- mix ------------------------------------------------------------------------------


def targets(sizes):
    """Shares by reshaping step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, total = {}, set(order), sum(sizes.values())
    while left:
        free = total - sum(out.values())
        share = {s: free * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if share[s] >= 3 * sizes[s]]
        if not above:
            return {**out, **share}
        for s in above:
            out[s] = 3 * sizes[s]
            left.remove(s)
    return out


def test_mix(spark):
    got = [r.asDict() for r in mixing.mix_plan(frame(spark)).collect()]
    size = {}
    for r in rows():
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or ""))
    want = targets(size)
    found = Counter((r["source_size"], round(r["target"], 6)) for r in got)
    assert found == Counter((size[r[3]], round(float(want[r[3]]), 6)) for r in rows())
    assert len(got) == len(rows()) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert collected(mixing.mix_plan(frame(spark).repartition(5)), "doc_id", "taken") == collected(mixing.mix_plan(frame(spark)), "doc_id", "taken")


def test_mix_comes_near(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("w "), F.lit(20)).alias("text"))
    got = mixing.mix_plan(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.06 * r["target"] for r in got)


def test_mix_empty(spark):
    assert mixing.mix_plan(frame(spark, [])).count() == 0
    none = [r for r in rows() if not (r[1] or "").strip()]
    assert {(r["target"], r["taken"]) for r in mixing.mix_plan(frame(spark, none)).collect()} == {(0.0, 0)}


# --- byte pairs -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ranks_file():
    first = open(RANKS, "rb").readline().split()
    assert byte_bpe.read_ranks(RANKS)[base64.b64decode(first[0])] == int(first[1])


def test_encoding_equals_library(reference):
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN, remembered=50)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "日", "🎉", "1", "²", ".", "--", "the", " the", " ", "\x1c", " ", "​", "́", "%", "$$$", "tion"]
    some = ["".join(rng.choices(parts, k=rng.randrange(15))) for _ in range(4000)]
    some += ["".join(rng.choices("abcdeintorsh", k=rng.randrange(1, 60))) for _ in range(2000)]
    some += ["a" * 5000, " " * 4000, "ab" * 3000, "\n" * 999, "word " * 900]
    for text in some:
        ids = bpe.encode_text(text)
        assert ids == " ".join(map(str, reference.encode_ordinary(text))), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_every_character(reference):
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    points = [chr(c) for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for c in points:
        assert bpe.encode(f"a{c}b1{c} {c}") == reference.encode_ordinary(f"a{c}b1{c} {c}"), hex(ord(c))


def test_bpe_queries(spark, reference):
    want = []
    for r in rows():
        ids = reference.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(r[1] or "")))
    got = byte_bpe.bpe_digests(frame(spark), RANKS, public_tokenizers.PATTERN)
    assert collected(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    ids = byte_bpe.bpe_ids(frame(spark), RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.bpe_texts(ids, RANKS, public_tokenizers.PATTERN)
    assert collected(back, "doc_id", "text") == sorted(((r[0], r[1] or "") for r in rows()), key=repr)
    assert byte_bpe.bpe_digests(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_whole_table(spark, reference):
    got = {r["doc_id"]: r["ids_sha256"] for r in queries.QUERIES["op7_byte_bpe"](spark, DIR).collect()}
    for r in queries.documents(spark, DIR).collect():
        assert got[r["doc_id"]] == sha(" ".join(map(str, reference.encode_ordinary(r["text"]))))


# --- token counts ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def test_token_counts_and_cache(spark, tokenizer):
    cache = token_counts.fresh_cache(spark)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(tokenizer.encode(r[1] or "", add_special_tokens=False)), n > 2048) for r in rows()), key=repr)
    got = token_counts.token_counts(frame(spark), WORDS, cache)
    assert collected(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    entries = spark.read.parquet(cache).count()
    assert entries == len({" ".join(re.split(r"[\x20\x09-\x0d]+", r[1] or "")).strip() for r in rows()})
    assert collected(token_counts.token_counts(frame(spark), WORDS, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    more = [(99, "new text", *rows()[0][2:])]
    assert token_counts.token_counts(frame(spark, rows() + more), WORDS, cache).count() == len(want) + 1
    assert spark.read.parquet(cache).count() == entries + 1
    assert token_counts.token_counts(frame(spark, []), WORDS, token_counts.fresh_cache(spark)).count() == 0


def test_token_chunks(tokenizer):
    counter = token_counts.ChunkCounter(WORDS, remembered=20)
    rng = random.Random(4)
    parts = ["a", "B", " ", "\n", "É", "é", "́", "Σ", "ΟΔΟΣ", "'s", "日", "12", "!?", "<|endoftext|>", "<|startoftext|>", " ", "\x1c", "\u0085", "İ", "ß"]
    some = ["".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(3000)]
    assert counter.counts([token_counts.content(t.encode()) for t in some]) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in some]


# --- fingerprints ---------------------------------------------------------------------


def edited(pairs):
    """doc_id, n_chars, sha of the edited text, by hand; pairs in order."""
    out = []
    for i, (doc_id, text) in enumerate(pairs):
        n, after = len(text), pairs[(i + 1) % len(pairs)][1]
        k = n // 4
        out.append((doc_id, n, sha(text[: n - k] + after[:k])))
    return out


def test_fingerprint_query(spark):
    docs = queries.documents(spark, DIR).select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.QUERIES["op1_fingerprints"](spark, DIR)
    assert collected(got, "doc_id", "n_chars", "edited_sha256") == sorted(edited([tuple(r) for r in docs]), key=repr)
    lines = got.collect()
    text = dict(tuple(r) for r in docs)
    by_print = defaultdict(set)
    for r in lines:
        by_print[r["fingerprint"]].add(text[r["doc_id"]])
    assert all(len(t) == 1 for t in by_print.values()) and len(by_print) == len(set(text.values()))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in lines)
    long = [r for r in lines if r["n_chars"] > 500]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.6
    assert sum(r["near_next"] for r in long) / len(long) < 0.2


def test_fingerprints_add_up(spark):
    texts = ["b one\na two\nc", "a two\nc\nb one", "a two\nc", "b one", "a two\nc\nb on", "", "\n", "x" * 70 + "\ny", "x" * 64 + "\n" + "x" * 6 + "\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    assert prints[0] == prints[1] and len(set(prints.values())) == len(texts) - 1
    lanes = {r["doc_id"]: r for r in fingerprints.vectors(df, ["doc_id"]).collect()}
    for c in fingerprints.VECTOR:  # the vectors of two parts sum to that of the whole
        assert lanes[2][c] + lanes[3][c] == lanes[0][c]


def test_fingerprints_odd_rows(spark):
    got = fingerprints.edited_fingerprints(frame(spark)).collect()
    assert len(got) == len(rows())
    assert sorted((r["doc_id"], r["n_chars"]) for r in got if r["doc_id"]) == sorted((r[0], len(r[1] or "")) for r in rows() if r[0])
    one = spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")
    line = fingerprints.edited_fingerprints(one).first()
    assert line["edited_sha256"] == sha("abcdefab") and line["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(frame(spark, [])).count() == 0
    assert fingerprints.fingerprints(frame(spark)).count() == len(rows())


# --- SQL ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    cur = con.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert collected(df, *columns) == sorted(cur.fetchall(), key=repr)


def test_likeness_sees_an_inserted_letter(spark):
    """One letter anywhere changes one piece: texts in one paragraph stay alike."""
    some = words(800, 4, 5000)
    texts_ = {1: some, 2: "x" + some, 3: some[:2000] + "q" + some[2000:], 4: some[3:], 5: words(800, 5, 5000), 6: "日" * 3000, 7: "a" * 3000}
    df = spark.createDataFrame(list(texts_.items()), "doc_id long, text string")
    found = fingerprints.vectors(fingerprints.keyed_texts(df), ["kid"]).withColumn("lanes", fingerprints.signed(""))
    lanes = {r["kid"]: (np.array(r["lanes"]), r["pieces"]) for r in found.collect()}

    def near(a, b):
        return float(lanes[a][0] @ lanes[b][0] / np.sqrt((lanes[a][0] @ lanes[a][0]) * (lanes[b][0] @ lanes[b][0])))

    assert min(near(1, 2), near(1, 3), near(1, 4)) > 0.9 and near(1, 5) < 0.6
    assert lanes[6][1] == lanes[7][1] == -(-3000 // fingerprints.LONGEST)
    assert 10 < len(some) / lanes[1][1] < 60
