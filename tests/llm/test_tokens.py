"""Trie encodings and the alignment of two tokenizers."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfspark.llm import alignment, queries, trie_bpe
from tests.llm.cases import frame, rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DIR = "/root/testdata/sf0.001"

ODD = [
    "", "  ", "hello world", "Hello, hello. hellos helloes", "<|endoftext|>a<|startoftext|> x <|ENDOFTEXT|> <|endof", "a b　c\x1cd\x85e",
    "it's I'LL ÀÉ é é ΑΣ ΣΑΣ. İstanbul ǅ ﬁ", "日本語テキスト 🎉👍🏽", "a" * 3000, "x" * 7 + "é" * 50, "́abc ​foo‍", "a\0b", "12345 3.14 ½²", "w</w> </w>",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- trie ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def trie():
    return trie_bpe.TrieBpe(WORDS, remembered=500)


def check_trie(trie, words, texts):
    ids = trie.encode_texts([t.encode() for t in texts])
    for text, got, wanted in zip(texts, ids, words.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == " ".join(map(str, wanted.ids)), text
        assert trie.decode(got) == words.decode(wanted.ids, skip_special_tokens=False), text


def test_trie_equals_library(trie, words):
    check_trie(trie, words, ODD)
    rng = random.Random(1)
    for alphabet in ("abcdehilnorstu'!?.,<>/w|é日😀 \n\t12", "ab ", "aeiou", "".join(map(chr, range(32, 0x600)))):
        check_trie(trie, words, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)])


def test_prefixes_once(trie, monkeypatch):
    """A node's state is found once, however many words go through it."""
    seen = []
    found = trie_bpe.TrieBpe._last
    monkeypatch.setattr(trie_bpe.TrieBpe, "_last", lambda self, tokens, tail, depth, token: seen.append(tail) or found(self, tokens, tail, depth, token))
    some = ["international", "internationally", "internal", "interned"]
    ids = trie.encode_words(some)
    nodes = {w[:n] for w in some for n in range(1, len(w) + 1)}
    assert len(seen) == len({n for n in nodes if any(w != n and w.startswith(n) for w in some)}) + len(some)
    assert set(ids) == set(some)


def test_trie_query(spark, words):
    got = trie_bpe.digests(frame(spark).repartition(3), WORDS)
    wanted = []
    for doc_id, text, *_ in rows():
        ids = words.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(words.decode(ids, skip_special_tokens=False))))
    assert collected(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(wanted, key=repr)
    assert trie_bpe.digests(frame(spark, []), WORDS).count() == 0


def test_trie_round_trip(spark, words):
    coded = trie_bpe.encoded(frame(spark), WORDS)
    texts = {r["doc_id"]: r["text"] for r in trie_bpe.decoded(coded, WORDS).collect()}
    assert texts[15] == words.decode(words.encode("é日本🎉 'll  x y​", add_special_tokens=False).ids, skip_special_tokens=False)


def test_trie_whole_table(spark, words):
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_trie_bpe"](spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = words.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]]["ids_sha256"] == sha(" ".join(map(str, ids)))


# --- alignment -------------------------------------------------------------------------

SPACED = ["a", " ", "a ", "a  b", "  a", "\n", "a\n b", "a\n  b \n", "▁", "a ▁b", "x▁ y", "<s> </s> <unk> <0x41>", " a", "\t a\x1c b", *ODD]


class Both:
    """The two libraries on whole texts, groups by walking along both."""

    def __init__(self):
        self.first = Tokenizer.from_file(FIRST)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
        self.a, self.b = alignment.first_bytes(FIRST), alignment.second_bytes(SECOND)

    def groups(self, text):
        if not text:
            return []
        a, b = self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text)
        spelt = (" " + text).encode()
        if b"".join(self.a[i] for i in a) != spelt or b"".join(self.b[i] for i in b) != spelt:
            return []
        out, one, two, end_a, end_b = [], [], [], 0, 0
        a, b = a[::-1], b[::-1]
        while a or b:
            if end_a <= end_b and a:
                one.append(a.pop())
                end_a += len(self.a[one[-1]])
            else:
                two.append(b.pop())
                end_b += len(self.b[two[-1]])
            if end_a == end_b:
                out.append((one, two))
                one, two = [], []
        return out


def written(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def brute_alignment(both, texts):
    """Rows of the query for (doc_id, text), from all pairs counted in one place."""
    found = [(i, both.groups(t)) for i, t in texts]
    counts = Counter((a[-1], b[-1]) for _, g in found for a, b in g)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    out = []
    for i, g in found:
        pairs = [(a[-1], b[-1]) for a, b in g]
        out.append(
            (i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(pairs), sum(counts[p] == top[p[1]] for p in pairs),
             sum(counts[p] for p in pairs), sha(written(g)) if g else "")
        )
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def both():
    return Both()


def test_pieces_equal_libraries(both):
    align = alignment.Aligner(FIRST, SECOND, remembered=300)
    rng = random.Random(1)
    texts = list(SPACED)
    for alphabet in ("abehinst'., \n\t12é日😀▁<>|", "ab  ", "".join(map(chr, range(1, 0x700)))):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(2000)]
    for at in range(0, len(texts), 500):
        for text, pieces in zip(texts[at : at + 500], align.of_texts(texts[at : at + 500]), strict=True):
            assert ";".join(p[0] for p in pieces) == written(both.groups(text)), text


def test_pointer_jumping():
    """Terminals are the components of the overlap graph, also for long chains."""
    rng = random.Random(3)
    for size in (1, 2, 50, 4000):
        a = sorted({*rng.sample(range(1, 3 * size + 1), size), 3 * size + 1})
        b = sorted({*rng.sample(range(1, 3 * size + 1), size), 3 * size + 1})
        got = alignment.terminals(np.array(a), np.array(b))
        common = sorted(set(a) & set(b))
        for tokens, labels in ((a, got[: len(a)]), (b, got[len(a) :])):
            assert [a[t] for t in labels] == [min(c for c in common if c >= e) for e in tokens]
    chain = np.arange(2, 20_001, 2), np.append(np.arange(1, 20_000, 2), 20_000)
    assert set(alignment.terminals(*chain).tolist()) == {9_999}


def test_alignment_query(spark, both):
    df = frame(spark).union(frame(spark, [(100 + n, t, *["x"] * 2, 0, -1, "x", 7, 3, "k", "b", "c", 1, 2, "d", "e", False) for n, t in enumerate(SPACED)]))
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = alignment.align(df.repartition(3), FIRST, SECOND)
    assert collected(got, *COLUMNS) == brute_alignment(both, texts)
    assert alignment.align(frame(spark, []), FIRST, SECOND).count() == 0


def test_alignment_groups(spark, both):
    for r in alignment.groups(frame(spark), FIRST, SECOND).collect():
        if r["doc_id"] in (8, 9, 15, 18):
            text = {i: t for i, t, *_ in rows()}[r["doc_id"]]
            assert [(list(g.a), list(g.b)) for g in r["groups"]] == both.groups(text)


def test_alignment_whole_table(spark, both, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    wanted = brute_alignment(both, docs)
    assert collected(queries.QUERIES["op11_token_alignment"](spark, DIR), *COLUMNS) == wanted
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 0)
    assert collected(queries.QUERIES["op11_token_alignment"](spark, DIR), *COLUMNS) == wanted


def test_pair_bound(spark):
    linked = alignment.links(spark.read.parquet(f"{DIR}/documents.parquet"), FIRST, SECOND)
    assert 0 < alignment.pair_counts(linked).count() <= alignment.pair_bound(FIRST, SECOND)
