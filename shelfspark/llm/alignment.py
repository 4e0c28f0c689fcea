"""Groups of tokens that two tokenizers cut at the same bytes, found by pointer jumping.

Both token sequences of a text cover the same bytes. Every token points to its
farthest-right overlapping token: the token of the other sequence that holds its
last byte, if that one ends further right; tokens that end together point to the
first sequence's token, which points to itself. The pointers of all new pieces of
a batch stand in one array, and the array is replaced by the pointers of its
pointers until nothing changes: a chain of n tokens takes log2(n) rounds. Then
every token holds the terminal token of its component, which labels its group;
the group's two last tokens end together and are a link.

Counts of linked pairs of ids are one grouped aggregate over the whole corpus. Of
two linked tokens the shorter one's bytes end the longer one's, so the table has
at most one row for each such pair of the two vocabularies (``pair_bound``), whatever
the size of the corpus; below ``BROADCAST_ROWS`` it is broadcast to the documents'
links, beyond it joined by shuffle.

Both tokenizers have a border before every space that follows a character other
than white space, so a task aligns pieces between such borders and remembers
those it has seen in a memory of fixed size.

Results for odd input: null and empty texts, and those whose tokens do not spell a
space and the text (one with U+2581, which the second tokenizer reads as a space),
have no tokens: zeros and the empty string. Repeated rows are counted, and each
gets a row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfspark.llm.byte_bpe import Memo
from shelfspark.llm.rows import texts
from shelfspark.llm.trie_bpe import byte_letters
from shelfspark.runtime import cut_lineage

REMEMBERED = 150_000
#: Longer pieces are not remembered.
_LONG = 64
#: Bits of a second id in a pair's code.
_BITS = 20
#: Texts whose new pieces are aligned together.
TOGETHER = 1024
#: Pair tables of at most so many rows (24 bytes each) are broadcast.
BROADCAST_ROWS = 2_000_000


def first_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each entry of a byte-level vocabulary."""
    byte_of = {letter: b for b, letter in byte_letters().items()}
    vocabulary = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    return {i: bytes(map(byte_of.__getitem__, token)) for token, i in vocabulary.items()}


def second_bytes(path: str) -> list[bytes]:
    """The bytes of each piece: U+2581 as a space, byte pieces as their byte."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return [
        bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
        for i in range(pieces.get_piece_size())
    ]


def pair_bound(first: str, second: str) -> int:
    """How many pairs of ids can be linked at all: one's bytes end the other's."""
    a, b = Counter(first_bytes(first).values()), Counter(second_bytes(second))
    longer = sum(n * b[t[at:]] for t, n in a.items() for at in range(len(t)))
    return longer + sum(n * a[t[at:]] for t, n in b.items() for at in range(1, len(t)))


def terminals(first_ends: np.ndarray, second_ends: np.ndarray) -> np.ndarray:
    """The terminal token of every token, first sequence before second; both arrays of ends ascend to the same last one."""
    n = len(first_ends)
    over_first = np.searchsorted(second_ends, first_ends)
    own = np.arange(n)
    to = np.concatenate([np.where(second_ends[over_first] == first_ends, own, n + over_first), np.searchsorted(first_ends, second_ends)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


#: groups as text, tokens of both, groups, codes of links; None for a piece that its tokens do not spell.
Piece = tuple[str, int, int, int, bytes] | None


class Aligner:
    """Both tokenizers, and the pieces seen lately."""

    def __init__(self, first: str, second: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = SentencePieceProcessor(model_file=second)
        self.first_bytes, self.second_bytes = first_bytes(first), second_bytes(second)
        self.first_size = np.zeros(max(self.first_bytes) + 1, np.int64)
        for i, t in self.first_bytes.items():
            self.first_size[i] = len(t)
        self.second_size = np.array([len(t) for t in self.second_bytes], np.int64)
        self.memo: Memo = Memo(remembered)

    def align(self, pieces: list[str]) -> dict[str, Piece]:
        """Each distinct piece behind a space."""
        a = [e.ids for e in self.first.encode_batch_fast([f" {p}" for p in pieces], add_special_tokens=False)]
        b = self.second.encode(pieces, num_threads=1)
        out: dict[str, Piece] = {}
        good = []
        for n, piece in enumerate(pieces):
            spelt = f" {piece}".encode()
            if b"".join(map(self.first_bytes.__getitem__, a[n])) == spelt == b"".join(map(self.second_bytes.__getitem__, b[n])):
                good.append(n)
            else:
                out[piece] = None
        if not good:
            return out
        ids_a = np.fromiter(chain.from_iterable(a[n] for n in good), np.int64)
        ids_b = np.fromiter(chain.from_iterable(b[n] for n in good), np.int64)
        ends_a, ends_b = self.first_size[ids_a].cumsum(), self.second_size[ids_b].cumsum()
        last = np.unique(terminals(ends_a, ends_b))
        partner = np.searchsorted(ends_b, ends_a[last])
        codes = ids_a[last] << _BITS | ids_b[partner]
        # groups of a piece: those whose last token lies in it
        upto = np.searchsorted(last, np.cumsum([len(a[n]) for n in good]))
        cuts_a, cuts_b, upto = (last + 1).tolist(), (partner + 1).tolist(), upto.tolist()
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        group = at_a = at_b = 0
        for n, end in zip(good, upto, strict=True):
            said, begun = [], group
            while group < end:
                to_a, to_b = cuts_a[group], cuts_b[group]
                said.append(f"{','.join(text_a[at_a:to_a])}|{','.join(text_b[at_b:to_b])}")
                at_a, at_b = to_a, to_b
                group += 1
            out[pieces[n]] = ";".join(said), len(a[n]), len(b[n]), end - begun, codes[begun:end].tobytes()
        return out

    def of_texts(self, some: list[str]) -> list[list[tuple[str, int, int, int, bytes]]]:
        """The aligned pieces of each text; none for a text without tokens."""
        get = self.memo.young.get
        split = [text.split(" ") if text else [] for text in some]
        found = [list(map(get, parts)) for parts in split]
        missing: set[str] = set()
        for n, parts in enumerate(split):
            if None in found[n]:
                new = [p for p, known in zip(parts, found[n], strict=True) if known is None]
                if not all(new) or any(p[-1].isspace() for p in new):
                    split[n] = parts = _joined(parts)
                    found[n] = list(map(get, parts))
                    new = [p for p, known in zip(parts, found[n], strict=True) if known is None]
                missing.update(new)
        known = {p: entry for p in missing if (entry := self.memo.old.get(p)) is not None}
        known.update(self.align([p for p in missing if p not in known]))
        for piece, entry in known.items():
            if entry is not None and len(piece) <= _LONG and not piece[-1:].isspace() and piece:
                self.memo.put(piece, entry)
        out = []
        for parts, entries in zip(split, found, strict=True):
            if None in entries:
                entries = [known[p] if e is None else e for p, e in zip(parts, entries, strict=True)]
            out.append([] if None in entries else entries)
        return out


def _joined(parts: list[str]) -> list[str]:
    """Parts between spaces, put together again where what stands before a space is white space."""
    out = parts[:1]
    for part in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(part)
        else:
            out[-1] += f" {part}"
    # a last space alone would be an empty text to the second tokenizer, which puts no space before that
    return [*out[:-2], f"{out[-2]} "] if len(out) > 1 and not out[-1] else out


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """The aligner of two files, built once in each Python worker."""
    if (first, second) not in _loaded:
        _loaded[first, second] = Aligner(first, second)
    return _loaded[first, second]


_LINKS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
     ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
)


def groups(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, groups: the ids of both tokenizers in each group, in order."""
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(first, second)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                out = []
                for pieces in align.of_texts(part.column(1).to_pylist()):
                    halves = [g.split("|") for p in pieces for g in p[0].split(";")]
                    out.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in halves])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["doc_id", "groups"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def links(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts, the digest of its groups, and its linked pairs with how often each is linked in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(first, second)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found = align.of_texts(part.column(1).to_pylist())
                digest, pairs, times = [], [], []
                for pieces in found:
                    digest.append(hashlib.sha256(";".join([p[0] for p in pieces]).encode()).hexdigest() if pieces else "")
                    code, n = np.unique(np.frombuffer(b"".join([p[4] for p in pieces]), np.int64), return_counts=True)
                    pairs.append(code)
                    times.append(n)
                offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                columns = [
                    part.column(0), *(pa.array([sum(p[k] for p in pieces) for pieces in found], pa.int64()) for k in (1, 2, 3)), pa.array(digest, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs), pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times), pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    return texts(docs, id_col, text_col).mapInArrow(run, _LINKS)


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, count of the corpus, and whether the count is the highest of b."""
    each = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = each.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("count"))
    b = F.col("pair").bitwiseAND((1 << _BITS) - 1)
    split = counts.select("pair", F.shiftright("pair", _BITS).alias("a"), b.alias("b"), "count")
    return split.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    linked = cut_lineage(links(docs, first, second, id_col, text_col), "links")
    counts = cut_lineage(pair_counts(linked), "pairs").select("pair", "count", "best")
    if pair_bound(first, second) <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    rows = linked.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", F.explode_outer(F.arrays_zip("pairs", "times")).alias("l"))
    met = each.withColumns({"pair": F.col("l.pairs"), "n": F.col("l.times").cast("long")}).join(counts, "pair", "left")
    sums = {
        "n_links": F.sum("n"),
        "n_best": F.sum(F.when(F.col("best"), F.col("n"))),
        "count_sum": F.sum(F.col("n") * F.col("count")),
    }
    # the rows of a document stand together, so that a task sends one row for each
    found = met.groupBy("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").agg(*[F.coalesce(e, F.lit(0)).alias(c) for c, e in sums.items()])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
