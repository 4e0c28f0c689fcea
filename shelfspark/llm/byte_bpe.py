"""Byte-level BPE by backtracking over longest matches.

The bytes of a piece are read as Latin-1 letters, so that the trie of an
Aho-Corasick automaton over all tokens finds the longest token that starts at a
position. Encoding goes forward with longest matches; a token is accepted if
it may follow the one before it, else its next shorter prefix is tried, else the
last token is taken back and its position marked as a dead end. Every position
is marked once at most, so the time is linear in the piece. Two tokens are
compatible if merging by rank would never join bytes across their border; that
is found by taking both apart in the order of their ranks, and memoised. The
result equals the merges exactly: a token sequence whose neighbours are all
compatible is unique.

A task splits a text at single spaces between other characters, where the
pattern always has a border, and remembers the ids of the chunks it has seen;
the memory has a fixed size and forgets the older half.

Results for odd input: a null text counts as empty; an empty text has 0 tokens,
and both digests are those of the empty string. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shelfspark.llm.rows import texts

REMEMBERED = 400_000
#: Letters below this one are letters in every version of Unicode, so that a chunk of them is one match of the pattern.
_LATIN = "\u0250"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line per token, base64 and rank."""
    lines = Path(path).read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Memo:
    """A dictionary of two generations, each of at most ``size`` entries."""

    __slots__ = ("young", "old", "size")

    def __init__(self, size: int) -> None:
        self.young, self.old, self.size = {}, {}, size

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class ByteBpe:
    """Encoder and decoder of one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.pattern = regex.compile(pattern)
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.split = {rank: self._halves(token.decode("latin-1"), rank) for token, rank in ranks.items()}
        reachable = {token: rank for token, rank in self.ids.items() if len(token) == 1 or self.split[rank]}
        self.joined = {halves: rank for rank, halves in self.split.items() if halves}
        self.automaton = ahocorasick.Automaton()
        for token, rank in reachable.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.most = max(map(len, reachable), default=0)
        self.comma = {mark: f" {self.ids[mark]}" for mark in ",." if mark in self.ids}
        self.shorter = {rank: self._prefix(token, reachable) for token, rank in reachable.items()}
        self.fits: Memo = Memo(remembered)
        self.chunks: Memo = Memo(remembered)
        self.text_of = {str(rank): token for rank, token in self.bytes_of.items()}

    def _halves(self, token: str, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and for tokens that no merge reaches."""
        parts = list(token)
        while len(parts) > 1:
            ranks = [self.ids.get(a + b, rank + 1) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == rank and len(parts) == 2:
                return self.ids[parts[0]], self.ids[parts[1]]
            if least >= rank:
                return None
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    @staticmethod
    def _prefix(token: str, tokens: dict[str, int]) -> int | None:
        return next((tokens[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in tokens), None)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes leave the border between them."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self._compatible(left, right)
            self.fits.put(key, known)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        below = 1 << 60  # merges of this rank or later no longer happen in what is left
        joined, split = self.joined, self.split
        while True:
            if joined.get((left, right), below) < below:
                return False
            # undo the later of the two merges: before it, the border had its half as neighbour
            a, b = split[left], split[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                below, left = left, a[1]
            else:
                # of equal ranks the left one merges first
                below, right = right + 1, b[0]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern."""
        text = piece.encode().decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        size = len(text)
        length, known, shorter = self.length, self.fits.young, self.shorter
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, self._longest(text, 0)
        while at < size:
            end = at + length[token]
            if end not in dead:
                fits = known.get((out[-1], token)) if out else True
                if fits is None:
                    fits = self.compatible(out[-1], token)
                    known = self.fits.young
                if fits:
                    out.append(token)
                    at = end
                    if at < size:
                        token = self._longest(text, at)
                    continue
            if shorter[token] is not None:
                token = shorter[token]
            else:
                # nothing can follow here: the token before ends in a dead end, and the loop tries its prefixes
                dead.add(at)
                token = out.pop()
                at -= length[token]
        return out

    def _longest(self, text: str, at: int) -> int:
        """The longest token that starts at ``at``: the automaton's longest path there, or its longest prefix that is a token."""
        part = text[at : at + self.most]
        n = self.automaton.longest_prefix(part)
        ids = self.ids
        while (token := ids.get(part[:n])) is None or token not in self.shorter:
            n -= 1
        return token

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece)]

    def _chunk(self, chunk: str) -> str:
        return " ".join(map(str, self.encode(chunk)))

    def _known(self, part: str) -> str:
        """Ids of a space and ``part``."""
        ids = self.chunks.get(part)
        if ids is None:
            if part[-1] in self.comma and part[:-1].isalpha() and max(part) < _LATIN:
                ids = self._known(part[:-1]) + self.comma[part[-1]]
            elif part.isalpha() and max(part) < _LATIN:
                ids = " ".join(map(str, self.encode_piece(" " + part)))
            else:
                ids = self._chunk(" " + part)
            self.chunks.put(part, ids)
        return ids

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by spaces, chunk by chunk.

        The pattern has a border before every single space between two characters
        that are not white space; other spaces stay inside their chunk.
        """
        parts = text.split(" ")
        out = list(map(self.chunks.young.get, parts))
        out[0] = None
        for i, ids in enumerate(out):
            if ids is None:
                part = parts[i]
                if not part or part[0].isspace() or part[-1].isspace():
                    return " ".join(filter(None, self._spaced(parts)))
                out[i] = self._known(part) if i else self._chunk(part)
        return " ".join(out)

    def _spaced(self, parts: list[str]) -> Iterator[str]:
        """The same for a text with other white space next to a space."""
        chunk: list[str] = parts[:1]
        for before, part in zip(parts, parts[1:]):
            if before and part and not before[-1].isspace() and not part[0].isspace():
                yield self._chunk(" ".join(chunk))
                chunk = ["", part]
            else:
                chunk.append(part)
        yield self._chunk(" ".join(chunk))

    def decode(self, ids: str) -> bytes:
        """Bytes of decimal ids joined by spaces."""
        return b"".join(map(self.text_of.__getitem__, ids.split(" "))) if ids else b""


_COLUMNS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_loaded: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The coder of a rank file, built once in each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode_text(text)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ids_sha), pa.array(decoded_sha)], schema=_ARROW)

    return texts(docs, id_col, text_col).mapInArrow(run, _COLUMNS)


def bpe_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the encoded texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for n in range(0, batch.num_rows, 512):
                part = batch.slice(n, 512)
                ids = [list(map(int, bpe.encode_text(t).split())) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_texts(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            out = [b"".join(bpe.bytes_of[i] for i in ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
