"""BPE with word ends, encoded along a trie of the distinct words.

The encoding of a word's prefix ends in exactly one token, and what stands before
that token is the encoding of a shorter prefix. So the state of a trie node is
its last token: the one suffix of the node's path that is a token and may follow
the last token of the node where it starts. A walk through the trie, depth first,
finds that state once for every prefix, however many words share it; a word's ids
are read back along these links.

Two tokens may stand next to each other if no merge joins bytes across their
border before the tokens are complete. Only the right edge of the left token and
the left edge of the right one can take part: the symbols on these edges, each
with the rank at which it disappears into the next, are listed for every token
when the file is read, and the answer for a pair is remembered.

Normalisation and the cut into words are those of the tokenizer's own parts, for
each piece between ASCII white space, where this kind of tokenizer always has a
border. Strings of special tokens inside a text become the special token, which
is the library's default. A task remembers the ids of the pieces it has seen in
a memory of fixed size; a trie holds the new words of one Arrow batch.

Decoding follows the file: it names no decoder, so that the tokens are joined by
one space.

Results for odd input: a null text counts as empty; an empty text, or one of white
space, has 0 tokens and both digests of the empty string. Repeated rows give
repeated rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shelfspark.llm.byte_bpe import Memo
from shelfspark.llm.rows import text_bytes, texts

REMEMBERED = 300_000
_LATE = 1 << 60
#: Longer pieces and words are not remembered.
_LONG = 64
#: Letters below this one are letters in every version of Unicode and already composed.
_LATIN = "\u0250"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 for itself, then letters from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(odd)}


class TrieBpe:
    """Encoder and decoder of one tokenizer file whose model is BPE with an end-of-word suffix."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a BPE with word ends and without decoder")
        library = Tokenizer.from_file(path)
        self.normal, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: str(t["id"]) for t in spec["added_tokens"]}
        self.letter_of = byte_letters()
        self.special_at = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        self.rank = {(ids[a], ids[b]): n for n, (a, b) in enumerate(pairs)}
        self.token_of = {str(i): t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        made = {ids[a + b]: (ids[a], ids[b], n) for n, (a, b) in enumerate(pairs)}
        # edges: (symbol, rank at which it disappears), from the token inwards
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.middle: dict[str, int] = {}
        self.end: dict[str, int] = {}
        self.fits: Memo = Memo(remembered)
        self.pieces: Memo = Memo(remembered)
        self.words: Memo = Memo(remembered)
        suffix = model["end_of_word_suffix"]
        whole = {i for i in ids.values() if i not in made}
        for i in whole:
            self.right[i] = self.left[i] = [(i, _LATE)]
        for i, (a, b, n) in made.items():
            # merges are listed after those that make their parts
            self.right[i] = [(i, _LATE), (b, n), *self.right[b][1:]]
            self.left[i] = [(i, _LATE), (a, n), *self.left[a][1:]]
            if a in whole and b in whole and self._apart(a, b, n):
                whole.add(i)
        for token, i in ids.items():
            if i in whole:
                if token.endswith(suffix):
                    self.end[token.removesuffix(suffix)] = i
                else:
                    self.middle[token] = i
        self.most = max(map(len, [*self.middle, *self.end]), default=1)

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether no merge below rank ``until`` crosses the border of two complete tokens.

        At equal ranks the merge further left comes first, so that the left
        token's own merges win and the right token's lose.
        """
        rank = self.rank
        for x, gone in self.right[left]:
            for y, lost in self.left[right]:
                n = rank.get((x, y))
                if n is not None and n < until and n < gone and n <= lost:
                    return False
        return True

    def may_follow(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            known = self._apart(left, right, _LATE)
            self.fits.put((left, right), known)
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word, the encodings of shared prefixes computed once."""
        root: dict = {}
        for word in words:
            node = root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = word
        out: dict[str, list[int]] = {}
        token, start = [-1], [0]  # of each depth of the path: its last token, and the depth where that starts
        walk = [(child, 1, letter) for letter, child in root.items()]
        most, last = self.most, self._last
        while walk:
            node, depth, tail = walk.pop()
            word = node.pop("", None)
            if word is not None:
                i, at = last(self.end, tail, depth, token)
                found = [i]
                while at:
                    found.append(token[at])
                    at = start[at]
                out[word] = found[::-1]
            if node:
                del token[depth:], start[depth:]
                i, at = last(self.middle, tail, depth, token)
                token.append(i)
                start.append(at)
                depth += 1
                walk += [(child, depth, (tail + letter)[-most:]) for letter, child in node.items()]
        return out

    def _last(self, tokens: dict[str, int], tail: str, depth: int, token: list[int]) -> tuple[int, int]:
        """The last token of the path that ends in ``tail``, and the depth where it starts."""
        known = self.fits.young
        at = depth - len(tail)
        while tail:
            i = tokens.get(tail)
            if i is not None:
                if not at:
                    return i, 0
                fits = known.get((token[at], i))
                if fits is None:
                    fits = self.may_follow(token[at], i)
                if fits:
                    return i, at
            tail = tail[1:]
            at += 1
        raise ValueError("not a letter of the vocabulary")

    def _words(self, piece: str) -> list[str]:
        """Words of a piece without special tokens, in the letters of the vocabulary."""
        if max(piece) < _LATIN:
            # composed letters, which the pattern keeps together; one of them in lower case is a letter and a mark
            bare = piece[:-1] if piece[-1] in ".," else piece
            low = bare.lower()
            if low.isalpha() and bare.isalpha():
                return [self._letters(low), piece[-1]] if len(bare) < len(piece) else [self._letters(low)]
        return [w for w, _ in self.cut(self.normal(piece))]

    def _letters(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letter_of)

    def _parts(self, piece: str) -> list[str]:
        """Words and special tokens of a piece, in order."""
        if "<" not in piece:
            return self._words(piece)
        out, at = [], 0
        for m in self.special_at.finditer(piece):
            if at < m.start():
                out += self._words(piece[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._words(piece[at:]) if at < len(piece) else out

    def encode_texts(self, contents: list[bytes]) -> list[str]:
        """Decimal ids joined by spaces, for each text."""
        split = [c.split() for c in contents]
        young = self.pieces.young
        found = [list(map(young.get, pieces)) for pieces in split]
        missing = {p for pieces, ids in zip(split, found, strict=True) if None in ids for p, i in zip(pieces, ids, strict=True) if i is None}
        known = {p: ids for p in missing if (ids := self.pieces.old.get(p)) is not None}
        parts = {p: self._parts(p.decode()) for p in missing if p not in known}
        text: dict[str, str] = dict(self.special)
        unknown = set()
        for word in {w for words in parts.values() for w in words}.difference(text):
            ids = self.words.get(word)
            if ids is None:
                unknown.add(word)
            else:
                text[word] = ids
        for word, ids in self.encode_words(unknown).items():
            text[word] = " ".join(map(str, ids))
            if len(word) <= _LONG:
                self.words.put(word, text[word])
        for piece, words in parts.items():
            known[piece] = text[words[0]] if len(words) == 1 else " ".join(map(text.__getitem__, words))
        for piece, ids in known.items():
            if len(piece) <= _LONG:
                self.pieces.put(piece, ids)
        out = []
        for pieces, ids in zip(split, found, strict=True):
            if None in ids:
                ids = [known[p] if i is None else i for p, i in zip(pieces, ids, strict=True)]
            # a piece that normalisation empties has no ids
            out.append(" ".join(ids) if "" not in ids else " ".join(filter(None, ids)))
        return out

    def decode(self, ids: str) -> str:
        """Tokens of decimal ids joined by spaces."""
        return " ".join(map(self.token_of.__getitem__, ids.split(" "))) if ids else ""


_loaded: dict[str, TrieBpe] = {}


def coder(path: str) -> TrieBpe:
    """The coder of a tokenizer file, built once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = TrieBpe(path)
    return _loaded[path]


#: Texts that are encoded together: their new words share one trie.
TOGETHER = 2048


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                ids = [list(map(int, t.split())) for t in bpe.encode_texts(text_bytes(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            out = [bpe.decode(" ".join(map(str, i or ()))) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                coded = bpe.encode_texts(text_bytes(part.column(1)))
                columns = [
                    part.column(0),
                    pa.array([t.count(" ") + 1 if t else 0 for t in coded], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in coded]),
                    pa.array([hashlib.sha256(bpe.decode(t).encode()).hexdigest() for t in coded]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
