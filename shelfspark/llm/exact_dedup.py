"""Exact duplicates by Patricia tries of owners.

A task first inserts its own texts into a compressed radix trie, whose terminal
nodes hold the smallest owner and the number of copies seen. So of a text that
fills a third of the table each task passes on one terminal, not its copies.
Terminals are then partitioned by length and content hash and inserted as full
byte strings into the tries of their partitions, which decide on bytes, not on
hashes. A trie that outgrows its limit (labels, nodes and owners) gives up its heaviest
subtrees: their terminals are written out and meet the others in the second step, so the limit
changes the memory, not the result.

Results for odd input: null text counts as empty, and empty texts are copies of
each other. Of rows with the same smallest id (repeated rows) one is kept. A
null id is larger than every other id; where all ids of a group are null, one
row is kept and ``keep_id`` is null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfspark.llm.rows import text_bytes, texts
from shelfspark.runtime import cut_lineage

TRIE_BYTES = 16 << 20
#: What a node (with its table of children) and an owner take beside the label, measured on short random texts.
NODE_BYTES, OWNER_BYTES = 250, 350
_LAST = (1, 0)  # a missing id sorts behind every other


class Node:
    """An edge label, the children by first byte, and the owner if a text ends here."""

    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner: Owner | None = None) -> None:
        self.label, self.children, self.owner = label, {}, owner


class Owner:
    """The smallest (id is null, id, row) of a text, its copies, and what it stands for."""

    __slots__ = ("best", "count", "first", "n_bytes", "digest", "members")

    def __init__(self, best: tuple, count: int, first: int, n_bytes: int, digest: bytes) -> None:
        self.best, self.count, self.first, self.n_bytes, self.digest, self.members = best, count, first, n_bytes, digest, [first]


class PatriciaTrie:
    def __init__(self) -> None:
        self.root, self.held = Node(b""), 0

    def find(self, text: bytes, make: Owner) -> Owner:
        """The owner of ``text``; ``make`` where there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], make)
                self.held += len(text) - at + NODE_BYTES + OWNER_BYTES
                return make
            rest = text[at : at + len(child.label)]
            if rest != child.label:
                shared = len(os.path.commonprefix([rest, child.label])) if len(rest) < 64 else _shared(rest, child.label)
                upper = Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = upper
                child = upper
                self.held += NODE_BYTES
            node, at = child, at + len(child.label)
        if node.owner is None:
            node.owner = make
            self.held += OWNER_BYTES
        return node.owner

    def cut(self, upto: int = 0) -> Iterator[tuple[bytes, Owner]]:
        """Take the heaviest subtrees below the root out until at most ``upto`` bytes are held; give their texts and owners."""
        weights = {first: _weight(child) for first, child in self.root.children.items()}
        for first in sorted(weights, key=weights.__getitem__, reverse=True):
            if self.held <= upto:
                return
            self.held -= weights[first]
            yield from _terminals(self.root.children.pop(first), b"")
        if self.held > upto and self.root.owner is not None:
            owner, self.root.owner = self.root.owner, None
            self.held -= OWNER_BYTES
            yield b"", owner

    def drain(self) -> Iterator[tuple[bytes, Owner]]:
        root, self.root, self.held = self.root, Node(b""), 0
        yield from _terminals(root, b"")


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _weight(top: Node) -> int:
    total, open_nodes = 0, [top]
    while open_nodes:
        node = open_nodes.pop()
        total += len(node.label) + NODE_BYTES + (OWNER_BYTES if node.owner is not None else 0)
        open_nodes += node.children.values()
    return total


def _terminals(top: Node, before: bytes) -> Iterator[tuple[bytes, Owner]]:
    open_nodes = [(top, before)]
    while open_nodes:
        node, path = open_nodes.pop()
        path += node.label
        if node.owner is not None:
            yield path, node.owner
        open_nodes += [(child, path) for child in node.children.values()]


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    out = b" ".join(words)
    return (b" " if text[:1].isspace() else b"") + out + (b" " if text[-1:].isspace() else b"")


_LOCAL = (
    "doc_id long, row long, rep long, raw_sha256 binary, "
    "own_rep long, n_bytes long, digest binary, text binary, best_null int, best_id long, best_row long, copies long"
)
_LOCAL_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "row", "rep")] + [("raw_sha256", pa.binary()), ("own_rep", pa.int64()), ("n_bytes", pa.int64())]
    + [("digest", pa.binary()), ("text", pa.binary()), ("best_null", pa.int32())] + [(n, pa.int64()) for n in ("best_id", "best_row", "copies")]
)


def _batch(schema: pa.Schema, columns: dict[str, list], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def _owners_out(found: list[tuple[bytes, Owner]]) -> pa.RecordBatch:
    owners = [o for _, o in found]
    return _batch(
        _LOCAL_ARROW,
        {
            "own_rep": [o.first for o in owners], "n_bytes": [o.n_bytes for o in owners], "digest": [o.digest for o in owners],
            "text": [t for t, _ in found], "best_null": [o.best[0] for o in owners], "best_id": [o.best[1] for o in owners],
            "best_row": [o.best[2] for o in owners], "copies": [o.count for o in owners],
        },
        len(found),
    )


def _in_parts(found: Iterator[tuple[bytes, Owner]], most: int = 4 << 20) -> Iterator[list[tuple[bytes, Owner]]]:
    part, size = [], 0
    for text, owner in found:
        part.append((text, owner))
        size += len(text) + 100
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _local(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            reps, raws = [], []
            for doc_id, row, raw in zip(ids, rows, text_bytes(batch.column(1)), strict=True):
                text = normalised(raw)
                mine = (*(_LAST if doc_id is None else (0, doc_id)), row)
                fresh = Owner(mine, 0, row, len(text), hashlib.sha256(text).digest())
                owner = trie.find(text, fresh)
                owner.count += 1
                owner.best = min(owner.best, mine)
                reps.append(owner.first)
                raws.append(fresh.digest if raw == text else hashlib.sha256(raw).digest())
                if trie.held > limit:
                    for part in _in_parts(trie.cut(limit // 2)):
                        yield _owners_out(part)
            yield _batch(_LOCAL_ARROW, {"doc_id": ids, "row": rows, "rep": reps, "raw_sha256": raws}, len(ids))
        for part in _in_parts(trie.drain()):
            yield _owners_out(part)

    return run


_MERGED = "rep long, keep_id long, keep_row long, group_size long, digest binary"
_MERGED_ARROW = pa.schema([(n, pa.int64()) for n in ("rep", "keep_id", "keep_row", "group_size")] + [("digest", pa.binary())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terminals in order of (length, hash): a trie is complete, and given up, when its key is over."""

    def out() -> pa.RecordBatch:
        lines = [(m, None if o.best[0] else o.best[1], o.best[2], o.count, o.digest) for _, o in trie.drain() for m in o.members]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), _MERGED_ARROW, strict=True)], schema=_MERGED_ARROW)

    trie, key = PatriciaTrie(), None
    done: list[pa.RecordBatch] = []
    for batch in batches:
        for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rep, n_bytes, digest, text, null, doc_id, row, copies = line
            if (n_bytes, digest) != key:
                if key is not None:
                    done.append(out())
                    if len(done) >= 2000:
                        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                        done = []
                key = (n_bytes, digest)
            fresh = Owner((null, doc_id, row), 0, rep, n_bytes, digest)
            owner = trie.find(text, fresh)
            owner.count += copies
            owner.best = min(owner.best, fresh.best)
            if owner is not fresh:
                owner.members.append(rep)
    if key is not None:
        done.append(out())
    if done:
        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), raw_sha256 (of the text as it is)."""
    rows = texts(docs, id_col, text_col, F.monotonically_increasing_id().alias("row"))
    local = cut_lineage(rows.mapInArrow(_local(trie_bytes), _LOCAL), "trie")
    terminals = local.filter("own_rep is not null").select(
        "own_rep", "n_bytes", "digest", "text", "best_null", "best_id", "best_row", "copies"
    )
    merged = (
        terminals.repartition("n_bytes", "digest").sortWithinPartitions("n_bytes", "digest").mapInArrow(_merge, _MERGED)
    )
    members = local.filter("rep is not null").select("doc_id", "row", "rep", "raw_sha256")
    return members.join(merged, "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.lower(F.hex("raw_sha256")).alias("raw_sha256"),
    )
