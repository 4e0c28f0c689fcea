"""Repeated byte strings across documents: suffix arrays with common-prefix intervals, partitioned by minimisers.

Every string of ``LENGTH`` bytes is named by its minimiser, the smallest hash
among its 16-byte substrings, so equal strings have equal names wherever they
stand. A run of neighbouring strings with one name is a window.

1. Texts are packed into blocks of a few MB, written once.
2. Each block compares its own documents: of equal windows it marks all but those
   of the smallest document, so a passage that fills a third of all documents
   costs one window for each block from here on. The names of the rest go to the
   bucket of the name, which tells each block the names that others have too.
3. Blocks send the windows with such names to the buckets. A bucket puts the
   windows of one name into an enhanced suffix array (suffixes of at least
   ``LENGTH`` bytes, sorted, with the common prefixes of neighbours; equal windows
   as one, with all their places). A stack scan finds its common-prefix
   intervals: each is a right-maximal repeat with all its occurrences. Those
   whose occurrences all stand behind the same byte are dropped, since the
   interval of the longer string has the same occurrences; the rest are maximal
   within their windows. In each group every occurrence in a document that is
   not the smallest is marked.
4. Marks return to their block, which removes the bytes.

Matches never cross documents, and no string is skipped: names decide where two
strings meet, bytes whether they are equal.

Results for odd input: a null text counts as empty; texts shorter than
``LENGTH`` lose nothing. Rows with equal ids do not count as smaller than each
other, so repeated rows lose the same bytes and nothing to each other. A null id
is larger than every other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from shelfspark.llm.minhash import mix, power_tables
from shelfspark.llm.rows import text_bytes, texts
from shelfspark.runtime import block_count, cut_lineage

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
PART_BYTES = 1 << 20  # windows of a bucket that are compared at a time: sorting takes many times their bytes
_CHUNK = 64  # starts of one window at most
_LAST = np.iinfo(np.int64).max  # stands for a missing id
_U = np.uint64


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros behind the end."""
    wide = np.concatenate([data, np.zeros(7, np.uint8)]).astype(_U)
    for n in (1, 2, 4):
        wide = wide[:-n] << _U(8 * n) | wide[n:]
    return wide


def minimisers(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each start of ``length`` bytes the smallest hash of the 16-byte strings inside."""
    words = _words(data)
    n = len(data) - gram + 1
    hashes = mix(words[:n] * _U(0x9E3779B97F4A7C15) ^ words[8 : 8 + n] * _U(0xC2B2AE3D27D4EB4F))
    span, done = length - gram + 1, 1
    while 2 * done <= span:
        hashes = np.minimum(hashes[:-done], hashes[done:])
        done *= 2
    return np.minimum(hashes[: len(data) - length + 1], hashes[span - done :])


def windows(docs: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Names, documents, starts and sizes (bytes) of all windows of some texts, with the joined bytes and each window's place in them."""
    data = np.frombuffer(b"".join(docs), np.uint8)
    offsets = np.cumsum([0, *map(len, docs)])
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(_U), none, none, none, data, none
    names = minimisers(data, length)
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(offsets))[: len(names)]
    valid = np.arange(len(names)) + length <= offsets[doc + 1]
    cut = np.flatnonzero(np.diff(names, prepend=~names[:1]).astype(bool) | np.diff(doc, prepend=-1).astype(bool) | np.diff(valid, prepend=False))
    sizes = np.diff(np.append(cut, len(names)))
    keep = valid[cut]
    cut, sizes = cut[keep], sizes[keep]
    # long runs (periodic text) in chunks
    parts = -(-sizes // _CHUNK)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(cut, parts) + nth * _CHUNK
    size = np.minimum(_CHUNK, np.repeat(sizes, parts) - nth * _CHUNK) + length - 1
    return names[at], doc[at].astype(np.int64), at - offsets[doc[at]], size, data, at


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    terms = data.astype(_U)
    terms += _U(1)
    terms *= up[: len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums, down


def _gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some parts, one after the other."""
    total = int(size.sum())
    kind = np.int32 if len(data) < 1 << 31 and total < 1 << 31 else np.int64
    index = np.repeat((at - (np.cumsum(size) - size)).astype(kind), size)
    index += np.arange(total, dtype=kind)
    return data[index]


def same_bytes(data: np.ndarray, at: np.ndarray, size: np.ndarray, names: np.ndarray) -> np.ndarray:
    """A number for each part, equal for equal bytes: hashes give the order, bytes decide."""
    sums, down = _sums(data)
    hashes = mix((sums[at + size] - sums[at]) * down[at]) ^ names
    order = np.lexsort((hashes, names))
    a, b = order[:-1], order[1:]
    alike = (hashes[a] == hashes[b]) & (names[a] == names[b]) & (size[a] == size[b])
    candidates = np.flatnonzero(alike)
    for first in range(0, len(candidates), 1 << 14):  # a few at a time: the indices take many times the bytes
        pair = candidates[first : first + (1 << 14)]
        owner = np.repeat(np.arange(len(pair)), size[a[pair]])
        differ = _gather(data, at[a[pair]], size[a[pair]]) != _gather(data, at[b[pair]], size[b[pair]])
        alike[pair[np.bincount(owner[differ], minlength=len(pair)) > 0]] = False
    group = np.zeros(len(at), np.int64)
    group[order] = np.cumsum(np.concatenate([[0], ~alike]))
    return group


def intervals(common: list[int], least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of a suffix array, by a stack scan.

    ``common[i]`` is the length of the prefix that suffixes i - 1 and i share.
    """
    out, stack = [], []
    for i, now in enumerate([*common, 0]):
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            out.append((length, first, i - 1))
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return out


def repeats(data: np.ndarray, at: np.ndarray, size: np.ndarray, names: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Maximal repeats among distinct windows with one name: group, window, offset, length of every occurrence."""
    starts = size - length + 1
    window = np.repeat(np.arange(len(at)), starts)
    offset = np.arange(len(window)) - np.repeat(np.cumsum(starts) - starts, starts)
    place = at[window] + offset
    left = size[window] - offset
    # a suffix whose first bytes no other has is in no interval: hashes leave it out before the sort
    sums, down = _sums(data)
    first = mix((sums[place + length] - sums[place]) * down[place]) ^ mix(names[window] + _U(1))
    ranked = np.argsort(first)
    again = first[ranked][1:] == first[ranked][:-1]
    twice = np.zeros(len(first), bool)
    twice[ranked[1:][again]] = twice[ranked[:-1][again]] = True
    window, offset, place, left = window[twice], offset[twice], place[twice], left[twice]
    words = _words(np.concatenate([data, np.zeros(_CHUNK + length + 8, np.uint8)]))
    # one key for each eight bytes, zeros behind the end of the window
    keys = []
    for k in range(0, _CHUNK + length, 8):
        rest = np.clip(left - k, 0, 8).astype(_U)
        part = words[np.minimum(place + k, len(words) - 1)]
        keys.append(np.where(rest == 0, _U(0), part >> (_U(64) - _U(8) * np.maximum(rest, _U(1))) << (_U(64) - _U(8) * np.maximum(rest, _U(1)))))
    order = np.lexsort((left, *keys[::-1], names[window]))
    a, b = order[:-1], order[1:]
    common = np.zeros(max(0, len(a)), np.int64)
    open_ = names[window[a]] == names[window[b]]
    for key in keys:
        differ = key[a] ^ key[b]
        high = np.frexp((differ >> _U(11)).astype(np.float64))[1] + 11
        high = np.where(differ >> _U(11) == 0, np.frexp(differ.astype(np.float64))[1], high)
        equal = np.where(differ == 0, 8, (64 - high) // 8)
        common += np.where(open_, equal, 0)
        open_ &= differ == 0
    common = np.minimum(common, np.minimum(left[a], left[b]))
    before = np.where(offset > 0, data[place - 1].astype(np.int64), -1)[order]
    near = np.flatnonzero(common >= length)
    groups, lines, sizes_of = [], [], []
    # the scan only meets neighbours that share enough; a gap closes all intervals
    run_starts = near[np.diff(near, prepend=-2) > 1] if len(near) else near
    run_ends = near[np.diff(near, append=len(common) + 1) > 1] if len(near) else near
    for first, last in zip(run_starts.tolist(), run_ends.tolist(), strict=True):
        for shared, i, j in intervals([0, *common[first : last + 1].tolist()], length):
            seen = before[first + i : first + j + 1]
            if seen[0] == -1 or (seen != seen[0]).any():
                lines.append(np.arange(first + i, first + j + 1))
                groups.append(len(groups))
                sizes_of.append(shared)
    if not lines:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    n = [len(x) for x in lines]
    found = order[np.concatenate(lines)]
    return np.repeat(groups, n), window[found], offset[found], np.repeat(sizes_of, n)


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    wide = doc.astype(np.float64)  # documents apart: ends grow within a document only
    base = np.concatenate([[0], np.cumsum(np.diff(wide) != 0)]).astype(np.int64)
    step = int(end.max()) + 2
    reach = np.maximum.accumulate(base * step + end)
    new = np.concatenate([[True], base[1:] * step + start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1] - base[at] * step


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    """Some arrays, compressed together."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return _zstd()[0].compress(head + b"".join(parts))


def _unpack(packed: bytes, *kinds: type) -> list[np.ndarray]:
    raw = _zstd()[1].decompress(packed)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(raw, k, s // np.dtype(k).itemsize, e - s) for s, e, k in zip(sizes.tolist(), ends.tolist(), kinds, strict=True)]


class Block:
    """Some documents with the windows that do not only repeat a smaller document of the block."""

    def __init__(self, packed: bytes, length: int) -> None:
        texts_, ends, self.ids = _unpack(packed, np.uint8, np.int64, np.int64)
        joined, starts = texts_.tobytes(), [0, *ends[:-1].tolist()]
        self.docs = [joined[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]
        names, self.doc, self.start, self.size, self.data, self.at = windows(self.docs, length)
        group = same_bytes(self.data, self.at, self.size, names) if len(names) else self.at
        least = np.full(int(group.max(initial=-1)) + 1, _LAST)
        np.minimum.at(least, group, self.ids[self.doc])
        later = self.ids[self.doc] > least[group]
        self.marks = self.doc[later], self.start[later], (self.start + self.size)[later]
        self.stay = np.flatnonzero(~later)
        self.names = names[self.stay]

    def by_bucket(self, buckets: int, chosen: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Bucket, windows, and the low halves of their names."""
        stay, names = self.stay, self.names
        if chosen is not None:
            stay, names = stay[chosen], names[chosen]
        if not len(stay):
            return
        target, low = bucket_of(names, buckets)
        order = np.argsort(target, kind="stable")
        bucket, first = np.unique(target[order], return_index=True)
        for b, part in zip(bucket.tolist(), np.split(order, first[1:]), strict=True):
            yield b, stay[part], low[part]


def bucket_of(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (names >> _U(32)).astype(np.int64) % buckets, (names & _U(0xFFFFFFFF)).astype(np.uint32)


_ROW = pa.schema([("bucket", pa.int64()), ("block", pa.string()), ("kind", pa.int32()), ("payload", pa.binary())])
_ROWS = "bucket long, block string, kind int, payload binary"
_TEXT, _NAMES, _WINDOWS, _MARKS = 9, 1, 2, 3  # texts come last among the rows of a block


def _rows(lines: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), _ROW, strict=True)], schema=_ROW)


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows of one key after the other; the rows must be in order of the key."""
    lines = (line for batch in batches for line in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(lines, key=lambda line: line[column])


def _pack_blocks(most: int):
    """Blocks of about ``most`` bytes, however large the Arrow batches are; a longer text is a block of its own."""

    def packed(docs: list[bytes], ids: list) -> pa.RecordBatch:
        numbers = np.array([_LAST if i is None else i for i in ids], np.int64)
        return _rows([(None, uuid.uuid4().hex, _TEXT, _pack(np.frombuffer(b"".join(docs), np.uint8), np.cumsum([len(d) for d in docs]), numbers))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, ids, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                docs.append(text)
                ids.append(doc_id)
                size += len(text)
                if size >= most:
                    yield packed(docs, ids)
                    docs, ids, size = [], [], 0
        if docs:
            yield packed(docs, ids)

    return run


def _send_names(buckets: int, length: int):
    """For each bucket the names of a block's windows, once each, and which of them several of its documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, uid, _, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block, lines = Block(packed, length), []
                for bucket, part, low in block.by_bucket(buckets):
                    owner = block.ids[block.doc[part]]
                    order = np.lexsort((owner, low))
                    low, owner = low[order], owner[order]
                    new = np.flatnonzero(np.diff(low, prepend=low[0] ^ np.uint32(1)))
                    several = np.minimum.reduceat(owner, new) < np.maximum.reduceat(owner, new)
                    lines.append((bucket, uid, _NAMES, _pack(np.diff(low[new], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T, several)))
                if lines:
                    yield _rows(lines)

    return run


def _shared_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's names those that another block has, or several documents of the block."""
    for bucket, lines in _grouped(batches, 0):
        uids, lows, flags = [], [], []
        for _, uid, _, payload in lines:
            planes, several = _unpack(payload, np.uint8, np.bool_)
            uids.append(uid)
            lows.append(np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32))
            flags.append(several)
        low, flag = np.concatenate(lows), np.concatenate(flags)
        owner = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
        order = np.argsort(low, kind="stable")
        again = np.diff(low[order], prepend=low[order[:1]] ^ np.uint32(1)) == 0
        shared = flag.copy()
        shared[order[again]] = True
        shared[order[:-1][again[1:]]] = True
        low, owner = low[shared], owner[shared]  # in order of the blocks
        if len(low):
            found, first = np.unique(owner, return_index=True)
            yield _rows([(bucket, uids[i], _NAMES, _pack(part)) for i, part in zip(found.tolist(), np.split(low, first[1:]), strict=True)])


def _send_windows(buckets: int, length: int):
    """The windows with shared names by bucket, and the marks of what the block alone decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, lines in _grouped(batches, 1):
            known, sent = {}, []
            for bucket, _, kind, payload in lines:
                if kind == _NAMES:
                    known[bucket] = _unpack(payload, np.uint32)[0]
                    continue
                block = Block(payload, length)
                doc, start, end = _spans(*block.marks)
                if len(doc):
                    sent.append((-1 - int(uid[:8], 16) % (4 * buckets), uid, _MARKS, _pack(doc, start, end)))
                for bucket, part, low in block.by_bucket(buckets):
                    if bucket in known:
                        mine = np.isin(low, known[bucket])
                        part, low = part[mine], low[mine]
                        docs, local = np.unique(block.doc[part], return_inverse=True)
                        sent.append((bucket, uid, _WINDOWS, _pack(
                            _gather(block.data, block.at[part], block.size[part]), block.size[part].astype(np.uint8), low,
                            local.astype(np.int32), block.start[part].astype(np.int32), docs.astype(np.int32), block.ids[docs],
                        )))
                if sent:
                    yield _rows(sent)

    return run


def _find(length: int):
    """Marks of what several blocks decide: all repeats among the windows of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, lines in _grouped(batches, 0):
            if bucket < 0:
                for line in lines:
                    yield _rows([line])
                continue
            uids, parts = [], []
            for _, uid, _, payload in lines:
                data, size, low, local, start, docs, ids = _unpack(payload, np.uint8, np.uint8, np.uint32, np.int32, np.int32, np.int32, np.int64)
                parts.append((data, size, low, docs[local], start, ids[local], np.full(len(size), len(uids), np.int32)))
                uids.append(uid)
            data, size, low, doc, start, owner, block = (np.concatenate(c) for c in zip(*parts, strict=True))
            del parts
            size = size.astype(np.int64)
            row, first, many = _marked_in_parts(data, np.cumsum(size) - size, size, low.astype(_U), owner, length)
            if not len(row):
                continue
            order = np.argsort(block[row], kind="stable")
            row, first, many = row[order], first[order], many[order]
            found, cut = np.unique(block[row], return_index=True)
            for i, part in zip(found.tolist(), np.split(np.arange(len(row)), cut[1:]), strict=True):
                begin = start[row[part]].astype(np.int64) + first[part]
                merged = _spans(doc[row[part]].astype(np.int64), begin, begin + many[part])
                yield _rows([(bucket, uids[i], _MARKS, _pack(*merged))])

    return run


def _marked(data: np.ndarray, at: np.ndarray, size: np.ndarray, names: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(window, offset, length) of every part of a window that also stands in a smaller document."""
    group = same_bytes(data, at, size, names)
    count = int(group.max()) + 1
    least = np.full(count, _LAST)
    np.minimum.at(least, group, owner)
    whole = np.flatnonzero(owner > least[group])
    first = np.zeros(count, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]  # a window for each group of equal ones
    # names with several different windows
    label, inverse = np.unique(names[first], return_inverse=True)
    several = first[np.bincount(inverse, minlength=len(label))[inverse] > 1]
    if not len(several):
        return whole, np.zeros(len(whole), np.int64), size[whole]
    repeat, window, offset, many = repeats(data, at[several], size[several], names[several], length)
    if not len(repeat):
        return whole, np.zeros(len(whole), np.int64), size[whole]
    kind = group[several[window]]
    smallest = np.full(int(repeat.max()) + 1, _LAST)
    np.minimum.at(smallest, repeat, least[kind])
    # every place of the window, not only the one in the array
    ordered = np.argsort(group, kind="stable")
    begin, places = np.searchsorted(group[ordered], kind), np.bincount(group, minlength=count)[kind]
    which = np.repeat(np.arange(len(kind)), places)
    row = ordered[np.repeat(begin, places) + np.arange(len(which)) - np.repeat(np.cumsum(places) - places, places)]
    hit = owner[row] > smallest[repeat[which]]
    row, which = row[hit], which[hit]
    return (
        np.concatenate([whole, row]), np.concatenate([np.zeros(len(whole), np.int64), offset[which]]), np.concatenate([size[whole], many[which]])
    )


def _marked_in_parts(
    data: np.ndarray, at: np.ndarray, size: np.ndarray, names: np.ndarray, owner: np.ndarray, length: int, most: int = PART_BYTES
) -> tuple[np.ndarray, ...]:
    """The bytes that ``_marked`` finds, overlapping ones as one, for names with about ``most`` bytes of windows at a time."""
    order = np.argsort(names, kind="stable")
    upto = np.concatenate([[0], np.cumsum(size[order])])
    heads = np.flatnonzero(np.diff(names[order], prepend=~names[order[:1]]))
    ends = np.append(heads[1:], len(order))
    found, i = [], 0
    while i < len(heads):
        done = upto[heads[i]]
        j = max(i + 1, int(np.searchsorted(upto[ends], done + most, side="right")))
        part = order[heads[i] : ends[j - 1]]
        if upto[ends[j - 1]] - done > most:  # one name
            row, first, many = _marked_strings(data, at[part], size[part], owner[part], length, most)
        else:
            sizes = size[part]
            row, first, many = _marked(_gather(data, at[part], sizes), np.cumsum(sizes) - sizes, sizes, names[part], owner[part], length)
            row, first, end = _spans(row, first, first + many)
            many = end - first
        found.append((part[row], first, many))
        i = j
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _marked_strings(data: np.ndarray, at: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int, most: int) -> tuple[np.ndarray, ...]:
    """As ``_marked`` for the windows of a frequent name, which share little but the name: their strings of ``length`` bytes in order of their hashes.

    Equal strings stand side by side, and bytes decide. A string takes 17 bytes of memory, whatever its place; all else is done in slices.
    """
    starts = size - length + 1
    begin = np.concatenate([[0], np.cumsum(starts)])
    hashes = np.empty(begin[-1], _U)
    step = max(1, most // int(size.max()))
    for w in range(0, len(at), step):
        sizes, many = size[w : w + step], starts[w : w + step]
        sums, down = _sums(_gather(data, at[w : w + step], sizes))
        place = np.repeat(np.cumsum(sizes) - sizes - (begin[w : w + len(many)] - begin[w]), many) + np.arange(many.sum())
        hashes[begin[w] : begin[w + len(many)]] = mix((sums[place + length] - sums[place]) * down[place])
    order, hit = np.argsort(hashes), np.zeros(len(hashes), bool)
    i = 0
    while i < len(order):
        j = min(len(order), i + (1 << 16))
        while j < len(order) and hashes[order[j]] == hashes[order[j - 1]]:  # equal hashes stay together
            other = hashes[order[j : j + (1 << 12)]] != hashes[order[j - 1]]
            j += int(other.argmax()) if other.any() else len(other)
        some = order[i:j]
        window = np.searchsorted(begin, some, side="right") - 1
        place = at[window] + some - begin[window]
        alike = hashes[some][1:] == hashes[some][:-1]
        candidates = np.flatnonzero(alike)
        for first in range(0, len(candidates), 1 << 14):
            pair = candidates[first : first + (1 << 14)]
            wide = np.full(len(pair), length)
            differ = _gather(data, place[pair], wide) != _gather(data, place[pair + 1], wide)
            alike[pair[differ.reshape(-1, length).any(axis=1)]] = False
        heads = np.flatnonzero(np.concatenate([[True], ~alike]))
        least = np.minimum.reduceat(owner[window], heads)
        hit[some[owner[window] > np.repeat(least, np.diff(np.append(heads, len(some))))]] = True
        i = j
    # neighbouring starts of a window as one
    window = np.repeat(np.arange(len(at), dtype=np.int32), starts)
    edge = np.concatenate([[True], window[1:] != window[:-1]])
    first = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
    last = np.flatnonzero(hit & ~np.concatenate([hit[1:] & ~edge[1:], [False]]))
    return window[first].astype(np.int64), first - begin[window[first]], last - first + length


_DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(length: int, with_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lines in _grouped(batches, 1):
            marks = []
            for _, _, kind, payload in lines:
                if kind == _MARKS:
                    marks.append(_unpack(payload, np.int64, np.int64, np.int64))
                    continue
                joined, ends, ids = _unpack(payload, np.uint8, np.int64, np.int64)
                begin = np.concatenate([[0], ends[:-1]])
                none = np.zeros(0, np.int64)
                doc, start, end = _spans(*(np.concatenate(c) for c in zip(*marks, strict=True))) if marks else (none, none, none)
                edge = np.zeros(len(joined) + 1, np.int32)
                np.add.at(edge, begin[doc] + start, 1)
                np.add.at(edge, begin[doc] + end, -1)
                stays = np.cumsum(edge[:-1]) == 0
                kept = [joined[a:b][stays[a:b]].tobytes() for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                sizes = ends - begin
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=ids == _LAST), pa.array(sizes), pa.array(sizes - np.array([len(k) for k in kept], np.int64)),
                        pa.array(np.bincount(doc, minlength=len(ids))), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                        pa.array(kept if with_texts else [None] * len(kept), pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the remaining bytes as ``kept``."""
    packed = cut_lineage(texts(docs, id_col, text_col).mapInArrow(_pack_blocks(BLOCK_BYTES), _ROWS), "blocks")
    written = docs.select(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    buckets = block_count(4 * written, BUCKET_BYTES)

    def by(df: DataFrame, *columns: str) -> DataFrame:
        return df.repartition(columns[0]).sortWithinPartitions(*columns)

    names = by(packed.mapInArrow(_send_names(buckets, length), _ROWS), "bucket").mapInArrow(_shared_names, _ROWS)
    sent = by(packed.union(names), "block", "kind").mapInArrow(_send_windows(buckets, length), _ROWS)
    marks = by(sent, "bucket").mapInArrow(_find(length), _ROWS)
    done = by(packed.union(marks), "block", "kind").mapInArrow(_remove(length, with_texts), _DONE)
    return done if with_texts else done.drop("kept")
