"""Near copies by BagMinHash signatures, bands and exact verification.

A text is the multiset of its shingles of five words. Each shingle has, for each
unit of weight, a Poisson process of points; a signature holds for each of its
places the smallest point that falls there. Two signatures agree in a place with
the probability of the weighted Jaccard similarity (overlap of the multisets
through their union). Weights are discretised as counts and lie in the intervals
[0, 1), [1, 2), [2, 4), [4, 8) ...; each interval has one process for its whole
width, and a point counts if its level, which comes from the point's own bits,
is below the count. So a shingle that occurs a thousand times costs ten
processes. Points are drawn in ascending order up to a limit that fills all
places with high probability, and further where one is empty.

Texts with the same words are one node. Nodes that share a band meet in a
bucket. A bucket does not emit its pairs: all its nodes are verified against one
hub, the one that meets most nodes in all its buckets, as near copies of one text
lie around it. Nodes around a hub that its links leave in several classes are
similar to each other only if they differ from the hub in the same way. How many
differences they must share follows from the verified overlaps (``_differences``),
so that they meet again by the rarest of their differences, in finer buckets.
There, too, one hub comes first; then those pairs of different classes are
verified that can still share enough behind the difference that they met by. Each
pair of a bucket is thus verified, ruled out by the bounds, or already connected.

With 20 bands of 4 a pair of similarity 0.8 shares no band with probability
3e-5, a pair of 0.9 with 1e-9. Verified overlap uses 32-bit hashes of shingles.

Results for odd input: a null text counts as empty; texts without words are one
class; a text of one to four words is a single shingle. Rows with equal ids are
separate rows. ``class_id`` is the smallest id of the class (null only if all are
null), ``kept`` marks one row of each class, of equal ids any one. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from shelfspark.llm.rows import join_hot, text_bytes, texts
from shelfspark.runtime import cut_lineage

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
_BLOCK = 1 << 21

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes ``x`` in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, grown when a longer block comes."""
    if not _powers or len(_powers[0]) < n:
        odd, n = 0xD6E8FEB86659FD93, max(n, _BLOCK + (1 << 16))
        _powers[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(v))])) for v in (odd, pow(odd, -1, 1 << 64))]
    return _powers


def shingles(docs: list[bytes], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle, and the number of the document it belongs to."""
    data = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    up, down = power_tables(len(data) + 1)
    inside = ~_SPACES[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    offsets = np.cumsum([0, *(len(d) + 1 for d in docs)])
    first = np.searchsorted(starts, offsets)  # of each document, in words
    counts = np.diff(first)
    places = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(docs)), places)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(places) - places, places) + first[:-1][doc]
    out = np.zeros(len(doc), _U)
    for k in range(width):
        there = k < counts[doc]
        out = out * _PRIME + np.where(there, words[np.minimum(at + k, len(words) - 1)], _U(k)) if len(words) else out
    return mix(out), doc


def multisets(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, document) with counts, in order of documents."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]).astype(bool) | np.diff(doc, prepend=-1).astype(bool))
    return hashes[new], doc[new], np.diff(np.append(new, len(hashes)))


def signatures(hashes: np.ndarray, doc: np.ndarray, counts: np.ndarray, n: int, places: int = BANDS * ROWS) -> np.ndarray:
    """The smallest point of each document in each place; infinite only for documents without shingles."""
    out = np.full((n, places), np.inf)
    weight = np.bincount(doc, counts, minlength=n)
    limit = (math.log(places) + 5) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        mine = todo[doc]
        _draw(hashes[mine], doc[mine], counts[mine], limit, out, places)
        todo &= np.isinf(out).any(axis=1)
        limit *= 2
    return out


def _draw(hashes: np.ndarray, doc: np.ndarray, counts: np.ndarray, limit: np.ndarray, out: np.ndarray, places: int) -> None:
    """All points up to the limits, interval by interval."""
    low, width, step = 0, 1, 0
    while len(hashes):
        seed = mix(hashes + _U((step + 1) * int(_PRIME) % (1 << 64)))
        owner, most, point, draw = doc, counts, np.zeros(len(hashes)), 0
        while len(seed):
            draw += 1
            bits = mix(seed + _U(draw * 0xD1342543DE82EF95 % (1 << 64)))
            point = point - np.log(((bits >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / (places * width)
            near = point < limit[owner]
            seed, owner, most, point = seed[near], owner[near], most[near], point[near]
            more = mix(bits[near] ^ _U(0xA0761D6478BD642F))
            place = (more & _U(0xFFFFFFFF)) * _U(places) >> _U(32)
            level = low + ((more >> _U(32)) * _U(width) >> _U(32)).astype(np.int64)
            counted = level < most
            np.minimum.at(out.reshape(-1), owner[counted] * places + place[counted].astype(np.int64), point[counted])
        low, width, step = low + width, max(1, low + width), step + 1
        left = counts > low
        hashes, doc, counts = hashes[left], doc[left], counts[left]


def band_keys(points: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    bits = points.view(_U).reshape(len(points), bands, -1)
    key = np.zeros(bits.shape[:2], _U) + np.arange(bands, dtype=_U)
    for k in range(bits.shape[2]):
        key = mix(key * _PRIME + bits[:, :, k])
    return key


def _content(text: bytes) -> bytes:
    return hashlib.sha256(b" ".join(text.split())).digest()


def _in_blocks(docs: list[bytes]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, text in enumerate(docs):
        size += len(text) + 1
        if size >= _BLOCK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(docs):
        yield at, len(docs)


_SIGNED = "doc_id long, row long, raw binary, content binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = text_bytes(batch.column(1))
        keys = []
        for start, end in _in_blocks(raw):
            hashes, doc, counts = multisets(*shingles(raw[start:end]))
            points = signatures(hashes, doc, counts, end - start)
            full = ~np.isinf(points).any(axis=1)
            keys += [k.tolist() if ok else [] for k, ok in zip(band_keys(points).view(np.int64), full, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(2), pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()),
                pa.array(map(_content, raw), pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["doc_id", "row", "raw", "content", "bands"],
        )


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each multiset as a set of 32-bit numbers: the k-th occurrence of a shingle has a number of its own."""
    for batch in batches:
        raw = text_bytes(batch.column(1))
        for start, end in _in_blocks(raw):
            hashes, doc, counts = multisets(*shingles(raw[start:end]))
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            numbers = (mix(np.repeat(hashes, counts) + nth.astype(_U) * _PRIME) >> _U(32)).astype(np.uint32).view(np.int32)
            ends = np.cumsum([0, *np.bincount(doc, counts, minlength=end - start).astype(np.int64)])
            bags = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), bags], names=["node", "bag"])


def _overlaps(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b) with the sizes of both multisets and of what they share."""
    left, right = bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), bags.select(F.col("node").alias("b"), F.col("bag").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("shared"))


def _verified(overlaps: DataFrame, similarity: float) -> DataFrame:
    return overlaps.filter(F.col("shared") >= similarity * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, for every node of an edge (a, b).

    Each label takes the smallest label next to it, and paths of such steps are
    shortened by doubling, so long chains take a logarithmic number of rounds.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = cut_lineage(ends.withColumn("label", F.col("node")), "labels")
    while True:
        a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        between = edges.join(a, "a").join(b, "b").filter("la <> lb").select("la", "lb")
        steps = between.union(between.select("lb", "la")).groupBy("la").agg(F.min("lb").alias("to"))
        steps = cut_lineage(steps.filter("to < la").select(F.col("la").alias("label"), "to"), "steps")
        if steps.isEmpty():
            return labels
        while True:
            further = steps.select(F.col("label").alias("to"), F.col("to").alias("beyond"))
            jumped = cut_lineage(steps.join(further, "to", "left").select("label", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "steps")
            steps = jumped.select("label", "to")
            if jumped.filter("moved").isEmpty():
                break
        labels = cut_lineage(labels.join(steps, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after more edges: only the classes that they connect are looked at."""
    known = labels.select("node")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = labels.union(ends.join(known, "node", "left_anti").select("node", F.col("node").alias("label")))
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = edges.join(a, "a").join(b, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    between = cut_lineage(between, "between")
    moves = components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return cut_lineage(labels.join(moves, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _several(around: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows of the groups whose nodes are of several classes, with the class of each."""
    named = around.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return named.join(mixed.select(key), key, "left_semi")


def _differences(hubs: DataFrame, labels: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(hub, node, number, at, d, e, label): first numbers of each node's difference from its hub.

    Two multisets of n and m numbers are similar if they differ in at most
    r * (n + m) numbers, r = (1 - similarity) / (1 + similarity). Let x and y
    differ from hub h in d(x) and d(y) numbers, on either side. They differ from
    each other in d(x) + d(y) numbers less twice those that both differences
    share. With e(x) = d(x) - r * n(x), they are similar only if the differences share
    at least (e(x) + e(y)) / 2 numbers. Nodes that the hub is linked with are of one
    class, so that one of a pair in question is not, and the least e of such nodes
    around the hub gives a lower bound for x alone. Sets that share c numbers have
    a common one among the first |set| - c + 1 of both, in any order; the order here
    is by rising frequency around the hub. Edits of one text alone come first and are
    left out, as nothing shares them.
    """
    r = (1 - similarity) / (1 + similarity)
    around = hubs.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("na").alias("hn"), F.col("nb").alias("n"), "shared")
    around = around.withColumn("d", F.col("n") + F.col("hn") - 2 * F.col("shared")).withColumn("e", F.col("d") - r * F.col("n"))
    open_ = cut_lineage(_several(around, labels, "hub").withColumn("linked", F.col("e") <= r * F.col("hn") + 1e-9), "around")
    least = open_.groupBy("hub").agg(F.min("e").alias("any"), F.min(F.when(~F.col("linked"), F.col("e"))).alias("apart")).filter("apart is not null")
    share = F.greatest(F.ceil((F.col("e") + F.when(F.col("linked"), F.col("apart")).otherwise(F.col("any"))) / 2 - 1e-9), F.lit(1))
    few = open_.join(least, "hub").withColumn("first", F.col("d") - share + 1).filter("first > 0").select("hub", "node", "label", "n", "d", "e", "first")
    own, of_hub = bags.withColumnRenamed("bag", "y"), bags.select(F.col("node").alias("hub"), F.col("bag").alias("x"))
    both = few.join(own, "node").join(of_hub, "hub")
    # the hub's side of the difference and the node's are told apart by construction: a number is only on one of them
    each = both.select("hub", "node", "label", "n", "d", "e", "first", F.explode(F.concat(F.array_except("y", "x"), F.array_except("x", "y"))).alias("number"))
    each = cut_lineage(each, "differences")
    often = each.groupBy("hub", "number").agg(F.count(F.lit(1)).alias("df"))
    order = W.partitionBy("hub", "node").orderBy("df", "number")
    placed = each.join(often, ["hub", "number"]).withColumn("at", F.row_number().over(order) - 1)
    return placed.filter((F.col("at") < F.col("first")) & (F.col("df") > 1)).select("hub", "number", "node", "n", "at", "d", "e")


def _links(pairs: DataFrame, tested: list[DataFrame], bags: DataFrame, labels: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Labels after the verified pairs among ``pairs``, and the pairs that were verified now."""
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    for done in tested:
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    pairs = cut_lineage(pairs, "pairs")
    found = cut_lineage(_verified(_overlaps(pairs, bags), similarity), "edges")
    return (labels if found.isEmpty() else _joined(labels, found)), pairs


def _classes(members: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(node, label) of all nodes that have a link: the components of the links between nodes that share a bucket."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    score = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("score"))
    scored = cut_lineage(members.join(score, "node"), "scored")
    # the node that meets most others is the best hub; it lies in the middle of its near copies
    first = scored.groupBy("bucket").agg(F.max(F.struct("score", -F.col("node"))).alias("top")).select("bucket", (-F.col("top")["col2"]).alias("a"))
    pairs = scored.join(first, "bucket").filter("node <> a").select("a", F.col("node").alias("b"), "score").distinct()
    pairs = cut_lineage(pairs, "pairs")
    hubs = cut_lineage(_overlaps(pairs.select("a", "b"), bags), "hubs")
    labels = components(_verified(hubs, similarity))
    tested = [hubs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))]

    finer = _differences(hubs, labels, bags, similarity).withColumn("bucket", F.xxhash64("hub", "number")).drop("hub", "number")
    finer = cut_lineage(finer.join(score, "node"), "finer")

    # what two differences can still share behind their common number
    enough = F.least(F.col("d") - F.col("at"), F.col("od") - F.col("oat")) >= (F.col("e") + F.col("oe")) / 2 - 1e-9
    alike = F.least("n", "on") >= similarity * F.greatest("n", "on") - 1e-9
    can_be = (F.col("label") != F.col("olabel")) & alike & enough
    other = [F.col(c).alias(f"o{c}") for c in ("label", "n", "at", "d", "e")]

    # one hub for each finer bucket first: it connects nodes that differ from the first hub alike
    named = _several(finer, labels, "bucket")
    top = named.groupBy("bucket").agg(F.max_by(F.struct("node", *[c for c in ("label", "n", "at", "d", "e")]), F.struct("score", "node")).alias("o"))
    hub = top.select("bucket", F.col("o.node").alias("other"), *[F.col(f"o.{c}").alias(f"o{c}") for c in ("label", "n", "at", "d", "e")])
    labels, more = _links(named.join(hub, "bucket").filter(can_be), tested, bags, labels, similarity)
    tested.append(more)

    # then the pairs of different classes that are left
    named = cut_lineage(_several(finer, labels, "bucket"), "named")
    others = named.select("bucket", F.col("node").alias("other"), *other)
    labels, _ = _links(named.join(others, "bucket").filter((F.col("node") < F.col("other")) & can_be), tested, bags, labels, similarity)
    return labels


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by digest, once for each batch: copies are merged before the shuffle."""
    for batch in batches:
        found = {hashlib.sha256(t).digest(): t for t in text_bytes(batch.column(0))}
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary()).cast(pa.string())], names=["raw", "text"])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, raw_sha256, class_id, class_size, kept for each row."""
    rows = texts(docs, id_col, text_col, F.monotonically_increasing_id().alias("row"))
    signed = cut_lineage(rows.mapInArrow(_sign, _SIGNED), "signatures")
    nodes = cut_lineage(signed.groupBy("content").agg(F.min("row").alias("node")), "nodes")
    owners = signed.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    placed = owners.select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = cut_lineage(placed.join(shared, "bucket"), "members")

    wanted = owners.select(F.col("row").alias("node"), "raw").join(members.select("node").distinct(), "node", "left_semi")
    found = texts(docs, id_col, text_col).select("text").mapInArrow(_distinct_texts, "raw binary, text string")
    once = found.join(wanted, "raw").dropDuplicates(["raw", "node"])
    bags = cut_lineage(once.select("node", "text").mapInArrow(_bags, "node long, bag array<int>"), "bags")
    labels = _classes(members, bags, similarity)

    named = cut_lineage(nodes.join(labels, "node", "left").select("content", F.coalesce("label", "node").alias("label")), "classes")
    classes = cut_lineage(join_hot(signed.select("doc_id", "row", "raw", "content"), named, "content").drop("content"), "classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "row"))
    owners = classes.groupBy("label").agg(best.alias("best"), F.count(F.lit(1)).alias("class_size"))
    return join_hot(classes, owners, "label").select(
        "doc_id", F.lower(F.hex("raw")).alias("raw_sha256"), F.col("best.doc_id").alias("class_id"), "class_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )
