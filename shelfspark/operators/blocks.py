"""Similarity work as a grid of equal cells.

Pairing rows through a shared key (users through a common item, say) emits
every pair inside each key, which a hot key turns quadratic. Here rows are
hashed into blocks and a *cell* is one pair of blocks: Spark shuffles each
block to its cells, numpy multiplies inside the cell, and a cell emits only
finished pairs or its own top-k. Cells hold about ``block x block`` rows
whatever the keys look like, so no key can make one of them large.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfspark.runtime import block_count, cut_lineage, one_thread_per_task

DIGITS = 9  # scores this close are ties
CELL = 20_000_000  # numbers a task holds in one dense matrix: 160 MB
BLOCK_ENTRIES = 4_000_000  # entries of a sparse block
NEAREST = 256  # queries that look for their clusters at once
CELL_PAIRS = 8_000_000  # pairs that a cell of all related pairs emits
PRODUCTS = 2_000_000  # products that a task holds at a time
PAIRS_OUT = 131_072  # related pairs that a task sends at a time
PIECE = 65_536  # entries of a row that are sent as one
SCORE_CELL = 2_000_000  # the same for score rows, which are read several times: 16 MB stay in cache


def block_of(col: str, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def _all_blocks(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns as new attributes, so that both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _parallelism(df: DataFrame) -> int:
    one_thread_per_task(df.sparkSession)
    return df.sparkSession.sparkContext.defaultParallelism


def cell_tasks(cells: int) -> int:
    """Tasks for a number of cells: one each up to 2,000, beyond that one for eight, so tasks stay small as the grid grows."""
    return min(cells, max(2000, -(-cells // 8)))


def unit_entries(entries: DataFrame, row: str, dim: str, value: str) -> DataFrame:
    """(row, dim, value, norm): each entry with the L2 norm of its row."""
    e = entries.select(F.col(row).alias("row"), F.col(dim).alias("dim"), F.col(value).cast("double").alias("value"))
    norms = e.groupBy("row").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return e.join(norms, "row")


# --- all non-zero pairs ---------------------------------------------------------


def cosine_pairs(
    entries: DataFrame, row: str, dim: str, value: str, block_rows: int = 65_536, block_entries: int = BLOCK_ENTRIES
) -> DataFrame:
    """(a, b, dot, sim) for a < b with a non-zero dot product; (row, dim) is unique.

    Cells are (row block, row block); a block has at most about ``block_rows`` rows and
    ``block_entries`` entries, and there are so many that a cell has about ``CELL_PAIRS`` pairs. Inside a cell only rows that share a dim are
    multiplied, a bounded number of products at a time, so work and memory follow the
    related pairs. The result itself is every related pair: the recommenders below do
    not build it.
    """
    e = cut_lineage(unit_entries(entries, row, dim, value), "entries")
    if _has_gaps(e):
        return _pairs_with_gaps(e, entries)
    n = e.agg(F.approx_count_distinct("row").alias("rows"), F.count(F.lit(1)).alias("entries")).first()
    products = e.groupBy("dim").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    pairs = min(products, float(n["rows"]) ** 2) / 2
    # nb (nb + 1) / 2 cells
    nb = max(
        block_count(n["rows"], block_rows), block_count(n["entries"], block_entries), math.ceil(math.sqrt(2 * pairs / CELL_PAIRS)),
        min(math.ceil(math.sqrt(4 * _parallelism(entries))), block_count(n["entries"], 20_000)),
    )
    pieces = block_count(e.groupBy("row").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1, PIECE)
    rows = _row_pieces(e, pieces).withColumn("own", block_of("row", nb))
    # a block meets those from its own on, and those up to its own
    left = F.struct(F.lit(False).alias("late"), F.sequence(F.col("own"), F.lit(nb - 1)).alias("met"))
    right = F.struct(F.lit(True).alias("late"), F.sequence(F.lit(0), F.col("own")).alias("met"))
    rows = rows.withColumn("side", F.explode(F.array(left, right))).withColumn("met", F.explode("side.met"))
    blk, other = (F.when(F.col("side.late"), F.col(x)).otherwise(F.col(y)) for x, y in (("met", "own"), ("own", "met")))
    cells = rows.select(blk.alias("blk"), other.alias("other"), F.col("side.late").alias("late"), "row", "dims", "values", "norm")
    names = ["a", "b", "dot", "sim"]

    def multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        same = key[0].as_py() == key[1].as_py()
        table = pa.Table.from_batches(list(batches))
        late, kind = table.column("late").to_numpy(), table.schema.field("row").type
        if late.all() or not late.any():
            return
        (ida, na, ata, dima, va), (idb, nbm, atb, dimb, vb) = (_flat(np, table.filter(pa.array(late == side))) for side in (False, True))
        del table
        # pairs leave as they are found: a cell holds its rows and one chunk
        for i, j, d in _products(np, ata, dima, va, len(ida), atb, dimb, vb, len(idb), most=PRODUCTS // 4):
            keep = d != 0
            if same:
                keep &= i < j
            i, j, d = i[keep], j[keep], d[keep]
            for at in range(0, len(i), PAIRS_OUT):
                n = slice(at, at + PAIRS_OUT)
                x, y = ida[i[n]], idb[j[n]]
                swap = x > y
                columns = (np.where(swap, y, x), np.where(swap, x, y), d[n], d[n] / (na[i[n]] * nbm[j[n]]))
                kinds = (kind, kind, pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    kind = dict(e.dtypes)["row"]
    keys, n_cells = ["blk", "other"], cell_tasks(nb * (nb + 1) // 2)
    return cells.repartition(n_cells, *keys).groupBy(*keys).applyInArrow(multiply, f"a {kind}, b {kind}, dot double, sim double")


def _numbered(np, pdf):
    """Ids in order, their norms, and for each entry the number of its id."""
    ids, first, at = np.unique(pdf["row"].to_numpy(), return_index=True, return_inverse=True)
    return ids, pdf["norm"].to_numpy(dtype=float)[first], at


def _spans(np, starts, sizes):
    """The numbers of the ranges [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _products(np, a_at, a_dim, a_val, n_a, b_at, b_dim, b_val, n_b, every=False, most=PRODUCTS):
    """(i, j, dot) of all a and b rows that share a dim, or of ``every`` two, in chunks of a rows with about ``most`` products each, by i, then j."""
    order = np.argsort(b_dim, kind="stable")
    dims, first = np.unique(b_dim[order], return_index=True)
    sizes = np.diff(np.r_[first, len(order)])
    b_row, b_num = b_at[order], b_val[order]
    pos = np.searchsorted(dims, a_dim)
    pos[pos == len(dims)] = 0
    known = dims[pos] == a_dim
    by_row = np.argsort(a_at[known], kind="stable")
    row, pos, val = a_at[known][by_row], pos[known][by_row], a_val[known][by_row]
    work = np.bincount(row, sizes[pos], n_a).astype(np.int64)
    if every:
        work = np.maximum(work, n_b)
    upto, entry = np.cumsum(work), np.searchsorted(row, np.arange(n_a + 1))
    at = 0
    while at < n_a:
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + most, side="right")))
        s = slice(entry[at], entry[end])
        many = sizes[pos[s]]
        if every or len(many):
            got = _spans(np, first[pos[s]], many)
            key = np.repeat((row[s] - at) * n_b, many) + b_row[got]
            num = np.repeat(val[s], many) * b_num[got]
            if every or (end - at) * n_b <= 4 * len(key):
                dot = np.bincount(key, num, (end - at) * n_b)
                found = np.arange(len(dot)) if every else np.flatnonzero(np.bincount(key, minlength=len(dot)))
                yield at + found // n_b, found % n_b, dot[found]
            else:
                o = np.argsort(key, kind="stable")
                key, num = key[o], num[o]
                heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                yield at + key[heads] // n_b, key[heads] % n_b, np.add.reduceat(num, heads)
        at = end


# --- neighbour predictions --------------------------------------------------------


def _similarities(np, t_at, t_dim, t_val, n_t, r_at, r_dim, r_val, n_r):
    """Dense (raters x targets) dot products; raters are visited through their own entries.

    Targets lie along the rows of memory, so a rater's dims are gathered as whole rows.
    """
    dims = np.unique(t_dim)
    base = np.zeros((len(dims), n_t))
    base[np.searchsorted(dims, t_dim), t_at] = t_val
    at = np.searchsorted(dims, r_dim)
    at[at == len(dims)] = 0
    known = dims[at] == r_dim if len(dims) else np.zeros(len(r_dim), dtype=bool)
    r_at, at, r_val = r_at[known], at[known], r_val[known]
    order = np.argsort(r_at, kind="stable")
    r_at, at, r_val = r_at[order], at[order], r_val[order]
    out = np.zeros((n_r, n_t))
    starts = np.flatnonzero(np.r_[True, r_at[1:] != r_at[:-1]]) if len(r_at) else np.array([], dtype=int)
    for s, e in zip(starts, np.r_[starts[1:], len(r_at)]):
        out[r_at[s]] = r_val[s:e] @ base[at[s:e]]
    return out


def _entries(np, pdf):
    """Packed rows as flat (row number, dim, weight) arrays."""
    sizes = np.array([len(d) for d in pdf["dims"]])
    if not len(sizes) or not sizes.sum():
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate(list(pdf["dims"])), np.concatenate(list(pdf["weights"]))


def _unit(np, at, val, n):
    """Entry values divided by the norm of their row; a zero row stays zero."""
    norm = np.sqrt(np.bincount(at, val * val, n))[at]
    return np.divide(val, norm, out=np.zeros_like(val), where=norm > 0)


def _dense(np, at, dim, val, n, dims):
    """(n x dims) matrix of the entries whose dim is listed."""
    pos = np.searchsorted(dims, dim)
    pos[pos == len(dims)] = 0
    hit = dims[pos] == dim
    out = np.zeros((n, len(dims)))
    out[at[hit], pos[hit]] = val[hit]
    return out


def _row_pieces(e: DataFrame, pieces: int, blocks: bool = False) -> DataFrame:
    """(row, dims, values, norm): the entries of a row as arrays, of long rows in ``pieces`` of about ``PIECE``.

    With ``blocks`` the rows keep the target blocks that ask for them, as bits; a row in pieces is sent to all.
    """
    cut = e.withColumn("piece", F.pmod(F.xxhash64("dim"), F.lit(pieces))) if pieces > 1 else e.withColumn("piece", F.lit(0))
    aggs = [F.first("norm").alias("norm"), F.collect_list("dim").alias("dims"), F.collect_list("value").alias("values")]
    if not blocks:
        return cut.groupBy("row", "piece").agg(*aggs).drop("piece")
    bits = F.bit_or("near").bitwiseAND(F.bit_or("asked")) if pieces == 1 else F.lit(-1).cast("long")
    return cut.groupBy("row", "piece").agg(*aggs, bits.alias("blocks")).filter("blocks <> 0").drop("piece")


def _with_blocks(e: DataFrame, targets: DataFrame, ask: DataFrame, nt: int, every: bool) -> DataFrame:
    """Each entry with the target blocks that have its dim (``near``) and that ask for it as a column (``asked``), as bits.

    Only a rater with both can count for a block. Blocks that share a bit share their raters.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), block_of("row", nt) % 63)
    none = F.lit(0).cast("long")
    marks = targets.select("dim", bit.alias("near"), none.alias("asked")).unionByName(ask.select("dim", none.alias("near"), bit.alias("asked")))
    marks = marks.groupBy("dim").agg(F.bit_or("near").alias("near"), F.bit_or("asked").alias("asked"))
    near = F.lit(-1).cast("long") if every else F.coalesce("near", none)
    return e.join(marks, "dim", "left").withColumns({"near": near, "asked": F.coalesce("asked", none)})


def _flat(np, table):
    """Ids in order, their norms, and for each entry the number of its id, its dim and its value."""
    sizes = table.column("dims").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    ids, first, at = np.unique(table.column("row").to_numpy(), return_index=True, return_inverse=True)
    dims, values = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("dims", "values"))
    return ids, table.column("norm").to_numpy()[first], np.repeat(at, sizes), dims, values


def neighbour_predictions(
    ratings: DataFrame,
    row: str,
    col: str,
    value: str,
    k: int | None = 10,
    requests: DataFrame | None = None,
    target_rows: int = 131_072,
    rater_rows: int = 1_048_576,
) -> DataFrame:
    """(row, col, pred): weighted mean of the k most similar rows that rated ``col``.

    ``k=None`` takes every neighbour and returns the plain weighted sum instead.
    With ``requests`` (row, col) exactly those cells are predicted; without,
    every cell the row has not rated and some neighbour has. Rows without a
    positive similarity get no prediction. Swapping ``row`` and ``col`` turns the
    user-based predictor into the item-based one.

    Grid: target blocks x rater blocks, cut by rows and entries. A cell multiplies
    only targets and raters that share a column, a bounded number at a time, and
    emits at most k candidates per prediction, none of similarity 0; the parts of
    one prediction are merged afterwards.
    """
    return _predict(ratings, row, col, value, k, requests, None, target_rows, rater_rows)


def neighbour_lists(
    ratings: DataFrame, row: str, col: str, value: str, k: int, requests: DataFrame, target_rows: int = 131_072, rater_rows: int = 1_048_576
) -> DataFrame:
    """(row, col, b): for each requested cell its k most similar raters, best first, as structs of ``s`` (similarity) and ``v`` (value)."""
    return _predict(ratings, row, col, value, k, requests, None, target_rows, rater_rows, lists=True)


def neighbour_top(
    ratings: DataFrame, row: str, col: str, value: str, top: int = 10, k: int | None = 10, per: str = "row",
    target_rows: int = 16_384, rater_rows: int = 1_048_576,
) -> DataFrame:
    """The ``top`` best unrated predictions per row (``per='row'``) or per column.

    Ties go to the smaller id of the other side. One rater block allows a cell
    to cut its own predictions before they leave the task. Sums over all
    neighbours (``k=None``) go through pairs of columns where these are fewer.
    """
    e = cut_lineage(unit_entries(ratings, row, col, value), "entries")
    if k is None and per == "row" and _by_columns(e):
        preds = _sums_by_columns(e, row, col, top)
    else:
        preds = _predict(ratings, row, col, value, k, None, (top, per), target_rows, rater_rows, e=e)
    owner, other = (row, col) if per == "row" else (col, row)
    w = W.partitionBy(owner).orderBy(F.round("pred", DIGITS).desc(), F.asc(other))
    return preds.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _by_columns(e: DataFrame) -> bool:
    """Whether sums over all neighbours go through pairs of columns: all values are positive, and rows have fewer pairs of entries than columns have."""
    if _has_gaps(e) or not e.filter("value <= 0").isEmpty():
        return False
    per_row, per_col = (
        e.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0 for c in ("row", "dim")
    )
    return per_row <= per_col


def _sums_by_columns(e: DataFrame, row: str, col: str, top: int, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(row, col, pred): the ``top`` largest sums over all neighbours per row and column block, without forming a neighbour.

    sum over v of sim(u, v) * value(v, c) is the product of u's unit vector and the matrix
    M(d, c) = sum over v of unit(v, d) * value(v, c). M has a number for each pair of columns that
    meet in a row; what a row adds to its own sums falls on columns it has, which are left out.
    """
    a = e.select("row", "dim", (F.col("value") / F.col("norm")).alias("w"))
    b = e.select("row", F.col("dim").alias("col"), "value")
    matrix = a.join(b, "row").filter("dim <> col").groupBy("dim", "col").agg(F.sum(F.col("w") * F.col("value")).alias("weight"))
    matrix = cut_lineage(matrix, "matrix")
    nc, n = block_count(matrix.count(), block_entries), e.count()
    nt = max(block_count(n, 1_000_000), min(2 * _parallelism(e), block_count(n, 20_000)))
    left = e.select(block_of("row", nt).alias("t"), "row", "dim", "value", "norm").withColumn("c", _all_blocks(nc))
    right = matrix.withColumn("c", block_of("col", nc)).withColumn("t", _all_blocks(nt))

    def add_up(key, lpdf, rpdf):
        import numpy as np
        import pandas as pd

        empty = pd.DataFrame({n: pd.Series([], dtype=object) for n in ("row", "col", "pred")})
        if not len(lpdf) or not len(rpdf):
            return empty
        ids, norm, at = _numbered(np, lpdf)
        dim, val = lpdf["dim"].to_numpy(), lpdf["value"].to_numpy()
        cols, c_at = np.unique(rpdf["col"].to_numpy(), return_inverse=True)
        width = len(cols)
        pos = np.searchsorted(cols, dim)
        pos[pos == width] = 0
        own = cols[pos] == dim
        rated = np.unique(at[own] * width + pos[own])
        kept = _Kept(np, (top, "row"), width, None)
        for i, j, d in _products(np, at, dim, val, len(ids), c_at, rpdf["dim"].to_numpy(), rpdf["weight"].to_numpy(), width):
            cell, s = i * width + j, d / norm[i]
            if len(rated):
                pos = np.searchsorted(rated, cell)
                pos[pos == len(rated)] = 0
                free = rated[pos] != cell
                cell, s = cell[free], s[free]
            kept.add(cell, s, s)
        found = kept.all()
        if found is None:
            return empty
        return pd.DataFrame({"row": ids[found[0] // width], "col": cols[found[0] % width], "pred": found[1]})

    kind, n_cells = dict(e.dtypes), cell_tasks(nt * nc)
    found = (
        left.repartition(n_cells, "t", "c").groupBy("t", "c")
        .cogroup(_renewed(right).repartition(n_cells, "t", "c").groupBy("t", "c"))
        .applyInPandas(add_up, f"row {kind['row']}, col {kind['dim']}, pred double")
    )
    return found.select(F.col("row").alias(row), F.col("col").alias(col), "pred")


def _predict(ratings, row, col, value, k, requests, cut, target_rows, rater_rows, lists=False, e=None):
    e = e or cut_lineage(unit_entries(ratings, row, col, value), "entries")
    if _has_gaps(e):
        return _predict_with_gaps(e, ratings, row, col, k, requests, cut, lists)
    sizes = e.agg(F.approx_count_distinct("row").alias("rows"), F.count("dim").alias("entries"), F.min("value").alias("least")).first()
    asked_only = requests is not None
    every = (sizes["least"] or 0) < 0  # raters of similarity 0 come before those below it
    targets, ask, raters = e, None, e
    n_targets = sizes["rows"]
    if asked_only:
        ask = cut_lineage(requests.select(F.col(row).alias("row"), F.col(col).alias("dim")).filter("row is not null and dim is not null").distinct(), "ask")
        targets = e.join(ask.select("row").distinct(), "row", "left_semi")
        n_targets = targets.agg(F.approx_count_distinct("row")).first()[0]
    t_size = min(target_rows, max(32, -(-n_targets // (2 * _parallelism(ratings)))))
    nt, nr = block_count(n_targets, t_size), max(block_count(sizes["rows"], rater_rows), block_count(sizes["entries"], 2 * BLOCK_ENTRIES))
    pieces = block_count(e.groupBy("row").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1, PIECE)
    kind = dict(e.dtypes)
    left = _row_pieces(targets, pieces).withColumn("ask", F.lit(0))
    if asked_only:
        wide = block_count(ask.groupBy("row").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1, PIECE)
        blank = ask.withColumns({"value": F.lit(0.0), "norm": F.lit(0.0)})
        left = left.unionByName(_row_pieces(blank, wide).withColumn("ask", F.lit(1)))
        raters = _with_blocks(e, targets, ask, nt, every)
    left = left.withColumn("t", block_of("row", nt)).withColumn("r", _all_blocks(nr))
    right = _row_pieces(raters, pieces, asked_only)
    blocks = F.sequence(F.lit(0), F.lit(nt - 1))
    if asked_only:
        blocks = F.filter(blocks, lambda t: F.call_function("shiftright", F.col("blocks"), t % 63).bitwiseAND(F.lit(1)) == 1)
    right = right.withColumn("r", block_of("row", nr)).withColumn("t", F.explode(blocks)).select("t", "r", "row", "dims", "values", "norm")
    sums = k is None
    single = (nr == 1 or sums) and not lists  # sums of parts can be added up, candidate lists have to be merged
    final = nr == 1

    def predict(key, ltab, rtab):
        import numpy as np
        import pandas as pd

        row_kind, col_kind = ltab.schema.field("row").type, ltab.schema.field("dims").type.value_type
        num_kind = pa.float64()
        names = {"row": row_kind, "col": col_kind}
        names.update({"num": num_kind, "den": num_kind} if single else {"s": num_kind, "v": num_kind, "i": row_kind})
        empty = pa.table({n: pa.array([], t) for n, t in names.items()})
        asks = ltab.column("ask").to_numpy() == 1
        own = ltab.filter(pa.array(~asks))
        if not len(own) or not len(rtab):
            return empty
        t_ids, t_norm, t_at, t_dim, t_val = _flat(np, own)
        r_ids, r_norm, r_at, r_dim, r_val = _flat(np, rtab)
        cols, r_col = np.unique(r_dim, return_inverse=True)
        r_at, r_col = r_at.astype(np.int32), r_col.astype(np.int32)
        del r_dim
        width, n_r = len(cols), len(r_ids)

        def cells(at, dim):
            """Sorted numbers of the (target, col) that some rater has."""
            pos = np.searchsorted(cols, dim)
            pos[pos == width] = 0
            ok = cols[pos] == dim
            return np.unique(at[ok] * width + pos[ok])

        if asked_only:
            a_ids, _, a_at, a_dim, _ = _flat(np, ltab.filter(pa.array(asks)))
            ask_at = pd.Series(np.arange(len(t_ids)), index=t_ids).reindex(a_ids).to_numpy()[a_at]
            ok = ~pd.isna(ask_at)
            wanted = cells(ask_at[ok].astype(int), a_dim[ok])
            by = np.lexsort((r_at, r_col))
        else:
            rated = cells(t_at, t_dim)
            by = np.lexsort((r_col, r_at))
        # raters of a col, or cols of a rater
        major, minor, values = (r_col, r_at, r_val) if asked_only else (r_at, r_col, r_val)
        minor, values = minor[by], values[by]
        many = np.bincount(major, minlength=width if asked_only else n_r)
        first = np.cumsum(many) - many
        kept = _Kept(np, cut if final else None, width, k)

        def asked(i, j, s):
            """(cell, similarity, value, rater) of the wanted cells of these targets."""
            near = i * n_r + j
            lo, hi = np.searchsorted(wanted, [i[0] * width, (i[-1] + 1) * width])
            for w in _slices(np, many[wanted[lo:hi] % width]):
                cell = wanted[lo:hi][w]
                size = many[cell % width]
                got = _spans(np, first[cell % width], size)
                cell = np.repeat(cell, size)
                who = cell // width * n_r + minor[got]
                pos = np.searchsorted(near, who)
                pos[pos == len(near)] = 0
                there = near[pos] == who
                cell, got, sim = cell[there], got[there], s[pos[there]]
                o = np.lexsort((minor[got], -np.round(sim, DIGITS), cell))
                yield cell[o], sim[o], values[got[o]], minor[got[o]]

        def unrated(i, j, s):
            """The same for all cells that these targets have not rated."""
            o = np.lexsort((j, -np.round(s, DIGITS), i))
            i, j, s = i[o], j[o], s[o]
            heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            ends = np.r_[heads[1:], len(i)]
            for w in _slices(np, np.add.reduceat(many[j], heads)):
                x = slice(heads[w][0], ends[w][-1])
                size = many[j[x]]
                got = _spans(np, first[j[x]], size)
                cell = np.repeat(i[x] * width, size) + minor[got]
                # neighbours are in order, so a stable sort leaves each cell's in order
                o = np.argsort(cell, kind="stable")
                cell = cell[o]
                pos = np.searchsorted(rated, cell)
                pos[pos == len(rated)] = 0
                free = rated[pos] != cell if len(rated) else np.ones(len(cell), bool)
                o = o[free]
                yield cell[free], np.repeat(s[x], size)[o], values[got[o]], np.repeat(j[x], size)[o]

        t_col = np.searchsorted(cols, t_dim)
        t_col[t_col == width] = 0
        t_col = np.where(cols[t_col] == t_dim, t_col, -1)
        for i, j, d in _products(np, t_at, t_col, t_val, len(t_ids), r_at, r_col, r_val, n_r, every):
            with np.errstate(invalid="ignore", divide="ignore"):
                s = d / (r_norm[j] * t_norm[i])
            ok = np.isfinite(s) & (every | (s != 0))
            if not ok.any():
                continue
            for cell, sim, value, who in (asked if asked_only else unrated)(i[ok], j[ok], s[ok]):
                if not len(cell):
                    continue
                heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                if not sums:
                    place = np.arange(len(cell)) - np.repeat(heads, np.diff(np.r_[heads, len(cell)]))
                    best = place < k
                    cell, sim, value, who = cell[best], sim[best], value[best], who[best]
                    heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                if single:
                    kept.add(cell[heads], np.add.reduceat(sim * value, heads), np.add.reduceat(np.abs(sim), heads))
                else:
                    kept.parts.append((cell, sim, value, who))
        found = kept.all()
        if found is None:
            return empty
        columns = [t_ids[found[0] // width], cols[found[0] % width], *found[1:]]
        if not single:
            columns[-1] = r_ids[columns[-1]]
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(names.items(), columns)})

    rk, ck = kind["row"], kind["dim"]
    shape = f"row {rk}, col {ck}, " + (
        "num double, den double" if single else f"s double, v double, i {rk}"
    )
    n_cells = cell_tasks(nt * nr)
    out = (
        left.repartition(n_cells, "t", "r")
        .groupBy("t", "r")
        .cogroup(_renewed(right).repartition(n_cells, "t", "r").groupBy("t", "r"))
        .applyInArrow(predict, shape)
    )
    if not single:
        best = F.slice(
            F.array_sort(
                F.transform(
                    F.collect_list(F.struct("s", "v", "i")),
                    lambda c: F.struct((-F.round(c["s"], DIGITS)).alias("o"), c["i"].alias("i"), c["s"].alias("s"), c["v"].alias("v")),
                )
            ),
            1,
            k,
        )
        # a list holds k candidates per rater block
        out = out.groupBy("row", "col").agg(best.alias("b"))
        if lists:
            return out.select(F.col("row").alias(row), F.col("col").alias(col), "b")
        out = out.select(
            "row",
            "col",
            F.aggregate("b", F.lit(0.0), lambda acc, c: acc + c["s"] * c["v"]).alias("num"),
            F.aggregate("b", F.lit(0.0), lambda acc, c: acc + F.abs(c["s"])).alias("den"),
        )
    elif not final:
        out = out.groupBy("row", "col").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    pred = F.col("num") if sums else F.col("num") / F.col("den")
    return out.filter("den > 0").select(F.col("row").alias(row), F.col("col").alias(col), pred.alias("pred"))


def _slices(np, sizes, most=PRODUCTS):
    """Slices of a list whose sizes add up to about ``most``."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


class _Kept:
    """What a cell of predictions emits: (cell, num, den) of all, or of those that can be among the ``top`` per row or column.

    For a per-column cut a block sees only some of the rows of a column, so it
    keeps the block's own best, which contains every global winner.
    """

    def __init__(self, np, cut, width, k):
        self.np, self.cut, self.width, self.k = np, cut, width, k
        self.parts, self.waiting = [], 0
        self.least = np.full(width, -np.inf) if cut and cut[1] != "row" else None

    def score(self, num, den):
        return self.np.round(num if self.k is None else num / den, DIGITS)

    def add(self, cell, num, den):
        good = den > 0
        cell, num, den = cell[good], num[good], den[good]
        if self.cut and len(cell):
            if self.least is None:  # all cells of a row come at once
                best = self.best(cell // self.width, cell, num, den)
            else:
                best = self.score(num, den) >= self.least[cell % self.width]
            cell, num, den = cell[best], num[best], den[best]
        self.parts.append((cell, num, den))
        self.waiting += len(cell)
        if self.least is not None and self.waiting > PRODUCTS:
            self.shrink()

    def best(self, owner, cell, num, den):
        """The numbers of the ``top`` best of each owner, ties by cell."""
        np = self.np
        o = np.lexsort((cell, -self.score(num, den), owner))
        owner = owner[o]
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return o[np.arange(len(o)) - np.repeat(heads, np.diff(np.r_[heads, len(o)])) < self.cut[0]]

    def shrink(self):
        np, top = self.np, self.cut[0]
        cell, num, den = map(np.concatenate, zip(*self.parts))
        best = self.best(cell % self.width, cell, num, den)
        cell, num, den = cell[best], num[best], den[best]
        col, score = cell % self.width, self.score(num, den)
        full = np.flatnonzero(np.bincount(col, minlength=self.width) >= top)
        lowest = np.full(self.width, np.inf)
        np.minimum.at(lowest, col, score)
        self.least[full] = lowest[full]
        self.parts, self.waiting = [(cell, num, den)], len(cell)

    def all(self):
        if not self.parts:
            return None
        if self.least is not None:
            self.shrink()
        return [*map(self.np.concatenate, zip(*self.parts))]


# --- tables with gaps ---------------------------------------------------------------


def _has_gaps(e: DataFrame) -> bool:
    return not e.filter("dim is null or value is null or isnan(value)").isEmpty()


def _pairs_with_gaps(
    e: DataFrame, entries: DataFrame, block_rows: int = 1024, block_dims: int = 65_536
) -> DataFrame:
    """The dense grid, for entries with a null dim or value: a null dim is a dim, a null value makes every product null."""
    sizes = e.agg(F.approx_count_distinct("row").alias("rows"), F.approx_count_distinct("dim").alias("dims")).first()
    size = min(block_rows, max(128, -(-sizes["rows"] // _parallelism(entries))))
    nb, nd = block_count(sizes["rows"], size), block_count(sizes["dims"], block_dims)
    e = e.withColumns({"blk": block_of("row", nb), "cd": block_of("dim", nd)})
    cells = e.withColumn("other", _all_blocks(nb)).withColumns(
        {"ca": F.least("blk", "other"), "cb": F.greatest("blk", "other")}
    )

    def multiply(key, pdf):
        import numpy as np
        import pandas as pd

        ca, cb, _ = key
        blk = pdf["blk"].to_numpy()
        rows = pdf["row"].to_numpy()
        dims, dim_at = np.unique(pdf["dim"].to_numpy(), return_inverse=True)
        vals = pdf["value"].to_numpy(dtype=float)
        norm = pdf["norm"].to_numpy(dtype=float)
        sides = []
        for want in (ca, cb):
            m = blk == want
            ids, first, at = np.unique(rows[m], return_index=True, return_inverse=True)
            sides.append((ids, norm[m][first], at, dim_at[m], vals[m]))
        (ida, na, ata, dima, va), (idb, nbm, atb, dimb, vb) = sides
        dots = np.zeros((len(ida), len(idb)))
        step = max(1, 4_000_000 // max(1, len(ida) + len(idb)))
        for lo in range(0, len(dims), step):
            wa, wb = (dima >= lo) & (dima < lo + step), (dimb >= lo) & (dimb < lo + step)
            width = min(step, len(dims) - lo)
            left, right = np.zeros((len(ida), width)), np.zeros((len(idb), width))
            left[ata[wa], dima[wa] - lo] = va[wa]
            right[atb[wb], dimb[wb] - lo] = vb[wb]
            dots += left @ right.T
        if ca == cb:
            dots = np.triu(dots, 1)
        i, j = np.nonzero(dots)
        a, b, d = ida[i], idb[j], dots[i, j]
        swap = a > b
        out = pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "dot": d})
        out["sim"] = d / (na[i] * nbm[j])
        return out

    kind = dict(e.dtypes)["row"]
    keys = ["ca", "cb", "cd"]
    pairs = (
        cells.repartition(cell_tasks(nb * (nb + 1) // 2 * nd), *keys)
        .groupBy(*keys)
        .applyInPandas(multiply, f"a {kind}, b {kind}, dot double, sim double")
    )
    if nd > 1:
        pairs = pairs.groupBy("a", "b").agg(F.sum("dot").alias("dot"), F.sum("sim").alias("sim"))
    return pairs


def _best(np, sims, values, k):
    """Per target row the k largest similarities (ties: raters are in id order) with their values."""
    if sims.shape[1] <= k:
        return sims, np.broadcast_to(values, sims.shape), np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    order = np.argsort(-np.round(sims, DIGITS), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sims, order, 1), values[order], order


def _predict_with_gaps(e, ratings, row, col, k, requests, cut, lists, target_rows=1024, rater_rows=32_768):
    """The dense grid, for entries with a null dim or value: a null column is predicted, a null value makes its similarities null."""
    sizes = e.agg(F.approx_count_distinct("row").alias("rows")).first()
    t_size = min(target_rows, max(32, -(-sizes["rows"] // _parallelism(ratings))))
    nt, nr = block_count(sizes["rows"], t_size), block_count(sizes["rows"], rater_rows)
    kind = dict(e.dtypes)
    zero = F.lit(0.0)
    left = e.select(block_of("row", nt).alias("t"), "row", "dim", "value", "norm", F.lit(0).alias("ask"))
    if requests is not None:
        ask = requests.select(F.col(row).alias("row"), F.col(col).alias("dim")).distinct()
        left = left.unionByName(
            ask.select(
                block_of("row", nt).alias("t"), "row", "dim", zero.alias("value"), zero.alias("norm"), F.lit(1).alias("ask")
            )
        )
    left = left.withColumn("r", _all_blocks(nr))
    right = e.withColumn("r", block_of("row", nr)).withColumn("t", _all_blocks(nt))
    sums = k is None
    single = (nr == 1 or sums) and not lists  # sums of parts can be added up, candidate lists have to be merged
    final = nr == 1
    asked_only = requests is not None

    def predict(key, lpdf, rpdf):
        import numpy as np
        import pandas as pd

        names = ["row", "col", "num", "den"] if single else ["row", "col", "s", "v", "i"]
        parts = []
        own = lpdf[lpdf["ask"] == 0]
        if not len(own) or not len(rpdf):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        t_ids, t_first, t_at = np.unique(own["row"].to_numpy(), return_index=True, return_inverse=True)
        t_norm = own["norm"].to_numpy()[t_first]
        t_dim, t_val = own["dim"].to_numpy(), own["value"].to_numpy()
        r_ids, r_first, r_at = np.unique(rpdf["row"].to_numpy(), return_index=True, return_inverse=True)
        r_norm = rpdf["norm"].to_numpy()[r_first]
        r_dim, r_val = rpdf["dim"].to_numpy(), rpdf["value"].to_numpy()
        by_col = np.lexsort((r_at, r_dim))
        c_dim, c_at, c_val = r_dim[by_col], r_at[by_col], r_val[by_col]
        cols, starts = np.unique(c_dim, return_index=True)
        ends = np.r_[starts[1:], len(c_dim)]
        ask = lpdf[lpdf["ask"] == 1]
        ask_at = pd.Series(np.arange(len(t_ids)), index=t_ids).reindex(ask["row"]).to_numpy()
        ask_dim = ask["dim"].to_numpy()
        ok = ~pd.isna(ask_at)
        ask_at, ask_dim = ask_at[ok].astype(int), ask_dim[ok]
        width = max(len(np.unique(t_dim)), len(cols), len(r_ids), 1)
        step = max(1, CELL // width)
        for lo in range(0, len(t_ids), step):
            hi = min(len(t_ids), lo + step)
            m = (t_at >= lo) & (t_at < hi)
            sims = _similarities(np, t_at[m] - lo, t_dim[m], t_val[m], hi - lo, r_at, r_dim, r_val, len(r_ids))
            sims /= np.outer(r_norm, t_norm[lo:hi])
            num = np.zeros((hi - lo, len(cols)))
            den = np.zeros((hi - lo, len(cols)))
            if asked_only:
                w = (ask_at >= lo) & (ask_at < hi)
                wanted = pd.Series(ask_at[w] - lo).groupby(ask_dim[w]).apply(lambda s: s.to_numpy()).to_dict()
            rated = np.zeros((hi - lo, len(cols)), dtype=bool)
            at = np.searchsorted(cols, t_dim[m])
            at[at == len(cols)] = 0
            seen = cols[at] == t_dim[m]
            rated[(t_at[m] - lo)[seen], at[seen]] = True
            for j, (s, e_) in enumerate(zip(starts, ends)):
                if asked_only:
                    rows = wanted.get(cols[j])
                    if rows is None:
                        continue
                else:
                    rows = slice(None)
                raters = c_at[s:e_]
                near = np.ascontiguousarray(sims[raters][:, rows].T)
                if sums:
                    num[rows, j] = near @ c_val[s:e_]
                    den[rows, j] = np.abs(near).sum(axis=1)
                    continue
                top_s, top_v, top_o = _best(np, near, c_val[s:e_], k)
                if single:
                    num[rows, j] = (top_s * top_v).sum(axis=1)
                    den[rows, j] = np.abs(top_s).sum(axis=1)
                    continue
                who = np.arange(hi - lo)[rows]
                if not asked_only:
                    free = ~rated[:, j]
                    who, top_s, top_v, top_o = who[free], top_s[free], top_v[free], top_o[free]
                lists = [list(x) for x in (top_s, top_v, r_ids[raters][top_o])]
                parts.append(pd.DataFrame(dict(zip(names, [t_ids[lo:hi][who], cols[j], *lists]))))
            if not single:
                continue
            good = den > 0
            if not asked_only:
                good &= ~rated
            if cut is not None and final:
                pred = num if sums else np.divide(num, den, out=np.zeros_like(num), where=good)
                good &= _keep(np, np.where(good, pred, -np.inf), cut)
            i, j = np.nonzero(good)
            parts.append(pd.DataFrame({"row": t_ids[lo:hi][i], "col": cols[j], "num": num[i, j], "den": den[i, j]}))
        return pd.concat(parts) if parts else pd.DataFrame({n: pd.Series([], dtype=object) for n in names})

    rk, ck = kind["row"], kind["dim"]
    shape = f"row {rk}, col {ck}, " + (
        "num double, den double" if single else f"s array<double>, v array<double>, i array<{rk}>"
    )
    n_cells = cell_tasks(nt * nr)
    out = (
        left.repartition(n_cells, "t", "r")
        .groupBy("t", "r")
        .cogroup(_renewed(right).repartition(n_cells, "t", "r").groupBy("t", "r"))
        .applyInPandas(predict, shape)
    )
    if not single:
        best = F.slice(
            F.array_sort(
                F.transform(
                    F.flatten(F.collect_list(F.arrays_zip("s", "v", "i"))),
                    lambda c: F.struct((-F.round(c["s"], DIGITS)).alias("o"), c["i"].alias("i"), c["s"].alias("s"), c["v"].alias("v")),
                )
            ),
            1,
            k,
        )
        # a list holds k candidates per rater block
        out = out.groupBy("row", "col").agg(best.alias("b"))
        if lists:
            return out.select(F.col("row").alias(row), F.col("col").alias(col), "b")
        out = out.select(
            "row",
            "col",
            F.aggregate("b", F.lit(0.0), lambda acc, c: acc + c["s"] * c["v"]).alias("num"),
            F.aggregate("b", F.lit(0.0), lambda acc, c: acc + F.abs(c["s"])).alias("den"),
        )
    elif not final:
        out = out.groupBy("row", "col").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    pred = F.col("num") if sums else F.col("num") / F.col("den")
    return out.filter("den > 0").select(F.col("row").alias(row), F.col("col").alias(col), pred.alias("pred"))


def _keep(np, pred, cut):
    """Mask of entries that can be among the ``top`` of their row, ties included.

    For a per-column cut a block sees only some of the rows of a column, so the
    mask keeps the block's own best, which contains every global winner.
    """
    top, per = cut
    axis = 1 if per == "row" else 0
    n = pred.shape[axis]
    if n <= top:
        return np.isfinite(pred)
    score = np.round(pred, DIGITS)
    limit = -np.partition(-score, top - 1, axis=axis)
    limit = limit[:, top - 1 : top] if axis == 1 else limit[top - 1 : top, :]
    return np.isfinite(pred) & (score >= limit)


# --- top-k by vector score ----------------------------------------------------------


def pack(entries: DataFrame, row: str, idx: str, weight: str) -> DataFrame:
    """(id, dims, weights): one row per id; its length is bounded by the vocabulary."""
    packed = entries.groupBy(row).agg(F.collect_list(F.struct(F.col(idx).alias("d"), F.col(weight).cast("double").alias("w"))).alias("e"))
    return packed.select(F.col(row).alias("id"), F.col("e.d").alias("dims"), F.col("e.w").alias("weights"))


def dense(df: DataFrame, row: str, vector: str, keep: list[str] | None = None) -> DataFrame:
    """The same shape for a dense array column."""
    return df.select(
        *(keep or []),
        F.col(row).alias("id"),
        F.sequence(F.lit(0).cast("long"), F.size(vector).cast("long") - 1).alias("dims"),
        F.col(vector).cast("array<double>").alias("weights"),
    )


def _block_rows(vectors: DataFrame) -> tuple[int, int]:
    """(rows, most rows of a block): its entries and its dense matrix stay small."""
    found = vectors.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("dims")).alias("entries"), F.max(F.array_max("dims")).alias("last")).first()
    width = max(1, math.ceil(found["entries"] or 1))
    return found["n"], max(1024, min(BLOCK_ENTRIES // width, CELL // min(512, 1 + (found["last"] or 0))))


def score_top(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    metric: str = "cosine",
    exclude: DataFrame | None = None,
    exclude_self: bool = False,
    limit_col: str | None = None,
    bounds: bool = False,
    query_block: int | None = None,
    item_block: int | None = None,
    plain: bool = False,
) -> DataFrame:
    """(query, item, score, rank): the k best items per query.

    ``queries`` and ``items`` are (id, dims, weights). ``exclude`` is (query,
    item) pairs to skip; each pair travels to the one cell that can use it.
    ``limit_col``: per-query k instead of k.
    ``bounds`` adds ``lo`` and ``hi``: the query's smallest and largest score over
    all items, skipped ones included. Without given sizes a block has about
    ``BLOCK_ENTRIES`` numbers: what is shuffled is the rows times the blocks of the other side.
    ``plain``: all vectors come from ``dense``, and are shuffled without their dims.
    """
    nq_rows, q_most = _block_rows(queries)
    ni_rows, i_most = _block_rows(items)
    ni = block_count(ni_rows, item_block or i_most)
    q_size = min(query_block or q_most, max(32, -(-nq_rows * ni // (2 * _parallelism(queries)))))
    nq = block_count(nq_rows, q_size)
    kind_q, kind_i = dict(queries.dtypes)["id"], dict(items.dtypes)["id"]
    vec = ["dims", "weights"]
    lim = F.col(limit_col).cast("int") if limit_col else F.lit(k)
    if plain:
        queries, items = (df.withColumn("dims", F.lit(None).cast(dict(df.dtypes)["dims"])) for df in (queries, items))
    left = queries.select(
        block_of("id", nq).alias("q"), "id", *vec, F.lit(None).cast("string").alias("flt"), lim.alias("lim"), F.lit("0").cast(kind_i).alias("skip"),
        F.lit(True).alias("ask"),
    ).withColumn("i", _all_blocks(ni))
    if exclude is not None:
        names = exclude.columns
        skips = exclude.select(
            block_of(names[0], nq).alias("q"), F.col(names[0]).alias("id"), *[F.lit(None).cast(dict(queries.dtypes)[c]).alias(c) for c in vec],
            F.lit(None).cast("string").alias("flt"), F.lit(0).alias("lim"), F.col(names[1]).alias("skip"), F.lit(False).alias("ask"),
            block_of(names[1], ni).alias("i"),
        )
        left = left.unionByName(skips)
    tokens = F.lit(None).cast("array<string>").alias("tokens")
    right = items.select(block_of("id", ni).alias("i"), "id", *vec, tokens).withColumn("q", _all_blocks(nq))
    return _score_cells(left, right, k, cell_tasks(nq * ni), ni > 1, metric, exclude_self, False, bool(limit_col), bounds, plain)


def filtered_top(
    queries: DataFrame, items: DataFrame, k: int, filter_col: str, metric: str = "cosine", limit_col: str | None = None,
    query_block: int = 2048, item_block: int = 16_384,
) -> DataFrame:
    """As ``score_top``, for each query only over the items that have all words of its filter.

    Items carry their words in ``tokens``. A query goes to the posting list of the
    rarest word of its filter; only items with a word that some query picked are
    shuffled at all. Long lists, and words that many queries pick, are cut into
    cells. Queries without a filter search everything.
    """
    lim = F.col(limit_col).cast("int") if limit_col else F.lit(k)
    kind_i = dict(items.dtypes)["id"]
    words = F.array_distinct(F.filter(F.split(F.lower(filter_col), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    asked = queries.withColumn("__words", words)
    free = score_top(queries.filter(F.col(filter_col).isNull()), items, k, metric, limit_col=limit_col, query_block=query_block, item_block=item_block)

    each = asked.filter(F.col(filter_col).isNotNull()).select("id", F.explode("__words").alias("word"))
    wanted = cut_lineage(each.select("word").distinct(), "wanted")
    listed = items.select("id", "dims", "weights", "tokens", F.explode(F.array_distinct("tokens")).alias("word"))
    sizes = listed.join(wanted, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # a filter with a word that no item has finds nothing
    counted = each.join(sizes, "word", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("p"))
    picked = cut_lineage(counted.filter("p.n > 0").select("id", F.col("p.word").alias("word"), F.col("p.n").alias("n")), "picked")
    lists = picked.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("nq"), F.ceil(F.max("n") / item_block).cast("int").alias("ni"))
    lists = cut_lineage(lists, "lists")
    cells = lists.agg(F.sum(F.col("nq") * F.col("ni"))).first()[0] or 1

    left = asked.join(picked.drop("n"), "id").join(lists, "word").select(
        F.concat_ws(" ", "word", F.pmod(F.xxhash64("id"), F.col("nq"))).alias("q"), "id", "dims", "weights", F.concat_ws(" ", "__words").alias("flt"), lim.alias("lim"),
        F.lit("0").cast(kind_i).alias("skip"), F.lit(True).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"),
    )
    right = listed.join(lists, "word").select(
        F.pmod(F.xxhash64("id"), F.col("ni")).cast("int").alias("i"), "id", "dims", "weights", "tokens", "word",
        F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("part"),
    )
    right = right.withColumn("q", F.concat_ws(" ", "word", "part")).drop("word", "part")
    return free.unionByName(_score_cells(left, right, k, cell_tasks(cells), True, metric, False, True, bool(limit_col), False))


def _top_of_rows(np, s, lims, slack=0.0, exact=None, whole=None):
    """(row, column, place) of the ``lims`` best scores of each row above -inf, equal rounded scores by column.

    The k-th largest of the maxima of k or more groups of columns is at most the k-th largest
    score, so only scores from there on are rounded and put in order, and only groups that reach it are read again.
    With ``exact(rows, columns)`` and ``whole(row)``, which give the scores themselves, those of ``s`` may be
    off by half of ``slack``.
    """
    most, n = int(lims.max(initial=0)), s.shape[1]
    width = max(1, min(64, n // max(1, 8 * most)))
    groups = n // width
    plain = np.zeros(len(s), bool)
    if 0 < most <= groups:
        highest, rest = s[:, : groups * width].reshape(len(s), width, groups).max(axis=1), s[:, groups * width :]
        bad = np.isnan(highest).any(axis=1) | np.isnan(rest).any(axis=1)
        top = np.sort(np.partition(highest, groups - most, axis=1)[:, groups - most :], axis=1)[:, ::-1]
        least = top[np.arange(len(s)), np.maximum(lims, 1) - 1].astype(float)
        plain = (lims > 0) & ~bad & (least > -np.inf)
        # scores that round to the same are this close
        least = np.where(plain, least - (slack + 2e-9 + 1e-12 * np.abs(least)), np.inf)
        rows, group = np.nonzero(highest >= least[:, None])
        columns = group[:, None] + groups * np.arange(width)
        at, column = np.nonzero(s[rows[:, None], columns] >= least[rows, None])
        behind = np.nonzero(rest >= least[:, None])
        rows, near = np.r_[rows[at], behind[0]], np.r_[columns[at, column], groups * width + behind[1]]
        good = plain[rows]
        rows, near = rows[good], near[good]
        score = s[rows, near] if exact is None else exact(rows, near)
        o = np.lexsort((near, -np.round(score, DIGITS), rows))
        rows, near = rows[o], near[o]
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(heads, np.diff(np.r_[heads, len(rows)])) if len(rows) else rows
        best = place < lims[rows]
        yield rows[best], near[best], place[best] + 1
    for n in np.flatnonzero(~plain):
        row = np.round(s[n] if whole is None else whole(n), DIGITS)
        want = min(lims[n], int((row > -np.inf).sum()))
        if want <= 0:
            continue
        if want < len(row):
            limit = np.partition(row, len(row) - want)[len(row) - want]
            near = np.flatnonzero(row >= limit)
        else:
            near = np.arange(len(row))
        near = near[np.argsort(-row[near], kind="stable")][:want]  # items are in id order
        yield np.full(len(near), n), near, np.arange(1, len(near) + 1)


def _exact_scores(np, left, right, rows, columns):
    """The 64-bit products of pairs of rows of ``left`` and columns of ``right``; of many pairs by the whole product."""
    if len(rows) * 8 > len(left) * right.shape[1]:
        return (left @ right)[rows, columns]
    step = max(1, SCORE_CELL // len(right))
    parts = [np.einsum("ij,ij->i", left[rows[i : i + step]], right.T[columns[i : i + step]]) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _score_cells(left, right, k, n_cells, split, metric, exclude_self, filter_col, limit_col, bounds, plain=False):
    """Top k per query over cells (q, i): queries and pairs to skip on the left, items on the right."""
    kind_q, kind_i = dict(left.dtypes)["id"], dict(right.dtypes)["id"]

    def score(key, lpdf, rpdf):
        import numpy as np
        import pandas as pd

        names = ["query", "item", "score", "rank", "lim", "lo", "hi"]
        empty = pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        skips = lpdf[~lpdf["ask"]]
        asks = lpdf[lpdf["ask"]]
        if not len(asks) or not len(rpdf):
            return empty
        asks = asks.sort_values("id")
        rpdf = rpdf.sort_values("id")
        if plain:
            asks, rpdf = (p.assign(dims=[np.arange(len(w)) for w in p["weights"]]) for p in (asks, rpdf))
        qid, iid = asks["id"].to_numpy(), rpdf["id"].to_numpy()
        q_at, q_dim, q_val = _entries(np, asks)
        r_at, r_dim, r_val = _entries(np, rpdf)
        dims = np.unique(q_dim)
        if not len(dims):
            return empty
        if metric == "cosine":
            q_val = _unit(np, q_at, q_val, len(qid))
            r_val = _unit(np, r_at, r_val, len(iid))
        few = len(dims) <= 512 or len(r_val) * 4 > len(iid) * len(dims)
        right = _dense(np, r_at, r_dim, r_val, len(iid), dims).T if few else None
        # unit rows are compared in 32 bits first; what may be among the best is scored in 64 bits
        short = few and metric == "cosine" and not bounds
        right_short = np.ascontiguousarray(right, np.float32) if short else None
        right = right if short or not few else np.ascontiguousarray(right)
        parts = []
        blocked = {}
        if len(skips):
            at = np.searchsorted(iid, skips["skip"].to_numpy(dtype=iid.dtype))
            at[at == len(iid)] = 0
            there = iid[at] == skips["skip"].to_numpy()
            owner = skips["id"].to_numpy()[there]
            by_owner = np.argsort(owner, kind="stable")
            owners, first = np.unique(owner[by_owner], return_index=True)
            blocked = dict(zip(owners, np.split(at[there][by_owner], first[1:])))
        masks = {}
        if filter_col:
            for f in asks["flt"].dropna().unique():
                masks[f] = np.array([t is not None and set(f.split()) <= set(t) for t in rpdf["tokens"]])
        flts, lims = asks["flt"].to_numpy(), asks["lim"].to_numpy().astype(int)
        repeated = len(iid) > 1 and bool((iid[1:] == iid[:-1]).any())
        if exclude_self and not repeated:
            at = np.searchsorted(iid, qid)
            at[at == len(iid)] = 0
            there = iid[at] == qid
            own_at = [[a] if t else [] for a, t in zip(at.tolist(), there.tolist())]
        step = max(1, (SCORE_CELL * (1 + short) if few else CELL) // max(len(dims), len(iid)))
        for lo in range(0, len(qid), step):
            hi = min(len(qid), lo + step)
            m = slice(*np.searchsorted(q_at, [lo, hi]))
            own = (q_at[m] - lo, q_dim[m], q_val[m], hi - lo)
            exact = whole = None
            slack = 2 * (len(dims) + 8) * 2.0**-24 if short else 0.0  # what rounding adds up to in a product of unit rows, twice
            if short:
                left_rows = _dense(np, *own, dims)
                s = left_rows.astype(np.float32) @ right_short
                exact = functools.partial(_exact_scores, np, left_rows, right)
            elif few:
                s = _dense(np, *own, dims) @ right
            else:
                s = np.ascontiguousarray(_similarities(np, *own, r_at, r_dim, r_val, len(iid)).T)
            low, high = (s.min(axis=1), s.max(axis=1)) if bounds else (np.zeros(hi - lo), np.zeros(hi - lo))
            gone = {}
            for n in range(hi - lo):
                left_out = []
                if filter_col and flts[lo + n] in masks:
                    left_out.append(~masks[flts[lo + n]])
                if qid[lo + n] in blocked:
                    left_out.append(blocked[qid[lo + n]])
                if exclude_self:
                    left_out.append(iid == qid[lo + n] if repeated else own_at[lo + n])
                for columns in left_out:
                    s[n, columns] = -np.inf
                gone[n] = left_out
            if short:

                def whole(n):
                    row = left_rows[n] @ right
                    for columns in gone[n]:
                        row[columns] = -np.inf
                    return row

            for rows, near, place in _top_of_rows(np, s, lims[lo:hi], slack, exact, whole):
                head = (qid[lo:hi][rows], iid[near], exact(rows, near) if short else s[rows, near], place)
                parts.append((*head, lims[lo:hi][rows], low[rows], high[rows]))
        if not parts:
            return empty
        cols = [np.concatenate(c) for c in zip(*parts)]
        return pd.DataFrame(dict(zip(names, cols)))

    found = (
        left.repartition(n_cells, "q", "i")
        .groupBy("q", "i")
        .cogroup(_renewed(right).repartition(n_cells, "q", "i").groupBy("q", "i"))
        .applyInPandas(score, f"query {kind_q}, item {kind_i}, score double, rank int, lim int, lo double, hi double")
    )
    if bounds and split:
        spans = found.groupBy("query").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        found = found.drop("lo", "hi").join(spans, "query")
    elif not bounds:
        found = found.drop("lo", "hi")
    if not split:  # one cell saw all items of a query: its ranks are final
        return found.drop("lim")
    w = W.partitionBy("query").orderBy(F.round("score", DIGITS).desc(), F.asc("item"))
    ranked = found.drop("rank").withColumn("rank", F.row_number().over(w))
    # a literal bound lets Spark cut each partition before the shuffle
    ranked = ranked.filter(F.col("rank") <= k)
    return (ranked.filter(F.col("rank") <= F.col("lim")) if limit_col else ranked).drop("lim")


def approx_top(
    queries: DataFrame, items: DataFrame, k: int, lists: int | None = None, probes: int | None = None, item_block: int = 16_384,
    fit_rows: int = 1_000_000, recall: float = 0.95, tried: int = 400,
) -> DataFrame:
    """(query, item, score, rank): cosine top k among the items of the ``probes`` nearest clusters.

    Clusters, about the root of the number of items, come from k-means over the
    unit vectors of about ``fit_rows`` items, chosen by the hash of their id; every item is placed. A cluster larger than
    ``item_block`` is split by hash, so a popular one is several cells.
    Without ``probes`` they are as many as it takes, at least 8, to find the share
    ``recall`` of the exact top k of ``tried`` queries (the smallest hashes of the ids).
    ``queries`` and ``items`` are (id, vector).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from shelfspark.functions.values import unit

    n = items.count()
    lists = lists or max(1, min(round(n**0.5), fit_rows // 8))

    def units(df):
        return df.select("id", "vector", array_to_vector(unit(F.col("vector").cast("array<double>"))).alias("v"))

    # a share of the hash range: with few items all of them
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(-(-1_000_000 * fit_rows // max(1, n)))
    fit_on = units(items.filter(share))
    model = KMeans(k=lists, featuresCol="v", predictionCol="q", seed=7, maxIter=10).fit(fit_on)
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    placed = model.transform(units(items)).select("id", "vector", "q")
    parts = placed.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / item_block).cast("int").alias("parts"))
    sized = placed.join(F.broadcast(parts), "q")  # one row per cluster
    right = dense(sized, "id", "vector", ["q", "parts"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    if probes is None:
        probes = _probes_for(queries, items, placed, centers, k, recall, tried)
    near = _nearest(queries, centers, min(probes, len(centers)))
    left = dense(near.join(F.broadcast(parts), "q"), "id", "vector", ["q", "parts"])
    no_dims = F.lit(None).cast("array<bigint>").alias("dims")  # the same in all rows
    left = left.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kind_i = dict(right.dtypes)["id"]
    left = left.select(
        "q", "id", no_dims, "weights", F.lit(None).cast("string").alias("flt"), F.lit(k).alias("lim"),
        F.lit("0").cast(kind_i).alias("skip"), F.lit(True).alias("ask"), "i",
    )
    right = right.select("i", "id", no_dims, "weights", F.lit(None).cast("array<string>").alias("tokens"), "q")
    return _score_cells(left, right, k, cell_tasks(lists), True, "cosine", False, False, False, False, plain=True)


def _probes_for(queries: DataFrame, items: DataFrame, placed: DataFrame, centers: list[list[float]], k: int, recall: float, tried: int) -> int:
    """How many clusters hold the share ``recall`` of the exact top k of some queries."""
    import numpy as np

    picked = queries.select("id", "vector").orderBy(F.xxhash64("id", F.lit("probes")), "id").limit(tried).collect()
    if not picked:
        return 8
    asked = queries.sparkSession.createDataFrame(picked, queries.select("id", "vector").schema)
    exact = score_top(dense(asked, "id", "vector"), dense(items, "id", "vector"), k, plain=True)
    # at most ``tried`` times k rows
    cells = placed.select(F.col("id").alias("item"), "q").join(F.broadcast(exact.select("query", "item")), "item")
    held: dict = {}
    for r in cells.collect():
        held.setdefault(r["query"], []).append(r["q"])
    c = np.array(centers)
    places = []
    for r in picked:
        v = np.asarray(r["vector"], dtype=float)
        far = (c * c).sum(axis=1) - 2 * (v / max(np.linalg.norm(v), 1e-12)) @ c.T
        place = np.empty(len(c), int)
        place[np.argsort(far, kind="stable")] = np.arange(len(c))
        places += place[held.get(r["id"], [])].tolist()
    if not places:
        return 8
    return max(8, 1 + sorted(places)[min(len(places), math.ceil(recall * len(places))) - 1])


def _nearest(queries: DataFrame, centers: list[list[float]], probes: int) -> DataFrame:
    """(id, vector, q): each query with its ``probes`` nearest centres, in Arrow batches."""

    def assign(batches):
        import numpy as np
        import pandas as pd

        c = np.array(centers)
        # a batch of queries times the probes would be large
        for pdf in (batch[at : at + NEAREST] for batch in batches for at in range(0, max(1, len(batch)), NEAREST)):
            v = np.stack([np.asarray(x, dtype=float) for x in pdf["vector"]]) if len(pdf) else np.zeros((0, c.shape[1]))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            far = (c * c).sum(axis=1) - 2 * v @ c.T
            best = np.argsort(far, axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame(
                {
                    "id": np.repeat(pdf["id"].to_numpy(), probes),
                    "vector": [x for x in pdf["vector"] for _ in range(probes)],
                    "q": best.ravel(),
                }
            )

    kinds = dict(queries.dtypes)
    return queries.select("id", "vector").mapInPandas(assign, f"id {kinds['id']}, vector {kinds['vector']}, q int")
