"""Cheapest edits that give a conversation its form back, by bidirectional Dijkstra over the edit lattice.

A lattice node is (rows done, state): nothing yet, after the system row, after a
user row, after an assistant row. Keep, rerole and delete lead to the next row,
insert stays at the row. A forward heap starts at the first node and a reverse
heap at the accepting ones; whoever has the smaller key goes on, until the keys
together exceed the cheapest crossing, so that every crossing of that cost is
finished. Of these the one whose joined audit is least in ASCII wins. Heap keys are
(cost, rows done, audit): only keeping costs nothing, and it leads one row on, so
that a node is taken out with its least audit. Two audits of equal cost that end in
the same node are never one the beginning of the other, and so stay in order
whatever follows.

Rows are dealt by ranges of (conversation, turn) and sorted, so that a
conversation with a large part of all rows lies in many tasks. One that begins and
ends inside a task and is short is solved there. The others go row by row into a
table, cut into blocks of at most ``BLOCK`` rows. Each block is solved from every
state to every state (Dijkstra, as above), and blocks are joined ``FAN`` at a time by
the cheapest, least audit over the state between them, so no task ever holds a
conversation. Only the digest of the repaired text is sequential by its nature: the
rows of a long conversation pass through one task in order, one batch at a time.

Results for odd input: a null role or text counts as one space, a null
conversation is one conversation, and null turns come first. Rows that share a
turn are ordered by role and a hash of the text. A role is legal by its first
letter alone; other roles can only be reroled or deleted. A conversation without rows
gives zeros, an empty audit and the digest of the empty string. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.llm.rows import bounded_batches
from shelfspark.runtime import cut_lineage

#: Rows of a block, and of a conversation that is solved at once.
BLOCK = 256
#: Bytes of text of a conversation that is solved at once.
BLOCK_BYTES = 4 << 20
#: Blocks that are joined in one group.
FAN = 64

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (EMPTY, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: The state after a row of the only role that an insert or rerole may have here.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a kept row, by its initial.
KEPT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
_NEVER = 1 << 60
_BLANKS = " \t\n\x0b\x0c\r"


def _steps(letter: str) -> list[tuple[int, int, int, str]]:
    """Edges of a row: (state, next state, cost, edit). Upper case is a truncated row, x one that has to go."""
    out = [(q, q, DELETE, "D") for q in range(4)]
    if letter != "x":
        more = CUT_OFF if letter.isupper() else 0
        out += [(q, to, KEEP + more, "K") for q, to in KEPT[letter.lower()].items()]
        out += [(q, NEXT[q], REROLE + more, "R") for q in range(4)]
    return out


AHEAD = {c: [[(to, n, e) for q, to, n, e in _steps(c) if q == at] for at in range(4)] for c in "suaoSUAOx"}
BACK = {c: [[(q, n, e) for q, to, n, e in _steps(c) if to == at] for at in range(4)] for c in "suaoSUAOx"}
BEFORE = [[q for q in range(4) if NEXT[q] == at] for at in range(4)]


def cheapest(code: str, start: int = EMPTY, goals: tuple[int, ...] = ACCEPTED) -> tuple[int, str] | None:
    """Cost and least audit from a state before the first row to one of the goals behind the last; None if there is no way."""
    size = len(code)
    done: dict[tuple[int, int], tuple[int, str]] = {}
    left: dict[tuple[int, int], tuple[int, str]] = {}
    ahead = [(0, 0, "", start)]
    back = [(0, 0, "", q) for q in goals]
    best = _NEVER
    while ahead or back:
        near, far = (ahead[0][0] if ahead else _NEVER), (back[0][0] if back else _NEVER)
        if far > 0 and near + far > best:
            break
        if near <= far:
            cost, row, audit, q = heapq.heappop(ahead)
            if (row, q) in done:
                continue
            done[row, q] = cost, audit
            if (row, q) in left:
                best = min(best, cost + left[row, q][0])
            edges = [(row, NEXT[q], INSERT, "I")]
            if row < size:
                edges += [(row + 1, *edge) for edge in AHEAD[code[row]][q]]
            for to_row, to, n, edit in edges:
                if (to_row, to) in left:
                    best = min(best, cost + n + left[to_row, to][0])
                if (to_row, to) not in done:
                    heapq.heappush(ahead, (cost + n, to_row, audit + edit, to))
        else:
            cost, behind, audit, q = heapq.heappop(back)
            row = size - behind
            if (row, q) in left:
                continue
            left[row, q] = cost, audit
            if (row, q) in done:
                best = min(best, cost + done[row, q][0])
            edges = [(row, p, INSERT, "I") for p in BEFORE[q]]
            if row:
                edges += [(row - 1, *edge) for edge in BACK[code[row - 1]][q]]
            for from_row, p, n, edit in edges:
                if (from_row, p) in done:
                    best = min(best, cost + n + done[from_row, p][0])
                if (from_row, p) not in left:
                    heapq.heappush(back, (cost + n, size - from_row, edit + audit, p))
    if best == _NEVER:
        return None
    crossings = []
    for (row, q), (cost, audit) in done.items():
        edges = [(row, q, 0, ""), (row, NEXT[q], INSERT, "I")]
        if row < size:
            edges += [(row + 1, *edge) for edge in AHEAD[code[row]][q]]
        for to_row, to, n, edit in edges:
            rest = left.get((to_row, to))
            if rest is not None and cost + n + rest[0] == best:
                crossings.append(audit + edit + rest[1])
    return best, min(crossings)


@lru_cache(maxsize=50_000)
def _short(code: str) -> tuple[int, str]:
    return cheapest(code)


#: Way from each state to each state: (cost, audit), None where there is none.
Ways = list[tuple[int, str] | None]


def ways(code: str) -> Ways:
    return [cheapest(code, q, (to,)) for q in range(4) for to in range(4)]


def joined(one: Ways, two: Ways) -> Ways:
    """The ways through both, the cheapest and least over the state between them."""
    out: Ways = []
    for q in range(4):
        for to in range(4):
            through = [(one[4 * q + m], two[4 * m + to]) for m in range(4)]
            found = [(a[0] + b[0], a[1] + b[1]) for a, b in through if a is not None and b is not None]
            out.append(min(found, default=None))
    return out


def letter(role: str, text: str) -> str:
    """Initial of a row, upper case if its text is truncated, b in front if it is blank."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    bare = text.rstrip(_BLANKS)
    if not bare:
        return f"b{initial}"
    return initial if bare[-1] in ".!?" else initial.upper()


class Summary:
    """Figures of consecutive rows; figures of neighbours add up."""

    FIELDS = ("n", "blank", "duplicate", "truncated", "illegal")

    def __init__(self) -> None:
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = ""
        self.low = self.high = None
        self.turns = 0

    def add(self, mark: str, duplicate: bool, turn: int | None) -> str:
        """Count a row; the letter of the lattice."""
        one = Summary()
        one.n, one.first = 1, mark[-1].lower()
        one.last = one.first
        one.blank = int(len(mark) > 1)
        one.duplicate = int(duplicate and not one.blank)
        one.truncated = int(mark.isupper() and not one.duplicate)
        if turn is not None:
            one.low, one.high, one.turns = turn, turn, 1
        self.join(one)
        return "x" if one.blank or one.duplicate else mark

    def join(self, other: Summary) -> None:
        """Take in the rows that follow, whose turns are not below."""
        if not other.n:
            return
        for f in self.FIELDS:
            setattr(self, f, getattr(self, f) + getattr(other, f))
        self.illegal += bool(self.last) and self.last + other.first not in ("su", "ua", "au")
        self.first, self.last = self.first or other.first, other.last
        if other.turns:
            self.turns += other.turns - (self.turns > 0 and self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    @property
    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0

    def values(self) -> list:
        return [*(getattr(self, f) for f in self.FIELDS), self.first, self.last, self.low, self.high, self.turns]

    @classmethod
    def of(cls, values: list) -> Summary:
        out = cls()
        for f, v in zip((*cls.FIELDS, "first", "last", "low", "high", "turns"), values, strict=True):
            setattr(out, f, v)
        return out


_SUMMARY = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


class Repair:
    """Digest of a conversation's repaired rows, which come one by one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.lines, self.sha = audit, 0, EMPTY, 0, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
        self.lines += 1

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self._line("user" if self.state == USER else "assistant", "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = NEXT[self.state]
            self._line("user" if self.state == USER else "assistant", text)
        elif edit == "K":
            self.state = KEPT[role[:1]][self.state]
            self._line(role, text)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, copy: what the crc32 of ``conv_id:turn`` modulo 20 does to each row.

    0 drops it (``gone``: the row stays as a sign of its conversation), 1 empties
    the text, 2 takes its sentence marks away, 3 repeats the row, 4 makes it the user's.
    """

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    act = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(act == 1, "").when(act == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(act == 4, "user").otherwise(filled("role")).alias("role"),
        F.when(act == 0, "").otherwise(text).alias("text"),
        (act == 0).alias("gone"),
        F.explode(F.when(act == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


_FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _figures(summary: Summary, cost: int, audit: str, digest: str) -> list:
    return [summary.gaps, summary.blank, summary.duplicate, summary.truncated, summary.illegal, cost, audit, digest]


def _batches(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(conv: pa.DataType, fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([("conv_id", conv), *((name, kinds[kind]) for name, kind in (f.rsplit(" ", 1) for f in fields.split(", ")))])


_SOLVED = f"whole boolean, {_FIGURES}, part long, idx long, turn long, role string, text string, mark string"


def _solve(block: int, block_bytes: int) -> Callable:
    """Sorted rows of a task: conversations that lie within it solved, the rows of others numbered."""

    def solved(conv, rows: list) -> list:
        summary, code, seen = Summary(), [], set()
        rows = [r for r in rows if not r[3]]
        for turn, role, text, _ in rows:
            code.append(summary.add(letter(role, text), (role, text) in seen, turn))
            seen.add((role, text))
        cost, audit = _short("".join(code))
        repair = Repair(audit)
        for _, role, text, _ in rows:
            repair.row(role, text)
        return [conv, True, *_figures(summary, cost, audit, repair.digest()), *[None] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list = []  # rows of the conversation that are not yet sent
        size = sent = 0
        now, first, begun, out = None, True, False, []
        schema = None

        def send(rows: list) -> None:
            nonlocal sent
            for turn, role, text, gone in rows:
                out.append([now, False, *[None] * 8, part, sent, turn, role, text, "" if gone else letter(role, text)])
                sent += 1

        for batch in batches:
            schema = schema or _arrow(batch.schema.field(0).type, _SOLVED)
            for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if not begun or conv != now:
                    if begun:
                        if first or sent:
                            send(held)
                        else:
                            out.append(solved(now, held))
                        first = False
                    now, begun, held, size, sent = conv, True, [], 0, 0
                held.append((turn, role, text, gone))
                size += len(text)
                if len(held) > block or size > block_bytes:
                    send(held)
                    held, size = [], 0
            if out:
                yield _batches(out, schema)
                out.clear()
        if begun:
            send(held)  # it may go on in the next task
            if out:
                yield _batches(out, schema)

    return run


_WAYS = f"part long, block long, {_SUMMARY}, costs array<long>, audits array<string>"


def _block(table: pa.Table) -> list[list]:
    """A row for the block whose rows the table holds."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("idx", "mark", "repeated", "turn")), strict=True))
    summary = Summary()
    code = "".join(summary.add(mark, repeated, turn) for _, mark, repeated, turn in rows if mark)
    found = ways(code)
    return [[*summary.values(), [w and w[0] for w in found], [w and w[1] for w in found]]]


def _fold(table: pa.Table) -> list[list]:
    """A row for the blocks of the table, joined in order."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
    summary, through = Summary(), None
    for r in rows:
        summary.join(Summary.of([r[f.split()[0]] for f in _SUMMARY.split(", ")]))
        these = [None if n is None else (n, a) for n, a in zip(r["costs"], r["audits"], strict=True)]
        through = these if through is None else joined(through, these)
    return [[*summary.values(), [w and w[0] for w in through], [w and w[1] for w in through]]]


def _grouped(rows: DataFrame, part: Column, block: Column, of_group: Callable[[pa.Table], list[list]], conv: str) -> DataFrame:
    """One row for each (conversation, part, block)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        schema = _arrow(table.schema.field("conv_id").type, _WAYS)
        (found,) = of_group(table)
        return pa.Table.from_batches([_batches([[table.column("conv_id")[0].as_py(), key[1].as_py(), key[2].as_py(), *found]], schema)])

    keyed = rows.withColumns({"__part": part, "__block": block})
    return keyed.groupBy("conv_id", "__part", "__block").applyInArrow(run, f"conv_id {conv}, {_WAYS}")


def _digests() -> Callable:
    """Rows of (conversation, part, idx) order, in front of each conversation's rows the one with its figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, repair, out, schema = None, None, [], None

        def end() -> None:
            held[-1] = repair.digest()
            out.append(held)

        for batch in batches:
            schema = schema or _arrow(batch.schema.field(0).type, _FIGURES)
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if row["part"] < 0:
                    if held is not None:
                        end()
                    held = [row[c] for c in RESULT]
                    repair = Repair(row["audit"])
                elif row["mark"]:
                    repair.row(row["role"], row["text"])
            if out:
                yield _batches(out, schema)
                out.clear()
        if held is not None:
            end()
            yield _batches(out, schema)

    return run


def repair(conversations: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of damaged conversations."""
    bounded_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations).withColumn("tie", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "tie", "copy"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone")
    solved = cut_lineage(dealt.mapInArrow(_solve(block, block_bytes), f"conv_id {kind}, {_SOLVED}"), "conversations")
    whole = solved.filter("whole").select(*RESULT)
    open_rows = solved.filter("not whole")
    ends = open_rows.agg(F.max("idx").alias("idx"), F.max("part").alias("part")).first()
    if ends.idx is None:
        return whole

    # a row repeats if the conversation has its role and text further up
    place = F.struct("part", "idx")
    spoken = open_rows.filter(F.length("mark") == 1).withColumn("digest", F.sha2("text", 256))
    firsts = spoken.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    key = ["conv_id", "role", "digest"]
    right = firsts.select(*[F.col(c).alias(f"of_{c}") for c in key], "first")
    met = spoken.join(right, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key])
    columns = ["conv_id", "part", "idx", "turn", "mark"]
    marked = met.select(*columns, (place > F.col("first")).alias("repeated")).unionByName(
        open_rows.filter(F.length("mark") != 1).select(*columns, F.lit(False).alias("repeated"))
    )

    # blocks within a task, then tasks, ``fan`` at a time
    found = _grouped(marked, F.col("part"), F.floor(F.col("idx") / block), _block, kind)
    most = ends.idx // block
    while most:
        found = _grouped(found, F.col("part"), F.floor(F.col("block") / fan), _fold, kind)
        most //= fan
    most = ends.part
    while most:
        found = _grouped(found, F.floor(F.col("part") / fan), F.lit(0).cast("long"), _fold, kind)
        most //= fan

    # the better of the accepting states, which deleting or inserting rows always reaches
    accepted = [F.struct(F.col("costs")[q].alias("cost"), F.col("audits")[q].alias("audit")) for q in ACCEPTED]
    ends_at = F.least(*accepted)
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    figures = found.withColumn("end", ends_at).select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit"),
        F.lit("").alias("repaired_sha256"), F.lit(-1).cast("long").alias("part"), F.lit(-1).cast("long").alias("idx"),
        *[F.lit("").alias(c) for c in ("role", "text", "mark")],
    )
    lines = open_rows.select("conv_id", "part", "idx", "role", "text", "mark")
    flow = figures.unionByName(lines, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx")
    return whole.unionByName(flow.mapInArrow(_digests(), f"conv_id {kind}, {_FIGURES}"))
