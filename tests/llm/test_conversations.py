"""Repair of conversations against enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelfspark.llm import conversation_repair as repair, queries

DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, whole string, part int, idx int, cost long"


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def outcome(code, audit):
    """Cost of an audit, None if it does not give a legal sequence of roles."""
    out, cost, at = "", 0, 0
    for edit in audit:
        if edit == "I":
            cost += 2
            out += "a" if out[-1:] == "u" else "u"
            continue
        if at == len(code):
            return None
        c = code[at]
        at += 1
        if edit == "D":
            cost += 3
            continue
        if c == "x":
            return None
        cost += (2 if edit == "R" else 0) + c.isupper()
        out += ("a" if out[-1:] == "u" else "u") if edit == "R" else c.lower()
    return cost if at == len(code) and re.fullmatch("(s?(ua)+)?", out) else None


def test_every_short_code():
    for n in range(3):
        audits = ["".join(a) for k in range(n + 5) for a in itertools.product("DIKR", repeat=k) if k - a.count("I") == n]
        for code in map("".join, itertools.product("suaoSUAOx", repeat=n)):
            wanted = min((cost, a) for a in audits if (cost := outcome(code, a)) is not None)
            assert repair.cheapest(code) == wanted, code


def planned(code):
    """Cheapest, least audit, row by row from the back over the last role written."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    rest = None
    for at in range(len(code), -1, -1):
        here = {last: [] for last in after}
        if at == len(code):
            here[""], here["a"] = [(0, "")], [(0, "")]
        else:
            c = code[at]
            for last, to in after.items():
                here[last].append((3 + rest[last][0], "D" + rest[last][1]))
                if c != "x":
                    here[last].append((2 + c.isupper() + rest[to][0], "R" + rest[to][1]))
                    if last + c.lower() in ("s", "u", "su", "ua", "au"):
                        here[last].append((c.isupper() + rest[c.lower()][0], "K" + rest[c.lower()][1]))
        for _ in range(4):
            for last, to in after.items():
                if here[to]:
                    cost, audit = min(here[to])
                    here[last].append((2 + cost, f"I{audit}"))
        rest = {last: min(found) for last, found in here.items()}
    return rest[""]


def test_longer_codes():
    rng = random.Random(1)
    for _ in range(3000):
        code = "".join(rng.choice(rng.choice(["ua", "uaS", "suaoSUAOx", "x", "UA"])) for _ in range(rng.randrange(14)))
        assert repair.cheapest(code) == planned(code), code


def test_blocks_join():
    """Ways of blocks, joined, are the ways of the whole."""
    rng = random.Random(2)
    for _ in range(150):
        code = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(1, 24)))
        cuts = sorted(rng.sample(range(len(code) + 1), rng.randrange(2)) + [0, len(code)])
        parts = [repair.ways(code[a:b]) for a, b in zip(cuts, cuts[1:])]
        through = parts[0]
        for part in parts[1:]:
            through = repair.joined(through, part)
        assert through == repair.ways(code)
        assert min(through[q] for q in repair.ACCEPTED) == planned(code)


def brute(rows):
    """Rows of the query for (conv_id, turn, role, text); turns of a conversation are distinct or their rows alike."""
    kept = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ")):
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        kept[conv] += [(turn, "user" if act == 4 else role, text)] * {0: 0, 3: 2}.get(act, 1)
    out = []
    for conv, some in kept.items():
        blank = duplicate = truncated = 0
        seen, code = set(), ""
        for _, role, text in some:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            c = role[:1] if role[:1] and role[:1] in "sua" else "o"
            if not bare:
                blank, c = blank + 1, "x"
            elif (role, text) in seen:
                duplicate, c = duplicate + 1, "x"
            elif bare[-1] not in ".!?":
                truncated, c = truncated + 1, c.upper()
            code += c
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        turns = {t for t, _, _ in some if t is not None}
        cost, audit = planned(code)
        lines, last, left = [], "", iter(some)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit != "D":
                last = role[:1] if edit == "K" else "a" if last == "u" else "u"
                lines.append(f"{role if edit == 'K' else 'user' if last == 'u' else 'assistant'}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(n, seed, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "What?  ", "cut off", "", " \n", "a.b", None, "é日本."]
    roles = ["user", "assistant", "system", "tool", None, "User", ""]
    out = []
    for conv in [None, *range(n)]:
        turn = None if rng.random() < 0.3 else rng.randrange(3)
        for k in range(rng.randrange(1, longest)):
            role = rng.choice(roles) if rng.random() < 0.2 else roles[k % 2]
            out.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.4 else f"line {rng.randrange(9)}."))
            turn = rng.randrange(2) if turn is None else turn + rng.choice([1, 1, 1, 3])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("limits", [{}, {"block": 2, "fan": 2}, {"block": 1, "fan": 3, "block_bytes": 30}])
def test_repair_against_brute_force(spark, limits):
    some = conversations(60, 5)
    assert collected(repair.repair(frame(spark, some).repartition(3), **limits), *repair.RESULT) == brute(some)


def test_hot_conversation(spark):
    """Most rows are of one conversation, which lies in all tasks."""
    rng = random.Random(7)
    hot = [(7, t, ("user", "assistant")[(t + (rng.random() < 0.05)) % 2], f"text {rng.randrange(300)}{rng.choice('..?,')}") for t in range(900)]
    some = hot + conversations(6, 8)
    some = [r for r in some if r[0] != 7 or r in hot]
    got = repair.repair(frame(spark, some), block=32, fan=4)
    assert collected(got, *repair.RESULT) == brute(some)


def test_empty_and_alike(spark):
    assert repair.repair(frame(spark, [])).count() == 0
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    some = [(c, 0, "user", "Hi.") for c in gone] + [(None, None, None, None)] * 3 + [(-1, 4, "user", "x" * 100_000)] * 2
    got = collected(repair.repair(frame(spark, some)), *repair.RESULT)
    assert got == brute(some)
    nothing = hashlib.sha256(b"").hexdigest()
    assert all((c, 0, 0, 0, 0, 0, 0, "", nothing) in got for c in gone)


@pytest.mark.parametrize("folder", [DIR, "/root/testdata/sf0.01"])
def test_repair_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert collected(queries.QUERIES["op13_conversation_repair"](spark, folder), *repair.RESULT) == brute([tuple(r) for r in rows])
