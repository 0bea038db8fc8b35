import itertools
import os
import random
import re
import zlib
from hashlib import sha256

import pytest

from loomgraph.llm import conversation_repair as C

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def cheapest(rows):
    """All edit strings with up to three inserts in a row, for a few rows of (role, text, problem)."""
    best = None
    gaps = ["I" * n for n in range(4)]
    for ops in itertools.product("DKR", repeat=len(rows)):
        if any(o != "D" and p in ("blank", "duplicate") for o, (_, _, p) in zip(ops, rows)):
            continue
        cost = sum({"D": 3, "K": 0, "R": 2}[o] + (o != "D" and p == "truncated") for o, (_, _, p) in zip(ops, rows))
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            total = cost + 2 * sum(map(len, ins))
            if best is not None and total > best[0]:
                continue
            audit = "".join(a + b for a, b in zip(ins, (*ops, "")))
            # inserted and reroled turns may take either role
            free, n = [], 0
            slots, i = [], 0
            for x in audit:
                if x == "I":
                    slots.append(None)
                else:
                    if x == "R":
                        slots.append(None)
                    elif x == "K":
                        slots.append(rows[i][0][:1])
                    i += 1
            free = [k for k, v in enumerate(slots) if v is None]
            for fill in itertools.product("ua", repeat=len(free)):
                whole = list(slots)
                for k, v in zip(free, fill):
                    whole[k] = v
                if all(len(v) == 1 for v in whole) and re.fullmatch("(s?(ua)+)?", "".join(whole)):
                    if best is None or (total, audit) < best[:2]:
                        best = (total, audit)
                    break
    return best


def plain(rows):
    """A conversation's counts, by the contract's words; rows of (turn, role, text) in order."""
    n = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    out = []
    for i, (_, role, text) in enumerate(rows):
        said = text.strip(SPACE)
        p = "blank" if not said else "duplicate" if (role, text) in [r[1:] for r in rows[:i]] else "truncated" if said[-1] not in ".!?" else ""
        if p:
            n[p] += 1
        out.append((role, text, p))
    turns = [t for t, _, _ in rows if t is not None]
    n["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return n, out


def some(rng, n):
    rows = [(rng.choice([None, rng.randrange(6)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b!", "c?", "d", " ", "", "ü. \n", "e.x"])) for _ in range(n)]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_cheapest_edits_by_enumeration():
    rng = random.Random(5)
    for k in range(250):
        rows = some(rng, rng.choice([0, 1, 2, 3, 3, 4]))
        n, marked = plain(rows)
        got, want = C.finish(rows), cheapest(marked)
        assert (got["cost"], got["audit"]) == want, rows
        assert {c: got[c] for c in n} == n
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in got["repaired"]))


def test_letters_of_a_long_conversation():
    # one turn must be added, anywhere: of equal costs the least letters add it first
    got = C.finish([(i, "user", f"{i}.") for i in range(2001)])
    assert (got["cost"], got["audit"]) == (2002, "KI" + "KR" * 1000)
    got = C.finish([(i, "assistant", f"{i}.") for i in range(2001)])
    assert (got["cost"], got["audit"]) == (2002, "IK" + "RK" * 1000)


def ledger(df):
    return {r.conv: r.asDict() for r in C.digests(df).collect()}


def reference(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == conv]
        got = C.finish(own)
        text = "\n".join(f"{r['role']}:{r['text']}" for r in got["repaired"])
        out[conv] = {"conv": conv, "repaired_sha256": sha256(text.encode()).hexdigest()} | {k: got[k] for k in (*C.COUNTS, "audit")}
    return out


def ordered(spark, rows):
    """Rows in the operator's order: by turn, role and hash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").withColumn("h", F.xxhash64("text"))
    return [tuple(r)[:4] for r in df.orderBy("conv", "turn", "role", "h").collect()]


@pytest.mark.parametrize(("most", "block"), [(4 << 20, 4096), (1, 3), (400, 1), (2000, 7)])
def test_whole_and_in_blocks(spark, most, block):
    rng = random.Random(9)
    rows = []
    for conv in [None, 1, 2, 3, 4, 5]:
        rows += [(conv, t, r or "tool", x) for t, r, x in some(rng, rng.choice([1, 5, 40]))]
    rows += [(6, i, rng.choice(["user", "user", "assistant"]), rng.choice([f"{i}.", f"{i}", "ok."])) for i in range(300)]
    rows += [(7, 1, "user", "same.")] * 50  # one repeated row
    rows = ordered(spark, rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert ledger(C.repair(df, most_bytes=most, block=block)) == reference(rows)


def test_nulls_empty_and_clashes(spark):
    shape = "conv_id long, turn long, role string, text string, piece string, part string, audit string"
    df = spark.createDataFrame([(1, None, None, None, "x", "y", "z"), (1, 0, "user", "a.", "x", "y", "z")], shape)
    got = ledger(C.repair(df))[1]
    # the first row's role and text are a space: it is blank and goes; the user's turn gets an answer
    assert (got["blank"], got["audit"], got["cost"], got["gaps"], got["illegal"]) == (1, "DKI", 5, 0, 1)
    assert got["repaired_sha256"] == sha256(b"user:a.\nassistant:").hexdigest()
    assert C.repair(df.limit(0)).count() == 0
    long = "word " * 300_000 + "."
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    got = ledger(C.repair(df))[1]
    assert got["audit"] == "KK" and got["repaired_sha256"] == sha256(f"user:{long}\nassistant:b.".encode()).hexdigest()


def brute(rows):
    """The query's result, from the table's rows, without Spark."""
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        own += [] if h == 0 else [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, own in by.items():
        got = C.finish(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)))
        text = "\n".join(f"{r['role']}:{r['text']}" for r in got["repaired"])
        out.append((conv, *(got[k] for k in C.COUNTS), got["audit"], sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_op13_against_rows_without_spark(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = C.op13(spark, SF)
    assert got.columns == ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_op13_conversation_without_rows(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "a."), (None, 3, "user", "b.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in C.op13(spark, str(tmp_path)).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) and set(got) == {gone, None}
