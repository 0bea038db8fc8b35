"""Conversation structure repair: weighted finite-state composition and its shortest path.

Three machines are composed: an acceptor of a conversation's rows (one arc a row: the role's initial, whether the
row must go, whether it is truncated), a transducer of edits (keep, rerole, delete a row, insert an empty turn; each
with its cost and its letter) and an acceptor of the role grammar `(s?(ua)+)?`. Composed states are pairs of a place
and a grammar state and are expanded when they are reached. Between two rows at most three turns are inserted, as a
grammar state that comes back at one place has only cost more; so the composition has no cycle, and one pass in the
order of places finds the least path. Weights are pairs (cost, letters), compared in that order. Letters aren't
compared as texts: at a place, each state holds the rank of its letters up to the last consumed row, and no two of
these begin one another. Steps depend on the row's class, the relative costs and the ranks only and are remembered.

Rows are range-partitioned by conversation and turn, so one conversation may span many tasks. What lies whole
inside a task and is small is finished there. The other rows (the first and last conversation of each task, and
long ones) go in blocks of bounded length: each block gives its least cost and rank from every grammar state to
every other, the few numbers of a conversation's blocks are folded in order, and each block is then walked between
the states that the fold chose.

Defined results: within a conversation rows are ordered by turn (nulls first), then by role, then by a hash of the
text, so equal rows are adjacent. A null role or text counts as one space. A role that is empty or starts with another
letter than s, u, a fits nowhere in the grammar. A null conversation id is a conversation of its own. Texts may be of
any length. An empty table gives an empty result; columns beyond the four named ones aren't read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import scratch, slices, table, tasks

#: The role grammar: (state, initial) -> state. States 0 and 3 accept.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits, by their letters, and what a truncated row adds that stays.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
SPACE = b" \t\n\x0b\f\r"

#: A row's class: the role's initial ("" if no grammar state takes it), whether it must go, whether it is truncated.
Class = tuple[str, bool, bool]
#: For each grammar state the cost above the least one and the rank of the letters; None where it can't be reached.
Weights = tuple[tuple[int, int] | None, ...]


@cache
def inserts(state: int) -> tuple[int, ...]:
    """The grammar states after 0, 1, ... inserted turns, each state once."""
    out = [state]
    while (nxt := next((GRAMMAR[out[-1], r] for r in ROLES if (out[-1], r) in GRAMMAR), None)) is not None and nxt not in out:
        out.append(nxt)
    return tuple(out)


@cache
def expand(state: int, row: Class) -> dict[int, tuple[int, str]]:
    """Arcs of the composed machine over one row: for each next grammar state the least cost and letters."""
    initial, must_go, truncated = row
    best: dict[int, tuple[int, str]] = {}

    def arc(to, cost, letters):
        if to is not None and (to not in best or (cost, letters) < best[to]):
            best[to] = (cost, letters)

    for n, q in enumerate(inserts(state)):
        before, letters = n * COST["I"], "I" * n
        arc(q, before + COST["D"], letters + "D")
        if not must_go:
            stays = before + (TRUNCATED if truncated else 0)
            arc(GRAMMAR.get((q, initial)), stays + COST["K"], letters + "K")
            for r in ROLES:
                arc(GRAMMAR.get((q, r)), stays + COST["R"], letters + "R")
    return best


@lru_cache(1 << 16)
def step(weights: Weights, row: Class) -> tuple[Weights, int, tuple]:
    """The weights after one row, what was taken off them, and for each state where it came from: (state, letters)."""
    best: dict[int, tuple] = {}
    for q, w in enumerate(weights):
        if w is not None:
            for to, (cost, letters) in expand(q, row).items():
                key = (w[0] + cost, w[1], letters, q)
                if to not in best or key < best[to]:
                    best[to] = key
    least = min(k[0] for k in best.values())
    ranks = {to: r for r, to in enumerate(sorted(best, key=lambda to: best[to][1:]))}
    states = range(len(weights))
    return tuple((best[q][0] - least, ranks[q]) if q in best else None for q in states), least, tuple((best[q][3], best[q][2]) if q in best else None for q in states)


def start(state: int = 0) -> Weights:
    return tuple((0, 0) if q == state else None for q in range(4))


def walk(rows: list[Class], weights: Weights) -> tuple[Weights, int, list[tuple]]:
    """Weights after all rows, their total reduction and the way back."""
    total, back = 0, []
    for row in rows:
        weights, less, came = step(weights, row)
        total += less
        back.append(came)
    return weights, total, back


def close(weights: Weights) -> tuple[int, int, int]:
    """The least way from the last row to an accepting state: cost, state before it, number of inserted turns."""
    ends = [(w[0] + n * COST["I"], w[1], "I" * n, q, n) for q, w in enumerate(weights) if w is not None for n, to in enumerate(inserts(q)) if to in FINAL]
    cost, _, _, q, n = min(ends)
    return cost, q, n


def letters_to(back: list[tuple], state: int) -> str:
    out = []
    for came in reversed(back):
        state, letters = came[state]
        out.append(letters)
    return "".join(reversed(out))


def rewrite(letters: str, state: int, rows: list[tuple[str, str]], initials: list[str]) -> list[dict[str, str]]:
    """The repaired rows that an edit's letters make out of rows, from a grammar state."""
    out, i = [], 0
    for x in letters:
        if x in "KR":
            role, text = rows[i]
        if x in "RI":
            role = next(ROLES[r] for r in ROLES if (state, r) in GRAMMAR)
            text = text if x == "R" else ""
        if x in "KRI":
            state = GRAMMAR[state, initials[i] if x == "K" else role[0]]
            out.append({"role": role, "text": text})
        i += x != "I"
    return out


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def fault(text: str, again: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    said = text.encode("utf-8", "surrogatepass").strip(SPACE)
    return "blank" if not said else "duplicate" if again else "truncated" if said[-1:] not in (b".", b"!", b"?") else ""


LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PIECES = "piece bigint, last boolean, audit string, repaired array<struct<role:string,text:string>>, " + ", ".join(f"{c} bigint" for c in COUNTS)
REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


class Facts:
    """Counts over adjacent rows, which add up over the blocks of a conversation."""

    def __init__(self):
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first = self.last = self.low = self.high = None

    def row(self, turn: int | None, role: str, problem: str):
        self.add({problem: 1} if problem else {}, role[:1], role[:1], turn, turn, int(turn is not None))

    def add(self, n: dict[str, int], first: str, last: str, low: int | None, high: int | None, turns: int):
        for k, v in n.items():
            self.n[k] += v
        if self.last is not None and self.last + first not in LEGAL:
            self.n["illegal"] += 1
        self.first, self.last = first if self.first is None else self.first, last
        if low is not None:
            self.n["turns"] += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.n["turns"]


def finish(rows: list[tuple]) -> dict:
    """A whole conversation: rows of (turn, role, text)."""
    facts, classes, seen = Facts(), [], set()
    for turn, role, text in rows:
        problem = fault(text, (role, text) in seen)
        seen.add((role, text))
        facts.row(turn, role, problem)
        classes.append((initial(role), problem in ("blank", "duplicate"), problem == "truncated"))
    weights, total, back = walk(classes, start())
    cost, q, n = close(weights)
    audit = letters_to(back, q) + "I" * n
    return {"audit": audit, "repaired": rewrite(audit, 0, [r[1:] for r in rows], [c[0] for c in classes]), "gaps": facts.gaps, "cost": total + cost} | {k: facts.n[k] for k in COUNTS if k in facts.n}


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows in lists of equal first columns, where these are adjacent."""
    key, held = None, []
    for b in slices(batches):
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and r[:keys] != key:
                yield key, held
                held = []
            key = r[:keys]
            held.append(r[keys:])
    if held:
        yield key, held


def batch(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in kinds.items()], list(kinds))


def in_batches(rows: Iterator[dict], kinds: dict[str, pa.DataType], size, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += 200 + size(r)
        if n >= most:
            yield batch(held, kinds)
            held, n = [], 0
    if held:
        yield batch(held, kinds)


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_bytes: int = 4 << 20, block: int = 4096) -> DataFrame:
    """The repaired conversations in pieces: conv, and PIECES.

    A piece holds its part of the edits' letters and the repaired rows; the counts are the conversation's and stand at
    its first piece (0), null elsewhere; the last piece is marked. All but conversations over most_bytes and those at
    the edges of tasks are one piece. A piece holds `block` rows at most or a conversation of most_bytes.
    """
    spark = conversations.sparkSession
    x = conversations.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), *[F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(n) for n, c in (("role", role), ("text", text))])
    # the last key parts equal rows, which are alike
    order = ["conv", "turn", "role", "hash", "id"]
    x = x.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("id")).repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    whole = {"conv": pa.int64(), "part": pa.int32(), "seq": pa.int64(), "pos": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    done = {"audit": pa.string(), "repaired": REPAIRED} | dict.fromkeys(COUNTS, pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows():
            key, seq, pos, held, size = None, -1, 0, [], 0

            def loose():
                return [{"conv": key, "part": part, "seq": seq, "pos": pos + i, "turn": t, "role": r, "text": x} for i, (t, r, x) in enumerate(held)]

            for b in slices(batches):
                for c, t, r, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if seq < 0 or c != key:
                        # a task's first conversation may have begun in the task before
                        if seq > 0 and pos == 0:
                            yield {"conv": key} | finish(held)
                        elif seq >= 0:
                            yield from loose()
                        key, seq, pos, held, size = c, seq + 1, 0, [], 0
                    held.append((t, r, x))
                    size += 100 + len(r) + len(x)
                    if size > most_bytes:
                        yield from loose()
                        pos, held, size = pos + len(held), [], 0
            if held:
                yield from loose()

        yield from in_batches(rows(), whole | done, lambda r: len(r.get("text") or "") + sum(len(y["text"]) + 40 for y in r.get("repaired") or ()))

    schema = "conv bigint, part int, seq bigint, pos bigint, turn bigint, role string, text string, audit string, repaired array<struct<role:string,text:string>>, " + ", ".join(f"{c} bigint" for c in COUNTS)
    seen = scratch(x.select("conv", "turn", "role", "text").mapInArrow(read, schema), "conversations")
    finished = seen.where("part is null").select("conv", F.lit(0).cast("long").alias("piece"), F.lit(True).alias("last"), "audit", "repaired", *COUNTS)
    return finished.unionByName(long_ones(seen.where("part is not null").select(*whole), block))


def long_ones(rows: DataFrame, block: int) -> DataFrame:
    """Conversations that may span tasks: rows (conv, part, seq, pos, turn, role, text), in the order of part, seq, pos."""
    at = ["part", "seq", "pos"]
    first = rows.groupBy("conv", "role", F.sha2("text", 256).alias("said")).agg(F.min(F.struct(*at)).alias("f")).select("f.*", F.lit(False).alias("again"))
    x = rows.join(first, at, "left").withColumn("again", F.coalesce("again", F.lit(True))).withColumn("block", F.floor(F.col("pos") / block))
    group = ["part", "seq", "block"]
    fields = [*group, "conv", "turn", "role", "text", "again"]
    numbers = {n: pa.int64() for n in ("conv", "part", "seq", "block", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")} | {"first": pa.string(), "last": pa.string(), "weights": pa.list_(pa.int64())}

    def classes(held):
        out = []
        for _, role, text, again in held:
            problem = fault(text, again)
            out.append((initial(role), problem in ("blank", "duplicate"), problem == "truncated"))
        return out

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's counts, and its cost and rank from each state to each other (-1: there is no way)."""

        def rows():
            for (part, seq, blk, conv), held in runs_of(batches, 4):
                facts = Facts()
                for turn, role, text, again in held:
                    facts.row(turn, role, fault(text, again))
                row, weights = classes(held), []
                for p in range(4):
                    end, total, _ = walk(row, start(p))
                    weights += [n for w in end for n in ((total + w[0], w[1]) if w is not None else (-1, -1))]
                yield {"conv": conv, "part": part, "seq": seq, "block": blk, "low": facts.low, "high": facts.high, "first": facts.first, "last": facts.last, "weights": weights} | facts.n

        yield from in_batches(rows(), numbers, lambda r: 400)

    plan_kinds = {n: pa.int64() for n in ("part", "seq", "block", "piece", "enter", "leave", "closing", *COUNTS)}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block of a conversation the states that the least path enters and leaves it in."""
        names = list(numbers)

        def rows():
            for key, held in runs_of(batches, 1):
                facts, now, ways, blocks = Facts(), start(), [], []
                for r in held:
                    r = dict(zip(names, (*key, *r), strict=True))
                    facts.add({k: r[k] for k in ("blank", "duplicate", "truncated", "illegal")}, r["first"], r["last"], r["low"], r["high"], r["turns"])
                    best = {}
                    for p, w in enumerate(now):
                        for q in range(4):
                            cost, rank = r["weights"][8 * p + 2 * q : 8 * p + 2 * q + 2]
                            if w is not None and cost >= 0:
                                best[q] = min(best.get(q, (w[0] + cost, w[1], rank, p)), (w[0] + cost, w[1], rank, p))
                    ranks = {q: i for i, q in enumerate(sorted(best, key=lambda q: best[q][1:]))}
                    now = tuple((best[q][0], ranks[q]) if q in best else None for q in range(4))
                    ways.append([best[q][3] if q in best else -1 for q in range(4)])
                    blocks.append((r["part"], r["seq"], r["block"]))
                cost, q, n = close(now)
                states = [q]
                for way in reversed(ways):
                    states.append(way[states[-1]])
                states.reverse()
                whole = {"gaps": facts.gaps, "cost": cost} | {k: facts.n[k] for k in COUNTS if k in facts.n}
                for i, (part, seq, blk) in enumerate(blocks):
                    yield {"part": part, "seq": seq, "block": blk, "piece": i, "enter": states[i], "leave": states[i + 1], "closing": n if i == len(blocks) - 1 else -1} | (whole if i == 0 else {})

        yield from in_batches(rows(), plan_kinds, lambda r: 100)

    measured = x.select(*fields, "pos").repartition(*group).sortWithinPartitions(*group, "pos").select(*fields).mapInArrow(measure, "conv bigint, part bigint, seq bigint, block bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first string, last string, weights array<bigint>")
    # a conversation's blocks are few numbers each and stream past
    plan = scratch(measured.repartition("conv").sortWithinPartitions("conv", *group).mapInArrow(fold, ", ".join(f"{n} bigint" for n in plan_kinds)), "plan")
    path = ["enter", "leave", "closing", "piece", *COUNTS]
    y = x.join(plan, group).select(*group, "conv", *path, "turn", "role", "text", "again", "pos").repartition(*group).sortWithinPartitions(*group, "pos").drop("pos")
    kinds = {"conv": pa.int64(), "piece": pa.int64(), "last": pa.bool_(), "audit": pa.string(), "repaired": REPAIRED} | dict.fromkeys(COUNTS, pa.int64())

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (_, _, _, conv, enter, leave, closing, piece, *counts), held in runs_of(batches, 4 + len(path)):
                row = classes(held)
                _, _, back = walk(row, start(enter))
                audit = letters_to(back, leave) + "I" * max(0, closing)
                yield {"conv": conv, "piece": piece, "last": closing >= 0, "audit": audit, "repaired": rewrite(audit, enter, [r[1:3] for r in held], [c[0] for c in row])} | dict(zip(COUNTS, counts, strict=True))

        yield from in_batches(rows(), kinds, lambda r: sum(len(v["text"]) + 40 for v in r["repaired"]))

    return y.mapInArrow(edit, f"conv bigint, {PIECES}")


def digests(pieces: DataFrame) -> DataFrame:
    """conv, the counts, audit, and the SHA-256 of `role:text` joined by newlines; pieces of long conversations stream past in order.

    One value over a whole conversation is asked for, so its letters meet in one row and its hash is made in one task.
    """
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    one = F.col("last") & (F.col("piece") == 0)
    short = pieces.where(one).select("conv", *COUNTS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    kinds = {"conv": pa.int64()} | dict.fromkeys(COUNTS, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string()}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, audit, counts, any_line = sha256(), [], None, False
        for b in slices(batches):
            for conv, _, last, letters, text, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if counts is None:
                    counts = more
                audit.append(letters)
                for t in text:
                    h.update((b"\n" if any_line else b"") + t.encode("utf-8", "surrogatepass"))
                    any_line = True
                if last:
                    yield batch([{"conv": conv, "audit": "".join(audit), "repaired_sha256": h.hexdigest()} | dict(zip(COUNTS, counts, strict=True))], kinds)
                    h, audit, counts, any_line = sha256(), [], None, False

    long = pieces.where(~one).select("conv", "piece", "last", "audit", lines.alias("lines"), *COUNTS).repartition("conv").sortWithinPartitions("conv", "piece")
    return short.unionByName(long.mapInArrow(join, "conv bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's rows: each twentieth is dropped, emptied, stripped of its sentence ends, repeated or given to the user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    x = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return x.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op13(spark, sf_dir: str) -> DataFrame:
    """Query op13_conversation_repair: every conversation of `conversations` after the stated damage; one without rows has zeros."""
    c = table(spark, sf_dir, "conversations")
    x = digests(repair(damaged(c))).withColumn("had", F.lit(True))
    every = c.select("conv_id").distinct().join(x, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    none = sha256().hexdigest()
    return every.select("conv_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
