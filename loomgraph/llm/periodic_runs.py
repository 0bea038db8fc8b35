"""Periodic runs of words: maximal repetitions from Lyndon arrays.

A run is a stretch of consecutive words with smallest period q, in which words q apart are equal, and which no
neighbouring word extends. Each run has a root that is the longest Lyndon word at its place, under an order of
the words or under the reverse one. So both Lyndon arrays are computed, as edges to the next smaller suffix with
the length that both suffixes share, and each edge whose match is long enough is extended to the left.

Suffixes are compared by single words and by lengths that were matched before: the chain of smaller suffixes
carries the shared lengths along, neighbours share what the pair after them does, and a match that is extended at
some distance goes on from the end of the last one at that distance. So items are compared once for each distance
that they are matched at: a few times on texts as they occur, a number that grows with the log of the length on
words such as Fibonacci's, which repeat at that many distances. No suffix structure and no hash of texts is made. A word that a text holds fewer than `least` times is in no run of exponent `least` and parts the text, so
only the stretches between such words are worked on.

A text is worked on whole, in one task, row by row; memory is a few lists of its length. Defined results: a null or
empty text, or one of white space, has no words, no runs and an empty collapsed text. Repeated rows get equal
results each, ties can't occur (a start and a period name one run). An empty table gives an empty result. The row's
own columns stay, null keys too; where a name clashes, the added column gets an underscore.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh, slices, table, words

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Shortest run, and the least number of periods in it.
SHORTEST, LEAST = 6, 4


def lyndon(s: list[int]) -> tuple[list[int], list[int]]:
    """For each place the start of the next smaller suffix (the length: none) and the number of items both share.

    The longest Lyndon word at i ends before the first of these. A suffix that begins another is the smaller one.
    """
    n = len(s)
    smaller, shared = [n] * n, [0] * n
    matched: dict[int, tuple[int, int]] = {}  # distance -> start and end of the last match at that distance
    same = 0  # items that suffixes i and i + 1 share
    for i in range(n - 2, -1, -1):
        same = same + 1 if s[i] == s[i + 1] else 0
        j, c = i + 1, same
        while j + c < n and s[i + c] < s[j + c]:
            k, d = smaller[j], shared[j]
            if k == n:
                j, c = n, 0
                break
            if c > d:
                c = d
            elif c == d:
                gap, x = k - i, i + c
                start, end = matched.get(gap, (n - gap, n - gap))
                while x < start and s[x] == s[x + gap]:
                    x += 1
                if x >= start:
                    x = end
                if x > i:
                    matched[gap] = (i, x)
                c = x - i
            j = k
        smaller[i], shared[i] = j, c
    return smaller, shared


def runs(s: list[int], shortest: int = SHORTEST, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Start, length and period of each run of at least `shortest` items and `least` periods (three or more), sorted."""
    if least < 3:
        raise ValueError("least must be 3 or more")
    n, found = len(s), set()
    for order in (s, [-x for x in s]):
        smaller, shared = lyndon(order)
        for i, r in enumerate(shared):
            j = smaller[i]
            p = j - i
            # the first root of a run lies less than a period behind its start, the later ones follow from it
            if r < (least - 2) * p or (i >= p and smaller[i - p] == i and shared[i - p] == p + r):
                continue
            a = i
            while a and s[a - 1] == s[a - 1 + p]:
                a -= 1
            if j + r - a >= max(shortest, least * p):
                found.add((a, j + r - a, p))
    return sorted(found)


def text_runs(parts: list[bytes], shortest: int = SHORTEST, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    often = {w: i for i, (w, m) in enumerate(Counter(parts).items()) if m >= least}
    if not often:
        return []
    s, out, at = [often.get(w, -1) for w in parts] + [-1], [], 0
    while at < len(s):
        end = s.index(-1, at)
        if end - at >= shortest:
            out += [(at + a, length, p) for a, length, p in runs(s[at:end], shortest, least)]
        at = end + 1
    return out


def collapse(parts: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of all runs and each run's first period; a word that any run drops is dropped."""
    out, at = [], 0
    for a, end in sorted((a + p, a + length) for a, length, p in found):
        out += parts[at:a]
        at = max(at, end)
    return out + parts[at:]


def find(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> tuple[DataFrame, str, str, str]:
    """Adds the number of words, the runs by start and period, and the collapsed text; returns the frame and their names."""
    count, found, short = fresh(docs, "n_words", "runs", "collapsed")
    own, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ns, rs, cs = [], [], []
            for t in b.column(at).cast(pa.binary()):
                parts = (t.as_py() or b"").split()
                r = text_runs(parts, shortest, least)
                ns.append(len(parts))
                rs.append([{"start": a, "length": length, "period": p} for a, length, p in r])
                cs.append(b" ".join(collapse(parts, r) if r else parts))
            made = [pa.array(ns, pa.int64()), pa.array(rs, RUNS_ARROW), pa.array(cs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*own, count, found, short])

    added = ", ".join(f"`{n}` {k}" for n, k in ((count, "bigint"), (found, RUNS), (short, "string")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {added}"), count, found, short


def repeat_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The query's texts: a tenth of them (by a checksum of the key) get a periodic tail. A null key is never one of these."""
    h, w, g, a, p = fresh(docs, "_h", "_w", "_g", "_a", "_p")
    x = docs.withColumn(h, F.crc32(F.col(f"`{key}`").cast("string").cast("binary")))
    x = x.withColumn(g, F.floor(F.col(h) / 10)).withColumn(w, F.when(F.col(h) % 10 == 0, words(F.col(f"`{text}`"))))
    x = x.withColumn(a, F.col(g) % F.greatest(F.size(w), F.lit(1))).withColumn(p, 1 + F.floor((F.size(w) - F.col(a)) / (3 + F.col(g) % 8)))
    tail = F.expr(f"array_join(transform({w}, (v, i) -> if(i < {a}, v, {w}[cast({a} + (i - {a}) % {p} as int)])), ' ')")
    made = F.when((F.col(h) % 10 == 0) & (F.size(w) > 0), tail).otherwise(F.col(f"`{text}`"))
    return x.select(*[made.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op12(spark, sf_dir: str) -> DataFrame:
    """Query op12_periodic_runs: runs of every text of `documents`, after the planted tails."""
    x, _, found, short = find(repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    r = F.col(found)
    longest = F.get(F.array_sort(r, lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]).cast("int")), F.lit(0))
    lines = F.array_join(F.transform(r, lambda v: F.concat_ws(",", v["start"], v["length"], v["period"])), "\n")
    return x.select("doc_id", F.size(r).cast("long").alias("n_runs"), longest.alias("m"), F.sha2(F.when(F.size(r) > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2(short, 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "m.start", "m.length", "m.period", F.floor(1000 * F.col("m.length") / F.col("m.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
