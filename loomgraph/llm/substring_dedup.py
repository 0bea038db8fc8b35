"""Substring deduplication with suffix automata over reference shards.

A window is `window` consecutive words. A window whose word sequence starts earlier too, in the order of
document and place, is removed with all its words.

The reference is the corpus itself, which has no size bound. It is cut in shards of bounded size; each shard's
automaton goes to all tasks that hold text which may match it, and only to these (fragment and replicate, in
place of a broadcast to every task). Hashes only choose what is streamed: every removed window is found by
matching statistics against an automaton.

1. Filter. Every window names an anchor: the least hash among its runs of `gram` words. Equal windows have equal
   anchors at equal offsets. Consecutive windows with the same anchor form a unit (at most
   window - gram + 1 of them), named by its anchor and a hash of its words. Units meet by anchor, as numbers only;
   those whose anchor occurs nowhere else are settled: none of their windows occurs twice. Of equal units the
   first is part of the reference.
2. Shards. Reference units are dealt by anchor; anchors with more than `many` of them (a common phrase in
   unlike texts) are dealt window by window instead, by a hash of the window. Where one anchor has more than
   `heavy` units (a passage that very many documents share), its units are spread over several tasks and its part
   of the reference goes to each of them.
3. Matching statistics. A shard's automaton is built from its reference units in the order of document and place,
   so each of its states knows where its words first start. Units stream past it: a window that is found, and
   that first starts before its own place, is removed. Equal units are walked once.
4. Each document's removed windows are merged into maximal spans and cut out.

Two unlike units with equal 64-bit hashes and equal anchors would leave the later one out of the reference: its
copies would stay. No word is ever removed by a hash.

Defined results: a null text has no words. Rows that share key and text are one document (each gets its
result); rows that share a key but not a text are ordered by a 32-bit hash of the text, and such of them as share that
too are taken as one place. A null key has the place of 2^62 and 62 bits of a hash of the text: after all lesser
keys, in the order of that hash; it stays null in the results. Of equal windows the first stays. Empty tables give
empty results; extra columns never meet the operator's own. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, fresh, scratch, slices, table

WINDOW = 20
GRAM = 8


class Automaton:
    """Suffix automaton over sequences of hashable tokens, grown text by text. Each state knows which text its words
    ended in first, and where: texts are added in the order of their places."""

    def __init__(self):
        self.next, self.link, self.len, self.first, self.texts = [{}], [-1], [0], [None], 0

    def longest(self, tokens: list) -> list[int]:
        """Matching statistics: for each place the length of the longest match that ends there."""
        nxt, link, ln = self.next, self.link, self.len
        v, n, out = 0, 0, []
        for c in tokens:
            while v and c not in nxt[v]:
                v = link[v]
                n = ln[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            out.append(n)
        return out

    def firsts(self, tokens: list, window: int) -> list[tuple[int, int, int]]:
        """For each window that occurs: its number in tokens, the first text that has it, and its number there."""
        nxt, link, ln, first, out = self.next, self.link, self.len, self.first, []
        v, n = 0, 0
        for end, c in enumerate(tokens, 1 - window):
            while (to := nxt[v].get(c)) is None and v:
                v = link[v]
                n = ln[v]
            if to is not None:
                v = to
                n += 1
            if n >= window:
                while ln[link[v]] >= window:
                    v = link[v]
                    n = ln[v]
                text, at = first[v]
                out.append((end, text, at - window + 1))
        return out

    def add(self, tokens: list) -> None:
        nxt, link, ln = self.next, self.link, self.len
        last = 0
        for at, c in enumerate(tokens):
            if (q := nxt[last].get(c)) is not None:
                if ln[q] == ln[last] + 1:
                    last = q
                    continue
                last = self._clone(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            ln.append(ln[last] + 1)
            link.append(0)
            self.first.append((self.texts, at))
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if ln[q] == ln[p] + 1 else self._clone(p, q, c)
            last = cur
        self.texts += 1

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, ln = self.next, self.link, self.len
        k = len(nxt)
        nxt.append(dict(nxt[q]))
        ln.append(ln[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = k
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        return k


#: Odd multipliers of the hashes.
MIX, BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def powers(n: int, base: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def units(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of the words, first window and number of windows of each unit."""
    from xxhash import xxh64_intdigest

    n = len(words) - window + 1
    if n < 1:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    g = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        g = (g ^ w[k : k + len(g)]) * np.uint64(MIX)
        g ^= g >> np.uint64(29)
    span = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    size = np.diff(np.concatenate([first, [n]]))
    # a polynomial of the words' hashes, by sums from the text's start
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * powers(len(w), BASE))])
    u = (sums[first + size + window - 1] - sums[first]) * powers(len(w), pow(BASE, -1, 1 << 64))[first]
    return g[at[first]].view(np.int64), u.view(np.int64), first, size


def place(key: str, text: str) -> Column:
    """A row's key in the order of documents."""
    unnamed = F.xxhash64(F.col(f"`{text}`")).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.coalesce(F.col(f"`{key}`").cast("long"), unnamed)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _first(key: np.ndarray, h: np.ndarray, s: np.ndarray, a: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in the order a, u, key, h, s: the first row of each unit, and those that repeat that very row."""
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (u[1:] != u[:-1])])
    at = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return new, ~new & (key == key[at]) & (h == h[at]) & (s == s[at])


PLAIN, FORCED, MARK, COPY = range(4)
UNITS = "r long, a long, u long, key long, h int, s int, n int, k int"


def unit_rows(own: DataFrame, window: int, gram: int, most_rows: int = 200_000, crowd: int = 64) -> DataFrame:
    """own: key, h, text. Returns UNITS: a row for each unit, r says where it goes.

    Of equal units in a run of rows the first goes on by its anchor; COPY is a later one, which goes anywhere. An
    anchor with more than `crowd` unlike units in the run sends them by anchor and hash, and a MARK by its anchor.
    FORCED units are known not to be alone.
    """

    def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = (x.view(np.uint64) ^ (y.view(np.uint64) * np.uint64(BASE))) * np.uint64(MIX)
        return (z ^ (z >> np.uint64(31))).view(np.int64)

    def close(parts: list) -> pa.RecordBatch:
        key, h, s, n, a, u = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((s, h, key, u, a))
        key, h, s, n, a, u = (x[order] for x in (key, h, s, n, a, u))
        first, same = _first(key, h, s, a, u)
        copy = ~first & ~same
        start = np.flatnonzero(first)
        several = np.zeros(len(a), bool)
        several[start] = np.add.reduceat(copy, start) > 0
        anchor = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
        crowded = np.add.reduceat(first, anchor) > crowd
        spread = np.repeat(crowded, np.diff(np.concatenate([anchor, [len(a)]])))
        r = np.where(copy, mix(key, s), np.where(spread, mix(a, u), a))
        k = np.where(copy, COPY, np.where(spread | several, FORCED, PLAIN))
        marks, keep = a[anchor[crowded]], ~same
        zero = np.zeros(len(marks), np.int64)
        cols = [np.concatenate([x[keep], y]) for x, y in ((r, marks), (a, marks), (u, zero), (key, zero), (h, zero), (s, zero), (n, zero), (k, zero + MARK))]
        kinds = [x.split()[1] for x in UNITS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64 if t == "long" else np.int32)) for x, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in UNITS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in slices(batches):
            for k, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                w = split(t.as_py())
                if len(w) < window:
                    continue
                a, u, s, n = units(w, window, gram)
                held.append((np.full(len(s), k, np.int64), np.full(len(s), h, np.int64), s.astype(np.int64), n.astype(np.int64), a, u))
                rows += len(s)
                if rows > most_rows:
                    yield close(held)
                    held, rows = [], 0
        if held:
            yield close(held)

    return own.mapInArrow(run, UNITS)


def candidates(rows: DataFrame) -> DataFrame:
    """rows: UNITS. Returns a, key, h, s, n, ref: units whose anchor isn't alone; ref: the first of its kind here.

    Sorted rows stream past, one is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None

        def out(x: list[np.ndarray], ref: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            _, a, _, key, h, s, n, _ = x
            return pa.RecordBatch.from_arrays([pa.array(y[keep]) for y in (a, key, h, s, n, ref)], ["a", "key", "h", "s", "n", "ref"])

        def settle(x: list[np.ndarray], after: int | None) -> pa.RecordBatch:
            nonlocal before
            a, u, k = x[1], x[2], x[7]
            as_before = np.concatenate([[before is not None and before[0] == a[0]], a[1:] == a[:-1]])
            as_after = np.concatenate([as_before[1:], [after is not None and a[-1] == after]])
            equal = as_before & np.concatenate([[before is not None and before[1] == u[0]], u[1:] == u[:-1]])
            before = (a[-1], u[-1]) if k[-1] != MARK else (a[-1], None)
            if len(k) > 1:
                equal[1:] &= k[:-1] != MARK
            return out(x, ~equal, (k != MARK) & (as_before | as_after | (k == FORCED)))

        for b in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            copy = x[7] == COPY
            if copy.any():
                y = [c[copy] for c in x]
                yield out(y, np.zeros(len(y[0]), bool), np.ones(len(y[0]), bool))
                x = [c[~copy] for c in x]
            if held is not None:
                x = [np.concatenate(y) for y in zip(held, x, strict=True)]
            if not len(x[0]):
                continue
            if len(x[0]) > 1:
                yield settle([c[:-1] for c in x], x[1][-1])
            held = [c[-1:] for c in x]
        if held is not None:
            yield settle(held, None)

    return rows.mapInArrow(run, "a long, key long, h int, s int, n int, ref boolean")


def repeats(docs: DataFrame, key: str, text: str, window: int = WINDOW, gram: int = GRAM, shard_units: int = 4096, many: int = 1024, heavy: int = 50_000, crowd: int = 64) -> DataFrame:
    """Returns key, h, spans: an array of (s, bits), removed windows as bits from window s on.

    A shard has about shard_units units of at most 2 * window words, so its automaton at most some 200,000 states.
    """
    own = docs.where(F.col(f"`{text}`").isNotNull()).select(place(key, text).alias("key"), F.hash(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"), F.col(f"`{text}`").alias("text"))
    rows = unit_rows(own, window, gram, crowd=crowd).repartition("r").sortWithinPartitions("a", "u", "key", "h", "s")
    met = scratch(candidates(rows), "met")
    # anchors in need of care; the optimizer broadcasts them only below its own limit
    crowds = met.groupBy("a").agg(F.count("*").alias("m"), F.count_if("ref").alias("d")).where((F.col("m") > heavy) | (F.col("d") > many))
    crowds = scratch(crowds.select("a", (F.col("d") > many).alias("hot"), F.when(F.col("d") > many, 1).otherwise(F.ceil(F.col("m") / heavy)).cast("int").alias("z")), "crowds")
    met_ = met.join(crowds, "a", "left").select("a", "key", "h", "s", "n", "ref", F.coalesce("hot", F.lit(False)).alias("hot"), F.coalesce("z", F.lit(1)).alias("z"))
    n = met_.where("ref").agg(F.sum(F.when(F.col("hot"), F.col("n")).otherwise(1))).first()[0] or 0
    shards = max(1, -(-n // shard_units))
    places = met_.groupBy("key", "h").agg(F.collect_list(F.struct("s", "n", "a", "ref", "hot", "z")).alias("at"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units with equal texts are one row with all their places."""
        from xxhash import xxh64_intdigest

        def out(rows: dict) -> pa.RecordBatch:
            place = [list(zip(*p, strict=True)) for p in rows.values()]
            cols = [[r[i] for r in rows] for i in range(4)] + [[p[i] for p in place] for i in range(3)]
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), *(pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32())))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["g", "z", "other", "t", "key", "h", "s"])

        rows, size = {}, 0
        for b in slices(batches, 4 << 20):
            at = b.column(3)
            of, fields = at.offsets.to_pylist(), [c.to_pylist() for c in at.flatten().flatten()]
            of = [x - of[0] for x in of]
            for row, (k, h, t) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                w = split(t)
                flat, ends = b" ".join(w), list(accumulate(map(len, w), lambda x, y: x + y + 1, initial=-1))
                for s, n, a, ref, hot, every in zip(*(c[of[row] : of[row + 1]] for c in fields), strict=True):
                    for i, m in [(s + j, 1) for j in range(n)] if hot else [(s, n)]:
                        u = flat[ends[i] + 1 : ends[i + m + window - 1]]
                        g = (xxh64_intdigest(u) if hot else a) % shards
                        # the reference goes to all tasks of its anchor
                        for z in range(every) if ref else ((k * 31 + i) % every,):
                            rows.setdefault((g, z, not ref, u), []).append((k, h, i))
                            size += 1
                if size > 50_000:
                    yield out(rows)
                    rows, size = {}, 0
        if rows:
            yield out(rows)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], ["key", "h", "s", "bits"])
            found.clear()
            return batch

        class Shard:
            def __init__(self):
                self.own, self.auto, self.ids, self.places, self.known = [], None, {}, [], {}

            def build(self) -> None:
                self.auto, ids, seen = Automaton(), self.ids, {}
                for p, t in sorted((min(places), t) for t, places in self.own):
                    if t not in seen:
                        seen[t] = [ids.setdefault(w, len(ids)) for w in t.split(b" ")]
                        self.auto.add(seen[t])
                        self.places.append(p)
                for t, tokens in seen.items():
                    self.walk(t, tokens)

            def walk(self, t: bytes, tokens: list) -> tuple:
                """Windows that occur, each with its first place, and all of them as bits; the last of those places."""
                hits = []
                for i, text, at in self.auto.firsts(tokens, window):
                    k, h, s = self.places[text]
                    hits.append((i, (k, h, s + at)))
                got = self.known[t] = hits, sum(1 << i for i, _ in hits), max((p for _, p in hits), default=None)
                return got

            def stream(self, t: bytes, places: list) -> None:
                hits, every, last = self.known.get(t) or self.walk(t, [self.ids.get(w, -1) for w in t.split(b" ")])
                if every:
                    for p in places:
                        if last < p:
                            found.append((*p, every))
                        else:
                            k, h, s = p
                            if bits := sum(1 << i for i, q in hits if q < (k, h, s + i)):
                                found.append((k, h, s, bits))

            def close(self) -> None:
                if self.auto is None:
                    self.build()
                for t, places in self.own:
                    self.stream(t, places)

        shard, at = Shard(), None
        for b in batches:
            of = b.column(4).offsets.to_pylist()
            every = list(zip(*(b.column(c).flatten().to_pylist() for c in (4, 5, 6)), strict=True))
            of = [x - of[0] for x in of]
            for row, (g, z, other, t) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
                if (g, z) != at:
                    shard.close()
                    shard, at = Shard(), (g, z)
                places = every[of[row] : of[row + 1]]
                if not other:
                    shard.own.append((t, places))
                    continue
                if shard.auto is None:
                    shard.build()
                shard.stream(t, places)
            if len(found) > 20_000:
                yield out()
        shard.close()
        yield out()

    streamed = own.join(places, ["key", "h"]).select("key", "h", "text", "at")
    streamed = streamed.mapInArrow(texts, "g long, z int, other boolean, t binary, key array<long>, h array<int>, s array<int>")
    decided = scratch(streamed.repartition("g", "z").sortWithinPartitions("g", "z", "other").mapInArrow(decide, "key long, h int, s int, bits long"), "decided")
    discard(met, crowds)
    return decided.groupBy("key", "h").agg(F.collect_list(F.struct("s", "bits")).alias("spans"))


def cut(words: list[bytes], spans: list[dict] | None, window: int = WINDOW) -> list[bytes]:
    """The words that no removed window covers."""
    if spans is None or not len(spans):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for x in spans:
        s, bits = x["s"], x["bits"]
        while bits:
            i = (bits & -bits).bit_length() - 1
            edge[s + i] += 1
            edge[s + i + window] -= 1
            bits &= bits - 1
    gone = np.cumsum(edge[:-1]) > 0
    return [words[i] for i in np.flatnonzero(~gone)]


def with_spans(docs: DataFrame, key: str, text: str, window: int = WINDOW) -> tuple[DataFrame, str]:
    """docs and, for each row, its removed windows (null: none)."""
    k, h, spans = fresh(docs, "_key", "_hash", "_spans")
    r = repeats(docs, key, text, window).select(F.col("key").alias(k), F.col("h").alias(h), F.col("spans").alias(spans))
    x = docs.withColumns({k: place(key, text), h: F.hash(F.coalesce(F.col(f"`{text}`"), F.lit("")))})
    return x.join(r, [k, h], "left").drop(k, h), spans


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Returns key, n_words, n_removed, kept (bytes): a row for each row of docs."""
    x, spans = with_spans(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20):
            n, gone, digest = [], [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = split(t)
                kept = cut(w, s, window)
                n.append(len(w))
                gone.append(len(w) - len(kept))
                digest.append(sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], ["key", "n_words", "n_removed", "kept_sha256"])

    return x.select(F.col("id").cast("long"), "text", spans).mapInArrow(run, "key long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """The rows with repeated spans cut from their text, the rest joined by one space; rows without a cut stay as they are.

    Rows of which no word is left go.
    """
    x, spans = with_spans(docs, key, text, window)
    (out,) = fresh(x, "_out")

    @F.pandas_udf("string")
    def shorten(t, s):
        import pandas as pd

        return pd.Series([b" ".join(cut(split(a), b, window)).decode("utf-8", "surrogatepass") for a, b in zip(t, s, strict=True)], dtype=object)

    same = x.where(F.col(spans).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    y = x.where(F.col(spans).isNotNull()).withColumn(out, shorten(F.col(f"`{text}`"), F.col(spans)))
    y = y.where(F.col(out) != "").withColumn(text, F.col(out))
    if n_chars in docs.columns:
        y = y.withColumn(n_chars, F.length(out).cast(docs.schema[n_chars].dataType))
    return same.unionByName(y.select(*[F.col(f"`{c}`") for c in docs.columns]))


def op5(spark, sf_dir: str) -> DataFrame:
    """Query op5_substring_dedup."""
    return removed(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(20)) AS j) WHERE k > 1),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT t.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY t.p) AS s FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.p = c.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
