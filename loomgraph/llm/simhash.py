"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A fingerprint's 32 segments of two bits become their bit counts (0, 1, 2), a vector whose Manhattan distance
never exceeds the Hamming distance of the fingerprints. Written in unary (0: 00, 1: 01, 2: 11) the vector
fits in 64 bits and its Manhattan distance is the popcount of an exclusive or. The segments form six groups;
two vectors within distance 3 differ in at most three segments, so they agree in at least three groups: each
fingerprint goes to the 20 grid cells that three groups span. Within a cell, pairs are first held against
the Manhattan bound, then against the Hamming distance itself.

Equal fingerprints are one node, so copies never meet each other. Within a cell a spanning forest is made,
never all pairs: pivots link all that is near them, then the parts that pivots left apart are compared, each
but the largest against all other parts. A task holds the fingerprints of one cell, at most `largest` of them: the
members of larger cells are parted once more in the same way, by groups of the segments that the cell leaves free
(two vectors differ in at most three of these too), and meet in those smaller cells.

Fingerprints of texts that share 0.8 of their five-word shingles differ in about 3 to 12 bits, too many for the
grid. near_duplicates(least=0.8), which the pipeline uses, therefore adds candidates that agree in randomly drawn
bits and differ in at most 16, and lets their shingle sets decide. Here the bits don't decide, so a forest of
candidates can't stand for the links. It can stand for the groups in which all links lie: cells make a forest of
candidates whose sketches (a bit each of 128 minima over the shingles) don't rule them out, its components are made,
and each component's shingle sets meet once in a task, which holds all its pairs against the sets. No pair of documents
is ever a row.

Defined results: a null or empty text has fingerprint zero and is linked like any other. Repeated rows, and rows that
share a key, get a row each; a null key is no candidate for the smallest key of a group. Empty tables give empty results;
extra columns are never read by near_duplicates() and kept by keep_one(). Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, fresh, scratch, slices, table
from loomgraph.llm.components import Forest, components

LOW = 0x5555555555555555
#: Candidates of similar texts: masks, bits in each, masks of the first round, most differing bits.
TABLES, BITS, FIRST, WIDE = 192, 20, 8, 16
#: Candidates' sketches differ in at most so many of 128 bits. At a similarity of 0.8 they differ in 13 on average, with a deviation of 3.4.
ALIKE = 36
#: Multipliers of a sketch's minima.
TIMES = np.random.default_rng(43).integers(0, 1 << 63, 128, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
#: Shingles of a component that meet in one task; larger components are cut into blocks of about that, which meet two by two.
BLOCK = 1 << 20


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: those that are set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    flat = b" ".join(words)
    if n <= 1:
        return xxh64_intdigest(flat, seed)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter((xxh64_intdigest(flat[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, n)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles (the whole of a shorter text), in order."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.array([xxh64_intdigest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))] if w else [], np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Two numbers of 64 bits: of each of 128 minima over the hashes a bit. Two sets of similarity j differ in 64 * (1 - j) bits on average."""
    least = np.full(len(TIMES), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, (TIMES[:, None] * hashes[None, i : i + 2048]).min(axis=1))
    return np.packbits(np.bitwise_count(least & np.uint64(0xFFFFFFFF)) & 1, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, words: int | None = None) -> DataFrame:
    """Returns key, fp (a signed long); with `words` also s0, s1, n: the sketch and number of the distinct shingles of so many words."""
    names = ["key", "fp"] + ["s0", "s1", "n"] * (words is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            out = [b.column(0), pa.array(fps.view(np.int64))]
            if words is not None:
                sets = [shingle_hashes(t.as_py(), words) for t in b.column(1)]
                of = np.array([sketch(x) for x in sets], np.uint64).view(np.int64)
                out += [pa.array(of[:, 0]), pa.array(of[:, 1]), pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def masks(groups: int = 6, agree: int = 3) -> list[int]:
    """The bits of each choice of groups that must agree."""
    cut = [64 // 2 * g // groups * 2 for g in range(groups + 1)]
    part = [((1 << cut[g + 1]) - 1) ^ ((1 << cut[g]) - 1) for g in range(groups)]
    return [sum(part[g] for g in c) for c in combinations(range(groups), agree)]


def submasks(mask: int, groups: int = 6, agree: int = 3) -> list[int]:
    """For a cell whose members agree in the segments of `mask`: the choices of groups of the other segments that must agree."""
    free = [i for i in range(32) if not mask >> 2 * i & 3]
    part = [sum(3 << 2 * i for i in free[len(free) * g // groups : len(free) * (g + 1) // groups]) for g in range(groups)]
    return [sum(part[g] for g in c) for c in combinations(range(groups), agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unary(fp: np.ndarray) -> np.ndarray:
    """The embedding: the bit counts of the two-bit segments, in unary."""
    low = np.uint64(LOW)
    return ((fp | fp >> np.uint64(1)) & low) | (((fp & fp >> np.uint64(1)) & low) << np.uint64(1))


def near(one: np.ndarray, many: np.ndarray, one_t: np.ndarray, many_t: np.ndarray, most: int) -> np.ndarray:
    """Boolean matrix: Manhattan bound first, exact distance where that passes."""
    out = np.bitwise_count(one_t[:, None] ^ many_t[None, :]) <= most
    i, j = np.nonzero(out)
    out[i, j] = np.bitwise_count(one[i] ^ many[j]) <= most
    return out


def cell_forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links between the fingerprints of a cell that join all that are near, fewer than the cell has members."""
    n, t = len(fp), unary(fp)
    f, edges = Forest(), []

    def link(i: int, js: np.ndarray) -> None:
        for j in js:
            if f.find(i) != f.find(int(j)):
                f.join(i, int(j))
                edges.append((int(fp[i]), int(fp[j])))

    if n <= 64:
        for i, j in zip(*np.nonzero(np.triu(near(fp, fp, t, t, most), 1)), strict=True):
            link(int(i), [j])
        return edges
    free = np.ones(n, bool)
    while (left := np.flatnonzero(free)).size:
        i = left[0]
        hit = np.flatnonzero(near(fp[i : i + 1], fp, t[i : i + 1], t, most)[0])
        link(int(i), hit)
        free[hit] = False
        free[i] = False
    root = np.fromiter((f.find(i) for i in range(n)), np.int64, n)
    parts = sorted((np.flatnonzero(root == r) for r in np.unique(root)), key=len)
    for own in parts[:-1]:
        root = np.fromiter((f.find(int(i)) for i in range(n)), np.int64, n) if len(own) > 1 else root
        for k in range(0, len(own), 256):
            some = own[k : k + 256]
            for i, row in zip(some, near(fp[some], fp, t[some], t, most), strict=True):
                link(int(i), np.flatnonzero(row))
    return edges


def links(fps: DataFrame, most: int = 3, groups: int = 6, agree: int = 3, largest: int = 4096) -> DataFrame:
    """fps: fp, distinct. Returns u, v: links that join all fingerprints within `most` bits of each other."""
    if groups - most < agree:
        raise ValueError("distance could touch more groups than may differ")
    fp = F.col("fp")
    low = F.lit(LOW)
    half = F.shiftrightunsigned(fp, 1)
    emb = fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))
    return cell_links(fps.select("fp", emb.alias("e")), masks(groups, agree), most, largest)


def samples(tables: int = TABLES, bits: int = BITS, seed: int = 42) -> list[int]:
    """Masks of `bits` bits of a fingerprint each, drawn at random."""
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tables)]


def cell_links(points: DataFrame, choose: list[int], most: int, largest: int = 4096) -> DataFrame:
    """points: fp, e. Links between fingerprints within `most` bits whose e agree under one of the masks: a forest
    of each cell, joined over a task's cells into stars."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col("e").bitwiseAND(F.lit(signed(m))).alias("cell")) for c, m in enumerate(choose)])
    grid = points.select("fp", "e", F.explode(cells).alias("x")).select("x.c", "x.cell", "fp", "e")
    found = scratch(cell_forests(grid.select("c", "cell", "fp", "e"), most, largest), "cells")
    crowd = found.where("c >= 0")
    if crowd.isEmpty():
        return found.select("u", "v")
    # members of large cells go on to smaller ones, which agree in half of the other segments too
    inner = [F.when(F.col("c") == c, F.array(*[F.struct(F.lit(i).alias("i"), F.col("v").bitwiseAND(F.lit(signed(m | n))).alias("cell")) for i, n in enumerate(submasks(m))])) for c, m in enumerate(choose)]
    finer = crowd.select("c", F.col("u").alias("fp"), F.col("v").alias("e"), F.explode(F.coalesce(*inner)).alias("x")).select((F.col("c") * 32 + F.col("x.i")).alias("c"), "x.cell", "fp", "e")
    return found.where("c < 0").select("u", "v").unionByName(cell_forests(finer, most).select("u", "v"))


def cell_forests(grid: DataFrame, most: int, largest: int | None = None) -> DataFrame:
    """grid: c, cell, fp, e. Returns u, v, c: links within cells (c = -1); of cells with more than `largest` members the
    members instead (u: fp, v: e, c)."""
    grid = grid.repartition("c", "cell").sortWithinPartitions("c", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, at, n_held = Forest(), [], None, 0

        def close(fp: np.ndarray) -> None:
            for a, b in cell_forest(np.unique(fp), most):
                forest.join(a, b)

        def out(pairs):
            a = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(np.full(len(a), -1, np.int32))], ["u", "v", "c"])

        def crowd(c: int, parts: list) -> pa.RecordBatch:
            fp, e = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(e), pa.array(np.full(len(fp), c, np.int32))], ["u", "v", "c"])

        def settle() -> Iterator[pa.RecordBatch]:
            """What is held of a cell that has ended."""
            if largest is not None and n_held > largest:
                if held:
                    yield crowd(at[0], held)
            elif n_held > 1:
                close(np.concatenate([x for x, _ in held]))

        for b in batches:
            if not b.num_rows:
                continue
            c, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
            fp, e = b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (cell[1:] != cell[:-1])) + 1, [len(c)]])
            sizes = np.diff(starts)
            # all but cells of one member, and those at the batch's ends, which may go on
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                s, t = starts[g], starts[g + 1]
                key = (int(c[s]), int(cell[s]))
                if key != at:
                    yield from settle()
                    held, at, n_held = [], key, 0
                held.append((fp[s:t], e[s:t]))
                n_held += t - s
                if largest is not None and n_held > largest:  # no more than that is ever held
                    yield crowd(key[0], held)
                    held = []
            if len(forest.up) > 200_000:
                yield out(forest.stars())
                forest = Forest()
        yield from settle()
        yield out(forest.stars())

    return grid.mapInArrow(run, "u long, v long, c int")


def cell_pairs(points: DataFrame, choose: list[int], part: range, most: int, alike: int | None = None) -> DataFrame:
    """points: fp, distinct, and root. Returns u, v: every pair within `most` bits and of different roots that agrees
    under one of the masks of `part` and under none before it in `choose`, once.

    With `alike`, points has s0 and s1 too, pairs whose sketches differ in more bits go, and u, v are stars of roots
    that join what the pairs would join, over a task's cells: fewer than the task has roots.

    Cells of up to 64 are paired by their members' distance in the sorted rows, a batch at once. In larger ones each
    root's members but those of the largest meet the others in blocks; for stars, each member meets those that aren't
    joined with it yet.
    """
    more = [] if alike is None else ["s0", "s1"]
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(choose[c]))).alias("cell")) for c in part])
    grid = points.select("fp", "root", *more, F.explode(cells).alias("x")).select("x.c", "x.cell", "fp", "root", *more)
    grid = grid.repartition("c", "cell").sortWithinPartitions("c", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, forest = [np.uint64(m) for m in choose], Forest()

        def stars() -> pa.RecordBatch:
            a = np.array(forest.stars(), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

        def like(fp: np.ndarray, s: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= most
            i, j = np.broadcast_arrays(i, j)
            i, j = i[ok], j[ok]
            ok[ok] = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int32) for x in s) <= alike
            return ok

        def join(fp: np.ndarray, root: np.ndarray, s: list, i: np.ndarray, j: np.ndarray) -> None:
            i, j = (x[root[i] != root[j]] for x in (i, j))
            ok = like(fp, s, i, j)
            for a, b in np.unique(np.stack([root[i[ok]], root[j[ok]]], axis=1), axis=0).tolist():
                forest.join(a, b)

        def join_large(fp: np.ndarray, root: np.ndarray, s: list) -> None:
            names, label = np.unique(root, return_inverse=True)
            for i in range(len(fp) - 1):
                j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
                if len(j := j[like(fp, s, np.array(i), j)]):
                    flag = np.zeros(len(names), bool)
                    flag[label[j]] = True
                    for x in np.flatnonzero(flag):
                        forest.join(int(names[x]), int(names[label[i]]))
                    label[flag[label]] = label[i]

        def new(c: np.ndarray, fp: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            ok = (root[i] != root[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= most)
            i, j = i[ok], j[ok]
            x, of = fp[i] ^ fp[j], c[i]
            ok = np.ones(len(i), bool)
            for k in range(int(of.max(initial=0))):
                ok &= (of <= k) | ((x & bits[k]) != 0)
            a, b = fp[i[ok]].view(np.int64), fp[j[ok]].view(np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

        def large(c: np.ndarray, fp: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, which, size = np.unique(root, return_inverse=True, return_counts=True)
            order = np.lexsort((which, size[which]))
            c, fp, root = c[order], fp[order], root[order]
            n = len(fp) - size.max()
            step = max(1, (1 << 21) // len(fp))
            for k in range(0, n, step):
                i, j = np.nonzero(np.bitwise_count(fp[k : min(n, k + step), None] ^ fp[None, k:]) <= most)
                yield from new(c, fp, root, i[i < j] + k, j[i < j] + k)

        def close(c: np.ndarray, cell: np.ndarray, fp: np.ndarray, root: np.ndarray, *s: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (cell[1:] != cell[:-1])) + 1, [len(c)]])
            sizes = np.diff(starts)
            ends = np.repeat(starts[1:], sizes)
            i = np.flatnonzero(np.repeat(sizes <= 64, sizes))
            for k in range(1, 64):
                i = i[i + k < ends[i]]
                if not len(i):
                    break
                if alike is not None:
                    join(fp, root, s, i, i + k)
                else:
                    yield from new(c, fp, root, i, i + k)
            for g in np.flatnonzero(sizes > 64):
                if alike is not None:
                    join_large(*(x[starts[g] : starts[g + 1]] for x in (fp, root)), [x[starts[g] : starts[g + 1]] for x in s])
                else:
                    yield from large(*(x[starts[g] : starts[g + 1]] for x in (c, fp, root)))

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [x.to_numpy() for x in b.columns]
            rows[2], rows[4:] = rows[2].view(np.uint64), [x.view(np.uint64) for x in rows[4:]]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            # the last cell may go on in the next batch
            other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from close(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
            if len(forest.up) > 200_000:
                yield stars()
                forest.up.clear()
        if held is not None:
            yield from close(*held)
        if alike is not None:
            yield stars()

    return grid.mapInArrow(run, "u long, v long")


def shingle_sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    """docs' other columns (longs), and hashes: the distinct XXH64 of each text's shingles, in order."""
    rest = [x for x in docs.columns if x != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = pa.array([shingle_hashes(t.as_py(), words).view(np.int64) for t in b.column(len(rest))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], sets], [*rest, "hashes"])

    return docs.select(*rest, text).mapInArrow(run, ", ".join(f"{x} long" for x in rest) + ", hashes array<long>")


def set_forest(sets: list[np.ndarray], root: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between sets (places in the list) that join all of different roots whose similarity is `least` or more.

    Two similar sets share one of the rarest elements of either, where the rarest are so many that the rest is less than
    what must be common. Only sets that do so, and aren't joined yet, are counted.
    """
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, element, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = rank[element]
    element = element[np.lexsort((element, owner))]
    rare = np.arange(len(owner)) - starts[owner] <= (sizes - np.ceil(sizes * least - 1e-9))[owner]
    order = np.argsort(element[rare], kind="stable")
    of, at = owner[rare][order], np.searchsorted(element[rare][order], np.arange(len(often) + 1))
    label, edges = np.unique(root, return_inverse=True)[1], []
    has, shares, flag = np.zeros(len(often), bool), np.zeros(len(sets), bool), np.zeros(len(sets), bool)
    for i in range(len(sets)):
        own = element[starts[i] : ends[i]]
        if not len(own):
            continue
        shares[:] = False
        for e in own[rare[starts[i] : ends[i]]]:
            shares[of[at[e] : at[e + 1]]] = True
        shares &= (label != label[i]) & (sizes >= sizes[i] * least - 1e-6) & (sizes * least <= sizes[i] + 1e-6)
        shares[: i + 1] = False
        left = np.flatnonzero(shares)
        has[own] = True
        for k in range(0, len(left), 256):
            j = left[k : k + 256]
            first = np.concatenate([[0], np.cumsum(sizes[j])[:-1]])
            both = np.add.reduceat(has[np.concatenate([element[starts[x] : ends[x]] for x in j])], first, dtype=np.int64)
            for x in j[both >= (sizes[i] + sizes[j] - both) * least]:
                if label[x] != label[i]:
                    edges.append((i, int(x)))
                    flag[:] = label == label[x]
                    label[flag] = label[i]
        has[own] = False
    return edges


def similar(docs: DataFrame, key: str, text: str, nodes: DataFrame, roots: DataFrame, least: float, words: int, block: int = BLOCK) -> DataFrame:
    """nodes: fp, first, s0, s1, n; roots: u, root. Returns u, v: links between components whose texts are similar:
    `least` or more of all their shingles are common.

    Candidates are fingerprints that agree under one of the masks, differ in at most WIDE bits and have sketches that
    differ in at most ALIKE. First a few masks bring hot groups together, then all of them what is still apart. All texts
    that candidates connect meet in a task, or two blocks of them at once. Only their documents are read again.
    """
    of = lambda r, c: r.select(F.col("u").alias("fp"), F.col("root").alias(c))
    choose, groups = samples(), roots
    for parts in ([range(FIRST)], [range(i, min(i + 32, len(choose))) for i in range(FIRST, len(choose), 32)]):
        points = nodes.where("n > 0").join(of(groups, "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "s0", "s1")
        points = scratch(points, "points")
        found = [scratch(cell_pairs(points, choose, part, WIDE, ALIKE), "candidates") for part in parts]
        groups = components(reduce(DataFrame.unionByName, found, groups.select("u", F.col("root").alias("v"))))
        discard(points, *found)
    made = nodes.join(of(roots, "root"), "fp", "left").join(of(groups, "g"), "fp", "left")
    made = scratch(made.select("fp", "first", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("g", "fp").alias("g")), "groups")
    sizes = made.groupBy("g").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.sum("n").alias("size"))
    sizes = sizes.where("one <> other").select("g", F.ceil(F.col("size") / block).alias("blocks"))
    some = scratch(made.join(sizes, "g").select("first", "fp", "root", "g", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("own")), "members")
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("first"), F.col(f"`{text}`").alias("_text")).join(some, "first")
    sets = scratch(shingle_sets(texts.select("fp", "root", "g", "blocks", "own", "_text"), "_text", words), "shingles")
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "own").alias("a"), F.greatest(x, "own").alias("b")))
    rows = sets.select("g", F.explode(meets).alias("x"), "fp", "root", "hashes").select("g", "x.a", "x.b", "fp", "root", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            fp, root = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            if e := np.array(set_forest([x[2] for x in held], root, least) if held else []).tolist():
                yield pa.RecordBatch.from_arrays([pa.array(fp[list(x)]) for x in zip(*e, strict=True)], ["u", "v"])

        for b in batches:
            ids = list(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
            flat, ends = b.column(5).flatten().to_numpy(), np.cumsum(b.column(5).value_lengths().to_numpy())
            for (*now, fp, root), s, e in zip(ids, [0, *ends], ends, strict=False):
                if now != at:
                    yield from settle()
                    at, held = now, []
                held.append((fp, root, flat[s:e].copy()))
        yield from settle()

    x = scratch(rows.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b").mapInArrow(run, "u long, v long"), "similar")
    discard(made, some, sets)
    return x


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3, shingle: int = 3, least: float | None = None, words: int = 5) -> DataFrame:
    """Returns key, fp, component_id (the smallest key that is reachable): a row for each row of docs.

    With `least`, texts that share that part of their distinct shingles of `words` words are linked as well, if a
    chain of candidates connects them. A pair is a candidate with a probability that falls with the distance of its fingerprints alone, whatever
    else is in its cells: 0.9997 at 8 bits, 0.97 at 10, 0.73 at 12, 0.37 at 14 and none above 16.
    Sketches rule out some candidates too, by chance: see ALIKE.
    """
    fps = scratch(fingerprints(docs, key, text, shingle, None if least is None else words), "fps")
    nodes = fps.groupBy("fp").agg(F.min("key").alias("first"), *[F.min_by(c, "key").alias(c) for c in fps.columns[2:]])
    edges = links(nodes.select("fp"), most)
    roots = components(edges)
    if least is not None:
        more = similar(docs, key, text, nodes, roots, least, words)
        roots = components(roots.select("u", F.col("root").alias("v")).unionByName(more))
    labels = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = labels.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(labels.join(ids, "root").select("fp", "component_id"), "fp").select("key", "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3, least: float | None = 0.8) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest key (null keys come last, rows that share a
    key are ordered by a hash of key and text).

    Rows are named by that hash; rows that share key and text are one, of which any stays.
    """
    (h,) = fresh(docs, "_row")
    x = docs.withColumn(h, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")))
    groups = near_duplicates(x, h, text, most, least=least).select("key", "component_id").distinct()
    ids = x.select(F.col(h).alias("key"), F.col(f"`{key}`").alias("id")).distinct()
    least_row = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key"))
    kept = groups.join(ids, "key").groupBy("component_id").agg(least_row.alias("row")).select(F.col("row.key").alias(h))
    return x.join(kept, h, "left_semi").dropDuplicates([h]).drop(h)


def op9(spark, sf_dir: str) -> DataFrame:
    """Query op9_simhash."""
    x = near_duplicates(table(spark, sf_dir, "documents"))
    return x.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
