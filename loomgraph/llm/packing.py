"""Best-fit packing into bins of several permitted sequence lengths.

Documents longer than the largest length are cut in pieces of that length, so nothing is dropped. Pieces are
dealt at random into shards of bounded size and each shard is packed by itself: longest piece first, into
the open bin with the least room that holds it. Where none does, a bin is opened. All permitted lengths are
weighed against each other there: each is filled, on trial, with the longest of the shard's remaining pieces that
fit, as they would come, and the one whose cost for each of its words is least is opened; a trial costs the length that its
contents need. The same packing with each single length is made too, and the cheapest outcome of the shard stays. Last,
each bin is made as short as its contents allow.

Defined results: rows without words have one piece of 0 words, bin null and capacity 0. Repeated rows are
packed each for itself. Pieces of equal length are taken in the order of key and number (null keys first); of lengths
of equal cost the longest is opened. Empty tables give empty results; extra columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import count_words, scratch, table

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a bin costs besides its length.
OVERHEAD = 16


def cost(final: list[int], overhead: int = OVERHEAD) -> int:
    return sum(final) + overhead * len(final)


class Remaining:
    """How many pieces of each size are still to come."""

    def __init__(self, sizes: list[int]):
        self.count = Counter(sizes)
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.sizes[bisect_left(self.sizes, n)]

    def trial(self, room: int) -> int:
        """Words that fill the room if the longest that fits is taken again and again."""
        filled, at = 0, len(self.sizes)
        while (at := bisect_right(self.sizes, room - filled, 0, at)) > 0:
            n = self.sizes[at - 1]
            filled += n * min(self.count[n], (room - filled) // n)
            at -= 1
        return filled


def pack_one(sizes: list[int], caps: list[int], overhead: int, fixed: int | None) -> tuple[list[int], list[int], list[int]]:
    """Best fit that always opens one length (or the least that holds the piece) or, without `fixed`, the best on trial."""
    rest, room, used = Remaining(sizes), [], []
    where, offset = [0] * len(sizes), [0] * len(sizes)

    def price(n: int, c: int) -> tuple[float, int]:
        words = n + rest.trial(c - n)
        return (caps[bisect_left(caps, words)] + overhead) / words, -c

    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        rest.take(n)
        k = bisect_left(room, (n, -1))
        if k < len(room):
            r, b = room.pop(k)
        else:
            fit = caps[bisect_left(caps, n) :]
            r = max(fixed, fit[0]) if fixed else min(fit, key=lambda c: price(n, c))
            b = len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += n
        if r > n:
            insort(room, (r - n, b))
    return where, offset, [caps[bisect_left(caps, u)] for u in used]


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """For each size its bin and offset, and for each bin its final capacity."""
    caps = sorted(capacities)
    return min((pack_one(sizes, caps, overhead, f) for f in (None, *caps)), key=lambda x: cost(x[2], overhead))


def best_fit(docs: DataFrame, key: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_pieces: int = 4096) -> DataFrame:
    """Returns key, piece, n_words, bin_id, capacity, offset: a row for each piece of each row of docs."""
    spark, most = docs.sparkSession, max(capacities)
    size = F.col("size")
    pieces = docs.select(F.col(f"`{key}`").cast("long").alias("key"), count_words(F.col(f"`{text}`")).alias("size"))
    pieces = pieces.select("key", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(size / most) - 1))).alias("piece"))
    # the row's place in the written table: equal rows spread, and a lost task finds the same places
    pieces = scratch(pieces.select("key", "piece", F.least(F.lit(most), size - F.col("piece") * most).cast("long").alias("n_words"), F.monotonically_increasing_id().alias("row")), "pieces")
    full = pieces.where("n_words > 0")
    shards = max(1, -(-full.count() // shard_pieces))
    dealt = full.select("key", "piece", "n_words", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(t: pa.Table) -> pa.RecordBatch:
            where, offset, final = pack(t.column("n_words").to_pylist(), capacities, overhead)
            shard = t.column("shard")[0].as_py()
            cols = [t.column(c).combine_chunks() for c in ("key", "piece", "n_words")]
            cols += [pa.array([(shard << 32) + b for b in where], pa.int64()), pa.array([final[b] for b in where], pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names)

        names = ["key", "piece", "n_words", "bin_id", "capacity", "offset"]
        held, at = [], None
        for b in batches:
            shard, i = b.column("shard").to_numpy(), 0
            while i < b.num_rows:
                j = i + int((shard[i:] != shard[i]).argmax() or b.num_rows - i)
                if shard[i] != at and held:
                    yield close(pa.Table.from_batches(held))
                    held = []
                at = shard[i]
                held.append(b.slice(i, j - i))
                i = j
        if held:
            yield close(pa.Table.from_batches(held))

    out = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), "key", "piece")
    packed = out.mapInArrow(run, "key long, piece long, n_words long, bin_id long, capacity long, offset long")
    none = pieces.where("n_words = 0").select("key", "piece", "n_words", F.lit(None).cast("long").alias("bin_id"), F.lit(0).cast("long").alias("capacity"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(none)


def op1(spark, sf_dir: str) -> DataFrame:
    """Query op1_best_fit_packing."""
    return best_fit(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
