"""Mixing sources to target weights by pivotal dependent rounding (native).

Each source has a weight; its target is its share of all words, at most `most_copies` times its size, the
excess reshared by weight. A row of a source is wanted target / source size times: the whole part of that
is taken for certain, the fraction is rounded by the pivotal method. Two rows with fractional probabilities
meet, and mass (words times probability) moves from one to the other until one of the two is 0 or 1; chance
decides the direction so that each row's expectation stays. The fold over a bounded bucket of rows leaves one
fractional row; the residuals of all buckets are folded again, level by level: a reduction tree whose fan-in
is `fan_in`, so no task sees more than a bucket. Within a bucket the longest rows meet first, so that the
many short ones can settle them. The one row of a source that is fractional at the root goes to the nearer
whole number: the words that a source takes miss its target by at most half of its longest row.

Chance comes from hashes of the seed, the level and the row, so reruns agree.

Defined results: null texts and texts without words have size 0 and are never taken; a source whose rows
all are such has target 0. A null source is a source of its own, last in order. Repeated rows are rounded
each for itself. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import count_words, fresh, scratch

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: int = 3) -> DataFrame:
    """sizes: src, size. Returns src, source_size, target, longest, n: a row for each source.

    The shares are those of water poured into vessels of limited size: with sources in order of limit by
    weight, those before the k-th are full and the others share the rest by weight; the first k whose own
    limit isn't passed is right, and of those k it has the highest level. Windows here run over the sources, not over rows.
    """
    by = sizes.groupBy("src").agg(F.sum("size").cast("long").alias("source_size"), F.max("size").alias("longest"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("src").isNull(), F.col("src").cast("binary")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    x = by.withColumn("w", w).withColumn("cap", F.col("source_size") * most_copies).withColumn("r", F.col("cap") / F.col("w"))
    order = Window.orderBy("r", F.col("src").isNull(), F.col("src").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    level = F.max(F.when(F.col("level") <= F.col("r"), F.col("level"))).over(everything)
    x = x.withColumn("level", level)
    return x.select("src", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")), F.lit(0.0)).alias("target"), "longest", "n")


def _uniform(*cols: Column) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


#: One meeting: a is the residual so far, e the next row; up is the mass that may move to a, down that to e.
_FOLD = """
aggregate(items, named_struct('k', cast(null as bigint), 's', 0L, 'p', 0D, 'done', cast(array() as array<struct<k:bigint,s:bigint,x:bigint>>)),
  (a, e) -> if(a.k is null, named_struct('k', e.k, 's', e.s, 'p', e.p, 'done', a.done),
    element_at(transform(array(named_struct('up', least(a.s * (1 - a.p), e.s * e.p), 'down', least(a.s * a.p, e.s * (1 - e.p)))), m ->
      if(e.u * (m.up + m.down) < m.down,
        if(a.s * (1 - a.p) <= e.s * e.p,
          named_struct('k', e.k, 's', e.s, 'p', e.p - m.up / e.s, 'done', array_append(a.done, named_struct('k', a.k, 's', a.s, 'x', 1L))),
          named_struct('k', a.k, 's', a.s, 'p', a.p + m.up / a.s, 'done', array_append(a.done, named_struct('k', e.k, 's', e.s, 'x', 0L)))),
        if(a.s * a.p <= e.s * (1 - e.p),
          named_struct('k', e.k, 's', e.s, 'p', e.p + m.down / e.s, 'done', array_append(a.done, named_struct('k', a.k, 's', a.s, 'x', 0L))),
          named_struct('k', a.k, 's', a.s, 'p', a.p - m.down / a.s, 'done', array_append(a.done, named_struct('k', e.k, 's', e.s, 'x', 1L))))
      )), 1)))
"""


def pivotal(rows: DataFrame, most_rows: int, seed: int = 0, fan_in: int = 64) -> DataFrame:
    """rows: src, k (a long that names the row), s (size over 0), p (in [0, 1)). Returns src, k, s, x (0 or 1), m (how many rows).

    most_rows: of one source; from it follows the number of levels. Rows that are equal in all four are counted and settled
    among themselves first: m of them take floor(m * p) and leave one row with the rest, so no group of copies is ever in
    one bucket.
    """
    done, level = [], 0
    by = rows.groupBy("src", "k", "s", "p").agg(F.count("*").alias("m"))
    by = by.withColumn("all", F.col("m") * F.col("p"))
    # what remains of several copies is kept to a whole number where it is one but for the last digits
    part = F.when(F.abs(F.col("all") - F.round("all")) < 1e-9 * F.col("m"), 0.0).otherwise(F.col("all") - F.floor("all"))
    by = by.withColumn("rest", F.when(F.col("m") == 1, F.col("p")).otherwise(part)).withColumn("up", F.round(F.col("all") - F.col("rest")).cast("long"))
    by = scratch(by.select("src", "k", "s", "m", "rest", "up"), "copies")
    certain = by.select("src", "k", "s", F.lit(1).cast("long").alias("x"), F.col("up").alias("m")).unionByName(by.select("src", "k", "s", F.lit(0).cast("long").alias("x"), (F.col("m") - F.col("up") - (F.col("rest") > 0).cast("long")).alias("m")))
    rows = by.where("rest > 0").select("src", "k", "s", F.col("rest").alias("p"))
    while True:
        buckets = max(1, -(-most_rows // fan_in))
        x = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "k", "s"), F.lit(buckets)))
        x = x.withColumn("u", _uniform(F.lit(seed + 1), F.lit(level), F.col("k"), F.col("s")))
        x = x.groupBy("src", "b").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "u", "k", "s", "p"))).alias("items"))
        x = scratch(x.select("src", F.expr(_FOLD).alias("f")).select("src", "f.*"), f"pivotal{level}")
        done.append(x.select("src", F.explode("done").alias("d")).select("src", "d.k", "d.s", "d.x"))
        rows, level = x.select("src", "k", "s", "p"), level + 1
        if buckets == 1:
            last = rows.select("src", "k", "s", F.when(F.col("p") >= 0.5, 1).otherwise(0).cast("long").alias("x"))
            break
        most_rows = buckets
    out = last
    for d in done:
        out = out.unionByName(d)
    return out.withColumn("m", F.lit(1).cast("long")).unionByName(certain.where("m > 0"))


def mix_counts(docs: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], most_copies: int, seed: int, fan_in: int) -> DataFrame:
    """Returns key, src, size, source_size, target, copies, m: m rows of docs are taken `copies` times each."""
    # the words of the texts are counted once, into a narrow table
    sizes = scratch(docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{source}`").alias("src"), count_words(F.col(f"`{text}`")).alias("size")), "sizes")
    targets = scratch(source_targets(sizes, weights, most_copies), "targets")
    most = targets.agg(F.max("n")).first()[0] or 0
    # a row for each source; the optimizer broadcasts it only below its own limit
    same = F.col("a.src").eqNullSafe(F.col("t.src"))
    q = F.try_divide(F.col("target"), F.col("source_size"))
    x = sizes.where("size > 0").alias("a").join(targets.alias("t"), same).select("k", "a.src", F.col("size").alias("s"), "source_size", "target", F.floor(q).alias("whole"), (q - F.floor(q)).alias("p"))
    rounded = pivotal(x.select("src", "k", "s", "p"), most, seed, fan_in)
    taken = rounded.alias("a").join(targets.alias("t"), same).select("k", "a.src", F.col("s").alias("size"), "source_size", "target", (F.floor(q) + F.col("x")).alias("copies"), "m")
    none = sizes.where("size = 0").alias("a").join(targets.alias("t"), same).select("k", "a.src", "size", "source_size", "target", F.lit(0).cast("long").alias("copies"), F.lit(1).cast("long").alias("m"))
    return taken.unionByName(none)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most_copies: int = 3, seed: int = 0, fan_in: int = 64) -> DataFrame:
    """Returns key, src, size, source_size, target, copies: one row for each row of docs."""
    x = mix_counts(docs, key, text, source, weights, most_copies, seed, fan_in)
    one = x.where("m = 1").drop("m")
    return one.unionByName(x.where("m > 1").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("i", "m"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most_copies: int = 3, seed: int = 0, fan_in: int = 64) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' own columns.

    Rows are named by a hash of all their columns; rows that are equal in all columns are one row with
    the copies of them all.
    """
    h, c = fresh(docs, "_row", "_copies")
    x = docs.select("*", F.xxhash64(*[F.col(f"`{n}`") for n in docs.columns]).alias(h))
    copies = mix_counts(x, h, text, source, weights, most_copies, seed, fan_in).groupBy(F.col("k").alias(h)).agg(F.sum(F.col("copies") * F.col("m")).alias(c)).where(F.col(c) > 0)
    first = x.dropDuplicates([h])
    return first.join(copies, h).withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.col(c)))).select(*[F.col(f"`{n}`") for n in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    """Query op10_mixing."""
    from loomgraph.llm.common import table

    x = mix(table(spark, sf_dir, "documents"))
    return x.select(F.col("k").alias("doc_id"), F.col("src").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
