"""Vector search by blocks: vectors are packed into matrices inside tasks, norms are taken once, and a block of queries
meets a block of terms in one matrix product. An index stores such blocks by coarse cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of a block of terms: their product takes 32 MB.
QUERIES, TERMS = 1024, 4096
#: Queries of a block that are multiplied at once: 8 MB of the product are held, with a copy for the ranking.
SLICE = 256
#: What a matrix product may be off, for unit vectors; candidates within it are measured again, pair by pair.
SLACK = 1e-9
#: The cells of an index are fitted on this many rows at most, the first by a hash of the vector.
SAMPLE, MOST_CELLS = 20_000, 1024


def _type(df: DataFrame, column: str):
    return df.schema[column].dataType.simpleString()


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of equal length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(values) % len(column):
        raise ValueError("vectors of unequal length")
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def pack(rows: DataFrame, key: str, vector: str = "embedding", group: str | None = None, size: int = TERMS) -> DataFrame:
    """ids, dims, v (doubles) and, if asked for, grp: blocks of up to `size` rows of a task, without a shuffle.

    A block holds rows of one group. Null vectors and vectors with a null are left out; all must have one length.
    """
    group_kind = _type(rows, group) if group else "string"
    x = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(None).cast("string")).alias("grp"))
    x = x.where("v is not null and not exists(v, e -> e is null)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        n = 0

        def out(g):
            parts = held.pop(g)
            m = np.concatenate([p[1] for p in parts])
            ids = pa.concat_arrays([p[0] for p in parts])
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary()), pa.array([g], kind)], ["ids", "dims", "v", "grp"])

        for b in batches:
            kind = b.column(2).type
            for start in range(0, b.num_rows, size):
                part = b.slice(start, size)
                m, groups = _matrix(part.column(1)), part.column(2).to_pylist()
                for g in dict.fromkeys(groups):
                    at = [i for i, h in enumerate(groups) if h == g] if group else range(len(groups))
                    held.setdefault(g, []).append((part.column(0).take(pa.array(list(at))), m[list(at)]))
                    n += len(at)
                    if sum(len(p[0]) for p in held[g]) >= size:
                        n -= sum(len(p[0]) for p in held[g])
                        yield out(g)
                if n >= 4 * size:  # many small groups
                    n = 0
                    for g in list(held):
                        yield out(g)
        for g in list(held):
            yield out(g)

    return x.mapInArrow(run, f"ids array<{_type(rows, key)}>, dims int, v binary, grp {group_kind}")


def best_pairs(q_ids: pa.Array, q: np.ndarray, t_ids: pa.Array, t: np.ndarray, k: int, least: float | None, cosine: bool) -> tuple[list, list, list]:
    """The k best terms of a block for each query of a block: query ids, term ids, scores; ties by term id."""
    qn, tn = np.sqrt((q * q).sum(axis=1)), np.sqrt((t * t).sum(axis=1))
    if cosine:  # a zero vector is like nothing
        own, terms = np.flatnonzero(qn > 0), np.flatnonzero(tn > 0)
    else:
        own, terms = np.arange(len(q)), np.arange(len(t))
    out_q, out_t, out_s = [], [], []
    if not len(own) or not len(terms):
        return out_q, out_t, out_s
    a, b = (q[own] / qn[own, None], t[terms] / tn[terms, None]) if cosine else (q[own], t[terms])
    scores = a @ b.T
    slack = SLACK if cosine else SLACK * max(1.0, float(qn.max() * tn.max()))
    few = min(k, scores.shape[1])
    bar = np.partition(scores, scores.shape[1] - few, axis=1)[:, scores.shape[1] - few] - slack
    if least is not None:
        bar = np.maximum(bar, least - slack)
    rows, columns = np.nonzero(scores >= bar[:, None])
    ids = t_ids.to_pylist()
    q_list = q_ids.to_pylist()
    exact = (q[own[rows]] * t[terms[columns]]).sum(axis=1)
    if cosine:
        exact = exact / qn[own[rows]] / tn[terms[columns]]
    ends = np.searchsorted(rows, np.arange(len(own) + 1))
    for i in range(len(own)):
        span = range(ends[i], ends[i + 1])
        ranked = sorted(((-exact[j], ids[terms[columns[j]]]) for j in span if least is None or exact[j] > least), key=lambda r: r)[:k]
        out_q += [q_list[own[i]]] * len(ranked)
        out_t += [r[1] for r in ranked]
        out_s += [-float(r[0]) for r in ranked]
    return out_q, out_t, out_s


def sliced_pairs(q_ids: pa.Array, q: np.ndarray, t_ids: pa.Array, t: np.ndarray, k: int, least: float | None, cosine: bool) -> tuple[list, list, list]:
    """best_pairs() by slices of the queries, so that no product of whole blocks is held."""
    out = [], [], []
    for at in range(0, len(q), SLICE):
        for found, more in zip(out, best_pairs(q_ids.slice(at, SLICE), q[at : at + SLICE], t_ids, t, k, least, cosine), strict=True):
            found += more
    return out


def _score(pairs: DataFrame, q_kind: str, t_kind: str, g_kind: str, k: int, least: float | None, cosine: bool, names: tuple[str, str, str]) -> DataFrame:
    """pairs of blocks: q_ids, q_dims, q_v, ids, dims, v, grp. Rows of the best pairs of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, q_dims, q_v, ids, dims, v, g = (b.column(c)[i] for c in range(7))
                if q_dims.as_py() != dims.as_py():
                    raise ValueError("vectors of unequal length")
                q, t = (np.frombuffer(x.as_buffer()).reshape(len(y.values), -1) for x, y in ((q_v, q_ids), (v, ids)))
                a, z, s = sliced_pairs(q_ids.values, q, ids.values, t, k, least, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(a, q_ids.values.type), pa.array(z, ids.values.type), pa.array([g.as_py()] * len(a), b.column(6).type), pa.array(s, pa.float64())], [*names, "score"])

    return pairs.select("q_ids", "q_dims", "q_v", "ids", "dims", "v", "grp").mapInArrow(run, f"`{names[0]}` {q_kind}, `{names[1]}` {t_kind}, `{names[2]}` {g_kind}, score double")


def _blocks_of(queries: DataFrame, qid: str, vector: str) -> DataFrame:
    return pack(queries, qid, vector, size=QUERIES).select(F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("v").alias("q_v"))


def top_k(queries: DataFrame, terms: DataFrame, qid: str, tid: str, k: int = 5, least: float | None = 0.0, cosine: bool = True, group: str | None = None) -> DataFrame:
    """qid, tid, score, rank (and group): the k best terms of each query, or of each query and group of terms; ties by id.

    A stated query set against all terms, block against block; each pair of blocks leaves k rows a query, so what is
    exchanged for the ranking is small. With cosine, zero vectors are left out.
    """
    pairs = pack(terms, tid, group=group).join(_blocks_of(queries, qid, "embedding"), F.lit(True))
    names = (qid, tid, group or "_grp")
    x = _score(pairs, _type(queries, qid), _type(terms, tid), _type(terms, group) if group else "string", k, least, cosine, names)
    by = [qid, group] if group else [qid]
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), tid))).where(F.col("rank") <= k)
    return x if group else x.drop("_grp")


def fit_cells(vectors: np.ndarray, n: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of n cells by k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), n, replace=False)]
    for _ in range(rounds):
        near = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        full = np.bincount(near, minlength=n) > 0
        centres = np.where(full[:, None], sums, centres)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    return centres


def build_index(terms: DataFrame, tid: str, path: str, cells: int | None = None, vector: str = "embedding") -> None:
    """Stores every term in blocks by its nearest cell at path/blocks, and the cells' centres at path/centres.

    Centres are fitted on SAMPLE rows at most (a bounded, stated sample); their number is the root of the count of
    terms, MOST_CELLS at most, unless given. A cell of many terms is many blocks.
    """
    x = terms.select(F.col(tid).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and not exists(v, e -> e is null) and exists(v, e -> e <> 0)")
    some = _matrix(x.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks())
    n = x.count()
    size = cells or max(1, min(MOST_CELLS, int(n**0.5)))
    some = some / np.linalg.norm(some, axis=1, keepdims=True) if len(some) else some
    centres = fit_cells(some, min(size, len(some))) if len(some) else some
    spark = terms.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    placed = _placed(x, centres, 1).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (TERMS * max(1, len(centres))) + 1))))
    blocks = pack(placed.repartition("cell", "salt").sortWithinPartitions("cell"), "id", "v", "cell")
    blocks.withColumnRenamed("grp", "cell").write.mode("overwrite").parquet(f"{path}/blocks")


def _placed(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """rows (id, v) with the cells of the nearest centres, one row each. Centres are MOST_CELLS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1))
            if not b.num_rows or not len(centres):
                continue
            p = min(probes, len(centres))
            near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :p]
            at = pa.array(np.repeat(np.arange(b.num_rows), p))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32))], ["id", "v", "cell"])

    return rows.mapInArrow(run, f"id {_type(rows, 'id')}, v array<double>, cell int")


def search(spark: SparkSession, path: str, queries: DataFrame, qid: str, tid: str, k: int = 5, least: float | None = 0.0, probes: int | None = None, vector: str = "embedding") -> DataFrame:
    """qid, tid, score, rank by cosine, from a stored index. probes: cells that a query visits; None visits all, which is exact."""
    blocks = spark.read.parquet(f"{path}/blocks")
    if probes is None:
        pairs = blocks.withColumn("grp", F.col("cell")).join(_blocks_of(queries, qid, vector), F.lit(True))
    else:
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()
        m = np.array(centres["v"].tolist())
        x = queries.select(F.col(qid).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and not exists(v, e -> e is null)")
        q = pack(_placed(x, m, probes).repartition("cell").sortWithinPartitions("cell"), "id", "v", "cell", QUERIES)
        q = q.select(F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("v").alias("q_v"), F.col("grp").alias("cell"))
        pairs = blocks.join(q, "cell").withColumn("grp", F.col("cell"))
    t_kind = blocks.schema["ids"].dataType.elementType.simpleString()
    x = _score(pairs, _type(queries, qid), t_kind, "int", k, least, True, (qid, tid, "_cell")).drop("_cell")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), tid))).where(F.col("rank") <= k)


def unit(v: Column) -> Column:
    """A vector at length one; null for a zero vector."""
    v = v.cast("array<double>")
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n))
