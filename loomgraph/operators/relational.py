"""Joins, upserts and searches of the knowledge-graph pipeline, as DataFrame operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.names import fresh
from loomgraph.functions.text import cosine, dot, entity_key, entity_uri
from loomgraph.operators import vectors
from loomgraph.session import shared_folder


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least `order` of each key: an aggregate, so copies are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def as_of(probes: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, value: str, default: str | None = None) -> DataFrame:
    """Last mark at or before each probe, by union and a running last value: one shuffle by `by`, no range join."""
    v, t, is_probe = fresh(probes.select("*", F.lit(0).alias(value)) if value not in probes.columns else probes, "_v", "_at", "_probe")
    p = probes.select("*", F.lit(None).cast(marks.schema[value].dataType).alias(v), F.col(at).alias(t), F.lit(1).alias(is_probe))
    m = marks.select(*by, F.col(value).alias(v), F.col(mark).alias(t), F.lit(0).alias(is_probe))
    x = p.unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(t, is_probe).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(v, ignorenulls=True).over(w)
    x = x.withColumn(value, F.coalesce(found, F.lit(default)) if default is not None else found)
    return x.where(F.col(is_probe) == 1).select(*probes.columns, value)


def unchanged(new: DataFrame, signatures: DataFrame, keys: list[str], cid: str, from_cid: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose content has a signature already, and rows to work on: a semi and an anti join."""
    names = fresh(new, *[f"_{k}" for k in keys], "_from")
    sig = signatures.select(*[F.col(k).alias(n) for k, n in zip(keys, names[:-1], strict=True)], F.col(from_cid).alias(names[-1]))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names[:-1], strict=True)] + [F.col(cid) == F.col(names[-1])]
    return new.join(sig, on, "left_semi"), new.join(sig, on, "left_anti")


def top_k(queries: DataFrame, terms: DataFrame, qid: str, tid: str, k: int = 5, least: float | None = 0.0, similarity=cosine) -> DataFrame:
    """queries, terms: id and embedding. qid, tid, score, rank of the k most similar terms of each query, ties by id."""
    return vectors.top_k(queries.select(qid, "embedding"), terms.select(tid, "embedding"), qid, tid, k, least, similarity is not dot)


WIKI = "https://en.wikipedia.org"


def upsert_entities(mentions: DataFrame, source_url: str | None = None) -> DataFrame:
    """mentions: key, ord, label, type, uri, description, chunk, alias and, where known, wikidata.

    Label and type of the first mention; the first wikidata id; distinct descriptions and chunks in the order
    they first came in, distinct aliases sorted; empty and null values don't count. A mention's address takes
    the place of the one before unless that is on the encyclopedia; the first mention's address is made from
    source_url (null without one) if it has none. Copies of a value are combined before the shuffle, so an
    entity's group holds its distinct values only.
    """
    has = "wikidata" in mentions.columns
    x = mentions.withColumn("uri", F.nullif("uri", F.lit("")))
    on_wiki = F.col("uri").startswith(WIKI)
    one = x.groupBy("key").agg(
        F.min_by("label", "ord").alias("label"),
        F.min_by("type", "ord").alias("type"),
        F.min_by(F.struct("uri"), "ord").alias("_first"),
        F.min_by("uri", F.when(on_wiki, F.col("ord"))).alias("_wiki"),
        F.max_by("uri", F.when(F.col("uri").isNotNull(), F.col("ord"))).alias("_last"),
        *([F.min_by("wikidata", F.when(F.col("wikidata") != "", F.col("ord"))).alias("wikidata")] if has else []),
    )
    made = F.coalesce("_first.uri", entity_uri(F.lit(source_url), F.col("type"), F.col("label")))
    one = one.withColumn("uri", F.when(made.startswith(WIKI), made).otherwise(F.coalesce("_wiki", "_last", made)))
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("description", "chunk", "alias")])
    values = x.select("key", "ord", F.inline(named)).where("value <> ''").groupBy("key", "name", "value").agg(F.min("ord").alias("ord"))
    came = lambda c: F.array_sort(F.collect_list(F.when(F.col("name") == c, F.struct("ord", "value"))))
    lists = values.groupBy("key").agg(
        F.transform(came("description"), lambda v: v["value"]).alias("descriptions"),
        F.transform(came("chunk"), lambda v: v["value"].cast(mentions.schema["chunk"].dataType)).alias("source_chunks"),
        F.array_sort(F.transform(came("alias"), lambda v: v["value"])).alias("aliases"),
    )
    out = one.join(lists, "key", "left")
    full = lambda c: F.coalesce(c, F.array().cast(lists.schema[c].dataType)).alias(c)
    return out.select("key", "label", "type", "uri", *map(full, lists.columns[1:]), *(["wikidata"] if has else []))


def alias_targets(mentions: DataFrame) -> DataFrame:
    """alias_key, key: which entity an alias stands for; the last mention wins."""
    x = mentions.where("alias <> ''").select(entity_key(F.col("alias")).alias("alias_key"), "key", "ord")
    return x.groupBy("alias_key").agg(F.max_by("key", "ord").alias("key"))


def lookup_entities(labels: DataFrame, label: str, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each label's entity key as found: the alias's entity if the label is an alias, else the label's own; null if there is none."""
    k, a, c, found = fresh(labels, "_k", "_a", "_c", "found")
    x = labels.withColumn(k, entity_key(F.col(label)))
    x = x.join(aliases.select(F.col("alias_key").alias(k), F.col("key").alias(a)), k, "left").withColumn(c, F.coalesce(a, k))
    return x.join(entities.select(F.col("key").alias(c), F.col("key").alias(found)), c, "left").select(*labels.columns, found)


def endpoints(relations: DataFrame, mentions: DataFrame, entities: DataFrame, per: int = 250_000) -> DataFrame:
    """relations: chunk, source_id, target_id, ...; mentions: chunk, id, label; entities: key, id.

    Ids of a chunk's relations become those of the entities: by the chunk's own mentions, then by their labels in lower
    case. Both ends must be among the chunk's mentions (of several with one id the least label); an end whose label is no
    entity keeps its id. Relations are counted first: mentions and relations meet in as many tasks as leave about `per`
    relations to one, so a task's sorts don't grow with the input.
    """
    rest = [c for c in relations.columns if c not in ("source_id", "target_id")]
    tasks = max(int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-relations.count() // per))
    one = mentions.repartition(tasks, "chunk", "id").groupBy("chunk", "id").agg(F.min("label").alias("label"))
    known = one.join(entities.select("key", F.col("id").alias("global")), F.lower("label") == F.col("key"), "left")
    end = lambda name: known.select("chunk", F.col("id").alias(name), F.coalesce("global", "id").alias(f"new_{name}")).repartition(tasks, "chunk", name)
    x = relations.repartition(tasks, "chunk", "source_id").join(end("source_id"), ["chunk", "source_id"])
    x = x.repartition(tasks, "chunk", "target_id").join(end("target_id"), ["chunk", "target_id"])
    return x.select(*rest, F.col("new_source_id").alias("source_id"), F.col("new_target_id").alias("target_id"))


def merged_top_k(queries: DataFrame, terms: DataFrame, qid: str, tid: str, vocabulary: str, k: int = 5, least: float | None = 0.0) -> DataFrame:
    """The k best of each vocabulary, then the k best of these, for each query; ties by id. Returns qid, vocabulary, tid, score, rank."""
    each = vectors.top_k(queries.select(qid, "embedding"), terms.select(tid, vocabulary, "embedding"), qid, tid, k, least, group=vocabulary).drop("rank")
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), tid))).where(F.col("rank") <= k)
    return best.select(qid, vocabulary, tid, "score", "rank")


def library_search(queries: DataFrame, terms: DataFrame, qid: str, tid: str, kind: str, order: str, k: int = 20) -> DataFrame:
    """qid, kind, tid, rank: the k best terms of all kinds by the plain product, then split by kind.

    A query without an embedding gets the first k terms of each kind, in the library's order.
    """
    found = top_k(queries.where("embedding is not null"), terms, qid, tid, k, None, dot).select(qid, tid, "rank")
    split = found.join(terms.select(tid, kind), tid).select(qid, kind, tid, F.row_number().over(Window.partitionBy(qid, kind).orderBy("rank")).alias("rank"))
    first = terms.select(tid, kind, F.row_number().over(Window.partitionBy(kind).orderBy(order)).alias("rank")).where(F.col("rank") <= k)
    return split.unionByName(queries.where("embedding is null").select(qid).join(first, F.lit(True)).select(qid, kind, tid, "rank"))  # k terms of each kind


def nearest_rows(rows: DataFrame, vector: list[float], k: int = 10, *keys: str) -> DataFrame:
    """The k rows least far from a vector, with their Euclidean distance."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    gap = F.aggregate(F.zip_with("embedding", v, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.select(*keys, F.sqrt(gap).alias("distance")).orderBy("distance", *keys).limit(k)


def numbered(rows: DataFrame, order: str, name: str, per: int = 100_000) -> DataFrame:
    """Adds the place of each row, from 1, in the order of a unique value; no window covers all rows.

    Rows are dealt to ranges of about `per` rows by a sample of the values, however these are spread, and written with
    their range, so that counts and places are taken of the same ranges; the counts of the ranges before give each
    row's place. Null values come first.
    """
    r, c, before = fresh(rows, "_range", "_count", "_before")
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "numbered")
    ranges = max(1, -(-rows.count() // per))
    rows.repartitionByRange(ranges, order).withColumn(r, F.spark_partition_id()).write.parquet(path)
    x = spark.read.parquet(path)
    counts = x.groupBy(r).agg(F.count("*").alias(c))
    counts = counts.select(r, (F.sum(c).over(Window.orderBy(r)) - F.col(c)).alias(before))  # a row for each range
    place = F.col(before) + F.row_number().over(Window.partitionBy(r).orderBy(order))
    return x.join(counts, r).withColumn(name, place).drop(r, before)


def weighted_sample(rows: DataFrame, key: str, weight: Column, k: int, seed: str = "42") -> DataFrame:
    """k rows without replacement, by weight: the least -ln(u) / weight, u from a hash of seed and key."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return rows.orderBy(-F.log(u) / weight, key).limit(k)


def seeded_split(rows: DataFrame, key: str, share: float, seed: str = "42", per: int = 100_000) -> DataFrame:
    """Adds split: train for floor(share * n) rows in the order of a hash, else dev.

    Places are counted range by range, not in one task: the hash is uniform, so its leading digits deal the rows, as
    many of them as leave about `per` rows to a range; the counts of the ranges before give each row's place.
    """
    h, b, n, before, every = fresh(rows, "_h", "_b", "_n", "_before", "_all")
    digits = max(1, math.ceil(math.log(max(1, rows.count() / per), 16)))
    x = rows.withColumn(h, F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary"))).withColumn(b, F.substring(h, 1, digits))
    counts = x.groupBy(b).agg(F.count("*").alias(n))
    up_to = F.sum(n).over(Window.orderBy(b).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(b, (up_to - F.col(n)).alias(before), F.sum(n).over(Window.partitionBy(F.lit(1))).alias(every))  # a row for each range
    place = F.col(before) + F.row_number().over(Window.partitionBy(b).orderBy(h, key))
    split = F.when(place <= F.floor(F.col(every) * F.lit(share)), "train").otherwise("dev")
    return x.join(counts, b).withColumn("split", split).drop(h, b, before, every)
