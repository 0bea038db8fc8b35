"""A schema library: a log of its changes, its state at a version, lookups of terms and of namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import fresh

#: What the library holds. Entries of the first four replace each other by key, examples add up.
KINDS = ("class", "property", "prefix", "pattern", "example")
ENTRY = "label string, description string, parent string, domain string, range string, text string"
LOG = f"version long, kind string, key string, removed boolean, {ENTRY}"
FIELDS = [f.split()[0] for f in ENTRY.split(", ")]
#: Prefixes that every block has, where the library knows them.
ALWAYS = ("rdf", "rdfs", "xsd", "owl")


def append(log: DataFrame | None, changes: DataFrame, path: str) -> None:
    """Adds changes (version, kind, key and fields of ENTRY; missing ones are null) to the log at path."""
    names = [f.split()[0] for f in LOG.split(", ")]
    for f in LOG.split(", "):
        n, kind = f.split()
        if n not in changes.columns:
            changes = changes.withColumn(n, F.lit(None).cast(kind))
    out = changes.select(*names)
    (out if log is None else log.select(*names).unionByName(out)).write.mode("append" if log is None else "overwrite").parquet(path)


def snapshot(log: DataFrame, version: int | None = None) -> DataFrame:
    """kind, key, version and ENTRY of what the library holds at a version (the last, if none is named).

    The latest change of a key counts, and of equal versions the greatest one, field by field; a removal takes the key
    out until it is put again. Examples, whose texts add up, stay one row each: all after the key's last removal.
    Changes of unknown kinds, and without a kind, key or version, are passed over. One aggregate, combined before the shuffle.
    """
    x = log.where(F.col("kind").isin(*KINDS) & F.col("key").isNotNull() & F.col("version").isNotNull())
    x = x.where(F.col("version") <= version) if version is not None else x
    gone = F.coalesce("removed", F.lit(False))
    one = x.where("kind <> 'example'").groupBy("kind", "key").agg(F.max(F.struct("version", gone.alias("gone"), *FIELDS)).alias("r"))
    one = one.where("not r.gone").select("kind", "key", "r.version", *[f"r.{f}" for f in FIELDS])
    ex = x.where("kind = 'example'").withColumn("gone", gone)
    out = ex.where("gone").groupBy("key").agg(F.max("version").alias("until"))
    ex = ex.where("not gone").join(out, "key", "left").where("until is null or version > until")
    return one.unionByName(ex.select("kind", "key", "version", *FIELDS))


def probe(uris: DataFrame, uri: str, held: DataFrame) -> DataFrame:
    """uris with kind, label, description, domain, range of their terms; URIs that the library doesn't have are left out.

    held: a snapshot. A URI that is both a class and a property is a class. A missing label is the URI's last part; a
    class without a description has "No description", a property's missing domain and range are "Any".
    """
    kind, label, about, domain, rng, k = fresh(uris, "kind", "label", "description", "domain", "range", "_key")
    terms = held.where("kind in ('class', 'property')").groupBy(F.col("key").alias(k)).agg(F.min_by(F.struct("kind", *FIELDS), "kind").alias("t"))
    x = uris.join(terms, F.col(uri) == F.col(k))
    is_class = F.col("t.kind") == "class"
    return x.select(
        *[F.col(f"`{c}`") for c in uris.columns],
        F.col("t.kind").alias(kind),
        F.coalesce("t.label", F.substring_index(uri, "/", -1)).alias(label),
        F.coalesce("t.description", F.when(is_class, "No description").otherwise("")).alias(about),
        F.when(~is_class, F.coalesce("t.domain", F.lit("Any"))).alias(domain),
        F.when(~is_class, F.coalesce("t.range", F.lit("Any"))).alias(rng),
    )


def first_prefix(uris: DataFrame, uri: str, prefixes: DataFrame) -> DataFrame:
    """uris with prefix: of the namespaces (ord, prefix, ns) that a URI begins with the first; null where there is none.

    Each distinct URI is cut at the lengths that namespaces have, and the cuts meet the namespaces in an equi-join.
    The lengths, a few numbers, are read by the driver.
    """
    p, cut = fresh(uris, "prefix", "_cut")
    sizes = sorted(r.n for r in prefixes.where("ns is not null").select(F.length("ns").alias("n")).distinct().collect())
    fits = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length(uri))
    cuts = uris.select(uri).where(F.col(uri).isNotNull()).distinct().select(uri, F.explode(F.transform(fits, lambda n: F.left(F.col(uri), n))).alias(cut))
    found = cuts.join(prefixes.select(F.col("ns").alias(cut), "ord", F.col("prefix").alias(p)), cut).groupBy(uri).agg(F.min_by(p, "ord").alias(p))
    return uris.join(found, uri, "left")


def prefix_block(uris: DataFrame, uri: str, prefixes: DataFrame, always: tuple[str, ...] = ALWAYS) -> DataFrame:
    """block: a line for each prefix that URIs need and for those of `always`, sorted; one row, of the library's few prefixes."""
    used = first_prefix(uris, uri, prefixes).where("prefix is not null").select("prefix").distinct()
    lines = prefixes.join(used.withColumn("used", F.lit(True)), "prefix", "left").where(F.coalesce("used", F.lit(False)) | F.col("prefix").isin(*always))
    line = F.concat(F.lit("@prefix "), "prefix", F.lit(": <"), "ns", F.lit("> ."))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("prefix", line.alias("l")))), lambda v: v["l"]), "\n").alias("block"))
