"""Artefacts of a run: data sets, configurations, baselines, vocabularies, registries, graphs; saved and read again.

Rows are saved as tables, so any number of them is written by all tasks; what names a whole (a config, a baseline,
a data set's id) is one row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import canonical
from loomgraph.functions.cid import cid
from loomgraph.functions.render import baseline_input, improvement

SCHEMAS = {
    "trainset": ("chunk_text", "section_context"),
    "devset": ("chunk_text", "section_context"),
    "fewshot_examples": ("chunk_text", "section_context", "statements"),
    "training_data": ("chunk_text", "section_context", "statements", "chunk_num", "cid"),
    "evaluation": ("chunk_text", "section_context", "statements", "classifications", "score"),
}


def rows_cid(rows: DataFrame, order: str, text: str, fan_in: int = 1024) -> DataFrame:
    """cid, n: one id for all rows in order, as a tree: the ids of up to fan_in neighbours are hashed, level by level.

    order: a long that counts the rows from 0. No task holds more than fan_in ids.
    """
    n = rows.count()
    x = rows.select(F.col(order).cast("long").alias("o"), cid(F.col(text)).alias("c"))
    m = max(n, 1)
    while True:
        x = x.groupBy(F.floor(F.col("o") / fan_in).alias("o")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda r: r["c"]), "").alias("t"))
        x = x.select("o", cid(F.col("t")).alias("c"))
        m = -(-m // fan_in)
        if m <= 1:
            return x.select(F.col("c").alias("cid"), F.lit(n).cast("long").alias("n"))


def save_examples(rows: DataFrame, kind: str, path: str, order: str = "ord") -> DataFrame:
    """kind: a key of SCHEMAS. Saves the rows in order, each with its id, and returns the data set's id and count.

    A row's id is that of its columns as canonical JSON.
    """
    names = list(SCHEMAS[kind])
    x = rows.select(F.col(order).cast("long").alias("ord"), *names, canonical.row(rows, names).alias("json"))
    x = x.withColumn("row_cid" if "cid" in names else "cid", cid(F.col("json")))
    x.drop("json").write.mode("overwrite").parquet(f"{path}/{kind}")
    whole = rows_cid(x, "ord", "json")
    whole.write.mode("overwrite").parquet(f"{path}/{kind}_cid")
    return rows.sparkSession.read.parquet(f"{path}/{kind}_cid")


def save_counted(rows: DataFrame, path: str, counters: dict[str, Column]) -> dict[str, int]:
    """Writes rows and returns counters (aggregates) over them, which come with the write: no second pass."""
    seen = Observation()
    rows.observe(seen, *[c.alias(n) for n, c in counters.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def dump(rows: DataFrame, path: str) -> None:
    """Rows as canonical JSON, one a line: samples, evaluations, results."""
    rows.select(canonical.row(rows).alias("value")).write.mode("overwrite").text(path)


def save_settings(rows: DataFrame, path: str, kind: str) -> None:
    """Configurations, baselines and the like: each row with its id (of all its columns as canonical JSON), kept beside those before."""
    canonical.with_cid(rows).write.mode("append").parquet(f"{path}/{kind}")


def load(spark: SparkSession, path: str, kind: str, required: bool = True) -> DataFrame | None:
    """The rows of a saved artefact; where there is none, an error that says so, or None."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        if required:
            raise FileNotFoundError(f"{kind} not found at {path}. Run the step that saves it first.")
        return None
    return spark.read.parquet(f"{path}/{kind}")


def config_json(fields: dict[str, object]) -> str:
    """A configuration as JSON with its id, which is made from the other fields with sorted keys."""
    return json.dumps(fields | {"cid": cid_of(json.dumps(fields, sort_keys=True))}, indent=2)


def cid_of(text: str) -> str:
    """The id of a text on the driver; cid() is the same for columns."""
    import base64
    import hashlib

    raw = bytes.fromhex("01551220") + hashlib.sha256(text.encode()).digest()
    return "b" + base64.b32encode(raw).decode().lower().rstrip("=")


def baselines(runs: DataFrame) -> DataFrame:
    """runs: score, eval_size, config_cid, extractor_cid, devset_cid. Adds input_cid: null without a config or dev set."""
    known = (F.col("config_cid") != "") & (F.col("devset_cid") != "")
    return runs.withColumn("input_cid", F.when(known, baseline_input(F.col("config_cid"), F.col("devset_cid"), F.col("eval_size"), F.col("extractor_cid"))))


def optimized(runs: DataFrame, at: Column) -> DataFrame:
    """runs: name, baseline_score, optimized_score. Adds improvement and stamp, the name of the run's folder."""
    return runs.withColumns({"improvement": improvement(F.col("optimized_score"), F.col("baseline_score")), "stamp": stamp(at)})


def latest(runs: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last run of each name: what the link to the latest names."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def iso(at: Column) -> Column:
    """ISO 8601 with microseconds, which are left out where they are zero."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def month_before(at: Column, days: int = 30) -> tuple[Column, Column]:
    """Year and month some days before."""
    then = F.date_sub(at.cast("date"), days)
    return F.year(then), F.month(then)


def elapsed(a: Column, b: Column) -> Column:
    """Seconds between two times."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def run_path(base: str, title: Column, at: Column, slashes: bool = True) -> Column:
    """base/slug/stamp; with slashes, those of a title become underscores too."""
    slug = F.translate(F.lower(title), " /", "__") if slashes else F.translate(F.lower(title), " ", "_")
    return F.concat_ws("/", F.lit(base), slug, stamp(at))


def continue_from(files: DataFrame, runs: DataFrame) -> DataFrame:
    """files: path, name and content; runs: path, from_path. The files that a run starts with: copies of those of the run it continues."""
    f = files.withColumnRenamed("path", "from_path")
    return runs.where("from_path is not null").join(f, "from_path").select("path", *[c for c in f.columns if c != "from_path"])


def save_vocabulary(terms: DataFrame, path: str, prefix: str = "prefix") -> None:
    """Terms with their embeddings, a folder for each vocabulary."""
    terms.write.mode("overwrite").partitionBy(prefix).parquet(path)


def registry_json(entities: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """by, value: JSON of each registry's entities by key. A source's own entities come together."""
    rest = [c for c in entities.columns if c not in [*by, key]]
    return entities.groupBy(*by).agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.struct(*rest).alias("e"))))).alias("entities"))).alias("value"))


def registry_entities(values: DataFrame, by: list[str], entity: str, key: str = "key") -> DataFrame:
    """values: by, value (JSON). Returns by, key and the fields of `entity` (DDL) for each entity."""
    x = values.select(*by, F.explode(F.from_json("value", f"entities map<string,struct<{entity}>>")["entities"]).alias(key, "e"))
    return x.select(*by, key, "e.*")


def export_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Two tables that any engine reads."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")


def search(runs: DataFrame, at: str, tie: str, most: int) -> DataFrame:
    """The latest `most` runs, the last one first; equal times are ordered by `tie`, those without a time come last."""
    return runs.orderBy(F.desc_nulls_last(at), tie).limit(most)
