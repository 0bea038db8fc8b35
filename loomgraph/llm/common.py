"""What the operators share: tables, words, scratch tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.names import fresh

__all__ = ["count_words", "discard", "fresh", "scratch", "shared_dir", "slices", "table", "tasks", "words"]

#: White space that parts words: 0x20 and 0x09 to 0x0D. bytes.split() parts at the same six.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one set on the context.

    Only where neither is set (tests, one machine) a temporary folder serves.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(path)
    return path


#: Shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, name: str, sort: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """Writes a frame as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    The files go by discard(), else when the session's file system closes; the shuffles behind them at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _files(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(*frames: DataFrame) -> None:
    """Deletes tables that scratch() wrote and that no frame in use reads any more."""
    for f in frames:
        fs, p = _files(f.sparkSession, f.scratch_path)
        fs.delete(p, True)


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle by key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator, most_bytes: int = 8 << 20, most_rows: int = 4096) -> Iterator:
    """Record batches cut into runs of rows of about most_bytes; one row may be larger."""
    for b in batches:
        if b.num_rows == 0:
            continue
        step = max(1, min(most_rows, int(b.num_rows * most_bytes / max(1, b.nbytes))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
