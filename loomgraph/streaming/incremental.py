"""An extension: incremental signatures over a stream of changed content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.cid import cid


def signed(stream: DataFrame, text: str, at: str, late: str = "1 hour") -> DataFrame:
    """Content ids of a stream, each once within the watermark."""
    return stream.withColumn("cid", cid(F.col(text))).withWatermark(at, late).dropDuplicatesWithinWatermark(["cid"])


def upsert_to(path: str):
    """For foreachBatch: appends the rows of a batch whose content id isn't in the table at path yet."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(path).select("cid")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        new = batch if known is None else batch.join(known, "cid", "left_anti")
        new.write.mode("append").parquet(path)

    return write
