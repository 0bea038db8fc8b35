"""Incremental upserts over a stream of versions, with the last signature of each cell as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField

from loomgraph.functions.names import fresh

#: State of this kind lives in RocksDB, beside the checkpoint.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastVersion(StatefulProcessor):
    """Compares the newest row of a batch with the version in the state.

    Rows of a key may be many: they pass one Arrow batch after the other and only the newest is held.
    """

    def __init__(self, columns: list[str], cid: str, micros: str, status: str, keep_ms: int | None):
        self.columns, self.cid, self.micros, self.status, self.keep_ms = columns, cid, micros, status, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "cid string, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            pdf = pdf.set_axis([*self.columns, self.micros], axis=1)  # names that begin with _ don't come through
            times = pdf[self.micros]
            tied = pdf[times == times.max()]
            top = tied.loc[[tied[self.cid].fillna("").sort_values(kind="stable").index[-1]]]
            if best is None or self.rank(top) > self.rank(best):
                best = top
        new = self.rank(best)
        old = self.last.get() if self.last.exists() else None
        if old is None:
            status = "generate"
        elif (old[1], old[0]) > new:
            status = "late"
        else:
            status = "skip" if old[0] == new[1] else "regenerate"
        if status != "late":
            self.last.update((new[1], new[0]))
            if self.keep_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(new[0] // 1000 + self.keep_ms)
        best[self.status] = status
        yield best[[*self.columns, self.status]]

    def rank(self, row: pd.DataFrame) -> tuple[int, str]:
        c = row[self.cid].iloc[0]
        return int(row[self.micros].iloc[0]), "" if pd.isna(c) else c

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes(stream: DataFrame, keys: list[str], cid: str = "cid", at: str = "at", keep: str | None = None) -> DataFrame:
    """One row for each key and batch, its newest, with a status.

    generate: the key is new; regenerate: its content changed; skip: it is as known; late: a newer version is known
    already. Newest is the greatest time, then the greatest cid; a null cid counts as an empty one, a null key is a key,
    rows without a time are left out. keep: a duration after which a key whose last version is that much older than
    the watermark is forgotten; the stream then needs a watermark on `at`, and rows behind it are dropped.
    """
    micros, status = fresh(stream, "_micros", "status")
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    x = stream.where(F.col(at).isNotNull()).withColumn(micros, F.unix_micros(F.col(at).cast("timestamp")))
    keep_ms = None if keep is None else int(spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00' + INTERVAL {keep}) - unix_millis(timestamp'1970-01-01 00:00:00')").first()[0])
    shape = stream.schema
    shape = type(shape)([*shape.fields, StructField(status, StringType())])
    worker = LastVersion(stream.columns, cid, micros, status, keep_ms)
    return x.groupBy(*keys).transformWithStateInPandas(statefulProcessor=worker, outputStructType=shape, outputMode="Append", timeMode="None" if keep is None else "EventTime")


def follow(stream: DataFrame, keys: list[str], path: str, checkpoint: str, cid: str = "cid", at: str = "at", make=None, keep: str | None = None) -> StreamingQuery:
    """Appends what changed to a table at path, which is a log of versions; begun again, it goes on where it stopped.

    make(rows) adds what is generated from them, by projections only. The file sink writes each batch once.
    """
    x = changes(stream, keys, cid, at, keep).where("status in ('generate', 'regenerate')")
    x = make(x) if make is not None else x
    return x.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str], cid: str = "cid", at: str = "at") -> DataFrame:
    """The newest version of each key in a log of versions."""
    x = spark.read.parquet(path)
    rest = [c for c in x.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(at, F.coalesce(cid, F.lit(""))))
    return x.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*")
