"""Registered queries over streams, which give what a batch over the whole table gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.plans.catalogue import query
from loomgraph.session import shared_folder, table
from loomgraph.streaming import stateful


@query("""WITH v AS (SELECT user_id, ts AS "at", sha256(event_type || ':' || coalesce(props, '')) AS cid FROM events) SELECT user_id, "at", cid FROM v WHERE "at" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, cid DESC) = 1""")
def stream_versions(spark, sf_dir):
    """Events as versions of their user's cell: the newest of each, kept by state; the same rows come a second time and change nothing."""
    path, checkpoint = shared_folder(spark, "versions"), shared_folder(spark, "checkpoint")
    shape = table(spark, sf_dir, "events").schema
    # a pattern, since a stream reads folders only and the table may be a file
    once = lambda: spark.readStream.schema(shape).parquet(f"{sf_dir}/{{events}}.parquet")
    cid = F.sha2(F.concat("event_type", F.lit(":"), F.coalesce("props", F.lit(""))), 256)
    rows = once().unionByName(once()).select("user_id", F.col("ts").alias("at"), cid.alias("cid"))
    stateful.follow(rows, ["user_id"], path, checkpoint).awaitTermination()
    return stateful.current(spark, path, ["user_id"]).select("user_id", "at", "cid")
