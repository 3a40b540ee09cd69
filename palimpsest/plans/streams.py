"""Registered queries over tables that are read as streams; each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import revisions as R
from ..tables import shared_folder


def event_stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties with those of the user's event before it, from a stream of events and a state for each user."""
    folder = f"{shared_folder(spark)}/event-stream-{uuid.uuid4().hex}"
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # The pattern stands for the one table, whether it is a file or a folder.
    events = spark.readStream.schema(kind).parquet(f"{sf_dir}/event[s].parquet")
    rows = events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("revision"), F.col("props").alias("text"))
    stream = R.revision_changes(rows, late="1 day").writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key long, old_revision long, new_revision long, src string, dst string, seen long").parquet(f"{folder}/changes")


QUERIES = {f.__name__: f for f in (event_stream_changes,)}

ORACLE_SQL = {
    "event_stream_changes": """WITH e AS (SELECT user_id AS key, lag(event_id) OVER w AS old_revision, event_id AS new_revision, lag(props) OVER w AS src, props AS dst, row_number() OVER w - 1 AS seen
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT key, old_revision, new_revision, src, dst, seen FROM e WHERE seen > 0""",
}
