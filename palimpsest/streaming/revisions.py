"""Streams of revisions: each batch is compared when it comes, and later results replace earlier ones.

Two forms.  :func:`diff_stream` compares pairs that come whole, by batches: a batch's
id is its epoch, and a result from an older epoch than what is known is dropped.
:func:`revision_changes` keeps the last revision of each key as state and gives out what
each new one is to be compared with; older and late revisions are dropped by event time, and a key is
forgotten when the watermark has left it behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.diff import Options, diff


def latest(results: DataFrame, key: str = "pair_id") -> DataFrame:
    """The result of the last epoch of each pair."""
    order = Window.partitionBy(key).orderBy(F.desc("epoch"))
    return results.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def _last_of_batch(pairs: DataFrame, key: str, order: str) -> DataFrame:
    best = pairs.groupBy(key).agg(F.max_by(F.struct(*pairs.columns), F.col(order)).alias("p"))
    return best.select("p.*")


def diff_stream(pairs: DataFrame, path: str, checkpoint: str, options: Options = Options(), key: str = "pair_id", order: str = "revision") -> StreamingQuery:
    """Compare a stream of pairs; of several revisions of a pair in a batch only the last by ``order`` counts.

    Each batch is written to a folder of its epoch, in place of what an earlier
    try of the batch has left there.  Read the whole with :func:`read_latest`.
    """
    def compare(batch: DataFrame, epoch: int) -> None:
        found = diff(_last_of_batch(batch, key, order), options, key=key)
        found.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return pairs.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, key: str = "pair_id") -> DataFrame:
    return latest(spark.read.parquet(path).drop("batch"), key)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "at timestamp, epoch long, text string, seen long"


def _processor(forget_ms: int) -> StatefulProcessor:
    """The state of one key.

    The class is made here and so travels by value: the planning process that
    Spark starts for it knows no packages but Spark's.
    """

    class Last(StatefulProcessor):
        """The last revision of a key."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", STATE)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # All revisions of a key in one batch, in order; a key has few, as older ones are gone.
            new = pd.concat(list(rows)).sort_values(["ts", "revision"], kind="stable")
            at, epoch, text, seen = self.last.get() if self.last.exists() else (None, None, None, 0)
            out = []
            for ts, revision, now in zip(new["ts"], new["revision"], new["text"], strict=True):
                if at is not None and (ts, revision) <= (at, epoch):
                    continue
                if at is not None:
                    out.append((key[0], epoch, int(revision), text, now, seen))
                at, epoch, text, seen = ts.to_pydatetime(), int(revision), now, seen + 1
            self.last.update((at, epoch, text, seen))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if forget_ms:
                self.handle.registerTimer(int(at.timestamp() * 1000) + forget_ms)
            yield pd.DataFrame(out, columns=["key", "old_revision", "new_revision", "src", "dst", "seen"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.last.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Last()


def revision_changes(revisions: DataFrame, late: str = "1 hour", forget_ms: int = 0) -> DataFrame:
    """A stream (key, ts, revision, text) to the changes (key, old_revision, new_revision, src, dst, seen) of each key.

    A revision follows the last one known if its time, then its number, is greater; others are
    dropped, as is what comes later than ``late`` behind the watermark.  ``seen`` counts the revisions
    before the change.  With ``forget_ms`` a key is forgotten so long after its last time.  Null texts are kept as such.
    """
    spark = revisions.sparkSession
    if spark.conf.get(_STORE) != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)  # the only store with timers and values of a key
    kind = revisions.schema["key"].dataType.simpleString()
    rows = revisions.select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("revision").cast("long").alias("revision"), "text").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_processor(forget_ms), outputStructType=f"key {kind}, old_revision long, new_revision long, src string, dst string, seen long", outputMode="Append", timeMode="EventTime"
    )
