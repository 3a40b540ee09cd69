"""Streams with state: what each revision of a key is compared with."""

import datetime as dt

from palimpsest.streaming import revisions as R

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def run(spark, tmp_path, batches, **options):
    """One file a batch, and one batch at a time."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "key long, ts timestamp, revision long, text string").coalesce(1).write.parquet(f"{folder}/{k:03d}")
    stream = spark.readStream.schema("key long, ts timestamp, revision long, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = R.revision_changes(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_state_across_batches(spark, tmp_path):
    """Order within a batch, state between batches, older and equal revisions dropped, null texts kept."""
    batches = [
        [(1, at(0), 1, "a"), (2, at(1), 1, None), (1, at(5), 2, "b")],
        [(1, at(4), 9, "old"), (1, at(5), 2, "b"), (2, at(9), 2, "y"), (1, at(7), 3, "c")],
        [(1, at(7), 4, "d"), (3, at(1), 1, "only")],
    ]
    got = run(spark, tmp_path, batches, late="10 days")
    assert got == [(1, 1, 2, "a", "b", 1), (1, 2, 3, "b", "c", 2), (1, 3, 4, "c", "d", 3), (2, 1, 2, None, "y", 1)]


def test_late_rows_are_dropped(spark, tmp_path):
    """What lies behind the watermark never reaches the state."""
    batches = [[(1, at(0), 1, "a"), (2, at(600), 1, "far ahead")], [(3, at(600), 1, "z")], [(1, at(2), 2, "late"), (3, at(601), 2, "y")], [(3, at(602), 3, "x")]]
    got = run(spark, tmp_path, batches, late="1 minute")
    assert got == [(3, 1, 2, "z", "y", 1), (3, 2, 3, "y", "x", 2)]
