"""Tables that cut the lineage of iterative steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of this machine only for a local session that names none."""
    named = spark.conf.get(SHARED, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED} to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set(SHARED, named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back; a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df``, never to be broadcast where it is joined.

    Files of ids compress to a tenth and less of their rows in memory, so a table that
    seems small enough by its files can fill the driver.
    """
    return df.hint("merge")
