"""Prepares a session: makes the package importable in its Python workers, and bounds their batches."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows of a batch that goes to a Python worker; texts may be long, and a batch is held as a whole on both sides.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes after which a batch ends as well.
BATCH_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package's own source files to the executors, once for each application, and keep batches small."""
    if not 0 < int(spark.conf.get(_ROWS, "10000")) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    spark.conf.set(_BYTES, str(BATCH_BYTES))
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)
