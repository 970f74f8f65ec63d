"""Making the package known to a session's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Texts may be very long: batches to Python workers are bounded in bytes, not only in rows.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "64m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="docweft-"), "docweft.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    p = os.path.join(folder, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    if not spark.sparkContext.getConf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    _shipped.add(app)
