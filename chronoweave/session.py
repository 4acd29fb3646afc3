"""Session factory, and shipping of this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Rows of long texts that go to a Python worker at once bound its memory.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def session(master: str = "local[8]", **extra: str) -> SparkSession:
    """A session with the settings the engine is tested under; extra settings win."""
    builder = SparkSession.builder.master(master)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each context, as their Python workers import its functions by name; and
    lowers the session's Arrow batches from the default."""
    context = spark.sparkContext
    if not getattr(context, "_chronoweave_shipped", False):
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="chronoweave-")) / "chronoweave_package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(top.rglob("*.py")):
                archive.write(file, file.relative_to(top.parent))
        context.addPyFile(str(path))
        context._chronoweave_shipped = True
    if int(spark.conf.get(BATCH_ROWS, "10000")) >= 10_000:  # Spark's default; a smaller choice stays
        spark.conf.set(BATCH_ROWS, "2000")
    return spark
