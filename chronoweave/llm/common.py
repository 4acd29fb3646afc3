"""Words, shared storage and small column helpers that the operators have in common."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import ship

#: What separates words: the space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder; the package goes to the executors with the first one."""
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, also where body is a lambda over elements."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add: an input column named like an output is replaced."""
    return df.drop(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where all run in this process (master local)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="chronoweave-"))
        named = context.getCheckpointDir()
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage, survives lost executors. See `discard`."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that no later plan reads: call it once what was made of them is itself stored."""
    for table in tables:
        java = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        java.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(java, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more, before the next ones are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
