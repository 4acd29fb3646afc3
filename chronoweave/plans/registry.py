"""Registration of queries with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of a table reader under its own name; `sql` is the statement that gives the same rows."""

    def register(make: Callable[[Callable[[str], DataFrame]], DataFrame]):
        key = name or make.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return make(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return make

    return register


def day(c: str):
    return F.col(c).cast("date")


def long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")
