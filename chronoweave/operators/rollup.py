"""Aggregations of timelines and cohorts: spans, index percentiles, drift, grouped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def earliest(df: DataFrame, key: Column, order: list[str], columns: list[str]) -> DataFrame:
    """key, the columns of its first row and the count; rows with an empty key are left out."""
    rows = df.withColumn("key", key).where("key is not null and key <> ''")
    return rows.groupBy("key").agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in columns], F.count("*").alias("n"))


def index_percentile(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The element at int(n * share) of each group's ordered values, as the reference's timing report takes it.

    Ranks come from a window over the group, so a group is sorted with spilling and never held as one array.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy(*by).orderBy(value)
    ranked = df.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(W.partitionBy(*by))})
    picks = [F.max(F.when(F.col("_i") == F.floor(F.col("_n") * q).cast("int"), F.col(value))).alias(name) for name, q in shares.items()]
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), *picks)


def conditional_frequency(df: DataFrame, condition: str, value: str) -> DataFrame:
    """condition, value, n and its share of the condition's rows."""
    counts = df.groupBy(condition, value).agg(F.count("*").alias("n"))
    total = df.groupBy(condition).agg(F.count("*").alias("_t"))
    return counts.join(total, condition).withColumn("rate", F.round(F.col("n") / F.greatest(F.col("_t"), F.lit(1)), 6)).drop("_t")


def drift(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Every category of either side with its percentages and their difference in points."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.count("*").alias("_t"))
        return df.groupBy(value).agg(F.count("*").alias("_n")).join(F.broadcast(total)).select(value, (100.0 * F.col("_n") / F.greatest(F.col("_t"), F.lit(1))).alias(name))

    met = shares(left, "a_pct").join(shares(right, "b_pct"), value, "full")
    a, b = F.coalesce("a_pct", F.lit(0.0)), F.coalesce("b_pct", F.lit(0.0))
    return met.select(value, F.round(a, 6).alias("a_pct"), F.round(b, 6).alias("b_pct"), F.round(b - a, 6).alias("delta"))


def ordered_list(value: Column, *order: Column, sep: str = ",") -> Column:
    """A group's values in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.cast("string").alias("v")))), lambda x: x["v"]), sep)


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns of matching changes where they are not null."""
    named = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    met = base.join(named, key, "left")
    return met.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])
