"""Successors, gap clusters, band, interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def successors(df: DataFrame, by: list[str], order: list, columns: list[str]) -> DataFrame:
    """df with next_<column> of the following row of its group; the last row of a group goes."""
    along = W.partitionBy(*by).orderBy(*order)
    out = df.withColumns({f"next_{c}": F.lead(c).over(along) for c in columns})
    return out.where(F.col(f"next_{columns[0]}").isNotNull())


def gap_clusters(df: DataFrame, by: list[str], order: list, gap: Column, longest, name: str = "cluster") -> DataFrame:
    """df with a number, from 1, for runs whose gap to the row before is at most `longest`; a gap of null opens a run.

    `gap` may use _before, the struct of the row before.
    """
    along = W.partitionBy(*by).orderBy(*order)
    before = df.withColumn("_before", F.lag(F.struct(*df.columns)).over(along))
    opened = before.withColumn("_opens", F.when(gap <= longest, 0).otherwise(1))
    return opened.withColumn(name, F.sum("_opens").over(along.rowsBetween(W.unboundedPreceding, 0))).drop("_before", "_opens")


def islands(df: DataFrame, by: list[str], order: list, state: str, name: str = "island") -> DataFrame:
    """df with a number, from 1, for runs of rows of equal state."""
    along = W.partitionBy(*by).orderBy(*order)
    changed = df.withColumn("_c", F.when(F.lag(state).over(along).eqNullSafe(F.col(state)) & (F.row_number().over(along) > 1), 0).otherwise(1))
    return changed.withColumn(name, F.sum("_c").over(along.rowsBetween(W.unboundedPreceding, 0))).drop("_c")


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_day: str, right_day: str, days: int, how: str = "inner") -> DataFrame:
    """Rows of equal `on` whose dates differ by at most `days`.

    The left side is spread over the buckets of 2 * days + 1 days that its band meets, two at most, so that the join is an equi-join on
    (on, bucket): a large group is dealt over its buckets. Each pair meets once, for a right row has one bucket. how: inner, left_semi or
    left_anti; for these rows of `left` are told apart by all columns, and repeated rows stay repeated.
    """
    width = 2 * days + 1
    bucket = lambda day, shift=0: F.floor((F.unix_date(F.col(day)) + shift) / F.lit(width))
    keyed = right.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], F.col(right_day).alias("_day"), bucket(right_day).alias("_rb"), *([c for c in right.columns if c not in on] if how == "inner" else []))
    spread = left.withColumn("_ends", F.when(F.col(left_day).isNotNull(), F.array_distinct(F.array(bucket(left_day, -days), bucket(left_day, days)))))
    same = [F.col(c).eqNullSafe(F.col(f"_on{i}")) if how != "inner" else F.col(c) == F.col(f"_on{i}") for i, c in enumerate(on)]
    near = F.abs(F.datediff(F.col(left_day), F.col("_day"))) <= days
    if how == "inner":
        met = spread.withColumn("_lb", F.explode("_ends")).drop("_ends").join(keyed, [*same, F.col("_lb") == F.col("_rb"), near])
        return met.drop("_lb", "_rb", "_day", *[f"_on{i}" for i in range(len(on))])
    first, second = F.get("_ends", 0), F.get("_ends", 1)
    one = spread.withColumns({"_b0": first, "_b1": F.coalesce(second, first - 1)})
    semi = lambda df, b, kind: df.join(keyed, [*same, F.col(b) == F.col("_rb"), near], kind)
    if how == "left_anti":
        return semi(semi(one, "_b0", "left_anti"), "_b1", "left_anti").select(left.columns)
    rest = semi(one, "_b0", "left_anti")
    return semi(one, "_b0", "left_semi").select(left.columns).unionAll(semi(rest, "_b1", "left_semi").select(left.columns))


def nearest(left: DataFrame, right: DataFrame, on: list[str], key: list[str], left_day: str, right_day: str, days: int, tie: list[str]) -> DataFrame:
    """Each left row, named by `key`, with the right row of the nearest date within `days`; the earlier date wins a tie, then `tie`."""
    met = band_join(left, right, on, left_day, right_day, days)
    order = W.partitionBy(*key).orderBy(F.abs(F.datediff(left_day, right_day)), right_day, *tie)
    return met.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank; Spark prunes groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def greedy_chunks(df: DataFrame, by: list[str], order: list[str], size: str, limit: int, name: str = "chunk_no") -> DataFrame:
    """Greedy forward packing: a row opens the next chunk, from 0, if it would overflow the one before; larger rows stand alone.

    The fold runs inside one expression over a group's ordered sizes; a group is one document's or one person's rows.
    """
    state = "struct<chunk:int,held:bigint,out:array<int>>"

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["held"] + x <= limit) | (acc["held"] == 0)
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        return F.struct(chunk.alias("chunk"), F.when(fits, acc["held"] + x).otherwise(x).alias("held"), F.array_append(acc["out"], chunk).alias("out"))

    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("held"), F.array().cast("array<int>").alias("out")).cast(state)
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(size).cast("bigint").alias("_size"), *[c for c in df.columns if c not in (*by, *order)]))).alias("_rows"))
    packed = rows.withColumn("_out", F.aggregate(F.transform("_rows", lambda r: r["_size"]), start, step)["out"])
    each = packed.select(*by, F.posexplode("_rows").alias("_i", "_row"), "_out").withColumn(name, F.get("_out", F.col("_i")))
    return each.select(*by, *[F.col(f"_row.{c}") for c in df.columns if c not in by], name)
