"""Cohort tables, evaluation summaries and a conditional sampler of synthetic records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_one(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """variable, level, n, pct and for numbers the median with the quartiles by index; one pass for all categories."""
    total = df.count()
    levels = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("level")) for c in categories]))
    counts = df.select(levels.alias("x")).groupBy("x.variable", "x.level").agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / F.lit(max(1, total)), 1))
    out = counts.withColumns({k: F.lit(None).cast("double") for k in ("median", "q1", "q3")})
    for c in numbers:
        row = df.agg(F.count(c).alias("n"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.25)).alias("q1"), F.percentile(c, F.lit(0.75)).alias("q3"))
        out = out.unionByName(row.select(F.lit(c).alias("variable"), F.lit("").alias("level"), "n", F.round(100.0 * F.col("n") / F.lit(max(1, total)), 1).alias("pct"), *[F.col(k).cast("double").alias(k) for k in ("median", "q1", "q3")]))
    return out


def scores(results: DataFrame) -> DataFrame:
    """Counts, mean score and share correct by variable, by category, by being primary, and over all."""
    aggs = [F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("mean_score"), F.round(100.0 * F.avg((F.col("correctness") == "Correct").cast("int")), 1).alias("pct_correct"), F.countDistinct("patient_id").alias("patients")]
    return results.groupingSets([["variable"], ["category"], ["primary"], []], "variable", "category", "primary").agg(*aggs)


def corrections_applied(snapshot: DataFrame, decisions: DataFrame, confidences: tuple[str, ...] = ("high", "med", "medium")) -> DataFrame:
    """snapshot (patient_id, variable, value) after decisions (patient_id, variable, wrong, confidence, corrected): an empty correction never overwrites."""
    usable = decisions.where(F.col("wrong") & F.lower("confidence").isin(list(confidences)) & (F.trim(F.coalesce("corrected", F.lit(""))) != ""))
    one = usable.groupBy("patient_id", "variable").agg(F.max("corrected").alias("corrected"))
    return snapshot.join(one, ["patient_id", "variable"], "left").withColumn("value", F.coalesce("corrected", "value")).drop("corrected")


def frequencies(df: DataFrame, cascade: list[tuple[str, list[str]]]) -> dict[str, dict[tuple, list[tuple[object, float]]]]:
    """For each variable of the cascade, given the values of its conditions, the values with their shares. Categories, not rows."""
    out: dict[str, dict[tuple, list[tuple[object, float]]]] = {}
    for name, given in cascade:
        table: dict[tuple, dict[object, int]] = {}
        for row in df.groupBy(*given, name).count().collect():
            table.setdefault(tuple(row[g] for g in given), {})[row[name]] = row["count"]
        out[name] = {k: [(v, n / sum(c.values())) for v, n in sorted(c.items(), key=str)] for k, c in table.items()}
    return out


def sampled(spark, tables: dict[str, dict[tuple, list[tuple[object, float]]]], cascade: list[tuple[str, list[str]]], n: int, seed: int = 0, exclusive: tuple[str, ...] = ()) -> DataFrame:
    """n synthetic records drawn variable by variable given the earlier ones.

    A record's draws depend on its id and the seed only, not on its partition, so a retried task draws the same. Of the `exclusive` variables
    at most one stays 'positive'. A combination that was never seen takes the variable's overall shares.
    """
    overall = {}
    for name, _ in cascade:
        counts: dict[object, float] = {}
        for values in tables[name].values():
            for v, share in values:
                counts[v] = counts.get(v, 0.0) + share
        whole = sum(counts.values()) or 1.0
        overall[name] = [(v, s / whole) for v, s in counts.items()]
    names = [c for c, _ in cascade]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i in part["id"]:
                rng = np.random.default_rng([seed, int(i)])
                row: dict[str, object] = {}
                for name, given in cascade:
                    values = tables[name].get(tuple(row[g] for g in given)) or overall[name]
                    row[name] = values[min(int(np.searchsorted(np.cumsum([s for _, s in values]), rng.random(), side="right")), len(values) - 1)][0]
                kept = False
                for name in exclusive:
                    if row.get(name) == "positive":
                        row[name] = "negative" if kept else "positive"
                        kept = True
                rows.append([f"synthetic_{int(i):08d}", *[None if row[c] is None else str(row[c]) for c in names]])
            yield pd.DataFrame(rows, columns=["patient_id", *names])

    return spark.range(n).mapInPandas(run, "patient_id string, " + ", ".join(f"`{c}` string" for c in names))
