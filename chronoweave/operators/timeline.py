"""Timeline events: normalisation, roll-up by day, order, provenance modes, one call of a language model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import clinical
from chronoweave.functions.ids import blake2b_96
from chronoweave.functions.text import normalized


def normalized_imaging(events: DataFrame) -> DataFrame:
    """Imaging rows with canonical modality and site and a description without noise."""
    known = F.coalesce(clinical.mapped(F.col("modality"), clinical.MODALITIES), F.lower(clinical.modality(F.col("description"))))
    imaging = F.col("type") == "imaging"
    pick = lambda new, old: F.when(imaging, new).otherwise(F.col(old))
    return events.withColumns({"modality": pick(known, "modality"), "site": pick(clinical.mapped(F.col("site"), clinical.SITE_MAP), "site"), "description": pick(clinical.cleaned_description(F.col("description")), "description")})


def with_event_id(events: DataFrame) -> DataFrame:
    """events with a stable id over date, kind, place, words and values."""
    values = F.array_join(F.array_sort(F.transform(F.map_entries(F.coalesce("values", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    signature = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("date", "type", "modality", "site")], normalized(F.coalesce("description", F.lit(""))), values, F.coalesce("patient_id", F.lit("")))
    return events.withColumn("event_id", blake2b_96(signature))


def rolled_up(events: DataFrame, seq: str = "seq", keep_other: bool = False) -> DataFrame:
    """One row for each patient, day and type (imaging: and modality and site); the best row's attributes, all descriptions.

    Best: MAJOR first, then the longer description, then the earlier row. Laboratory rows keep abnormal values only, the last
    of an analyte. Types outside the precedence list go unless keep_other.
    """
    order = F.array(*map(F.lit, clinical.PRECEDENCE))
    known = events if keep_other else events.where(F.array_contains(order, F.col("type")))
    imaging = F.col("type") == "imaging"
    by = ["patient_id", "date", "type", F.when(imaging, F.col("modality")).alias("_modality"), F.when(imaging, F.col("site")).alias("_site")]
    best = F.struct((F.col("priority") == "MAJOR").cast("int"), F.length("description"), -F.col(seq))
    entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.map_entries(clinical.abnormal(F.coalesce("values", F.create_map().cast("map<string,string>")))).alias("v")))), lambda x: x["v"]))
    grouped = known.groupBy(*by).agg(
        *[F.max_by(c, best).alias(c) for c in ("modality", "site", "priority", "event_id")],
        F.array_join(F.array_sort(F.collect_set("description")), ", ").alias("description"),
        entries.alias("_entries"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce("source_event_refs", F.array().cast("array<string>")).alias("r")))), lambda x: x["r"]))).alias("source_event_refs"),
        F.min(seq).alias(seq),
    )
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform("_entries", lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter("_entries", lambda e: e["key"] == k), -1)["value"].alias("value"))))
    return grouped.withColumn("values", F.when(F.col("type") == "lab", last)).withColumn("_rank", F.array_position(order, F.col("type"))).drop("_entries", "_modality", "_site")


def in_order(events: DataFrame) -> DataFrame:
    """events with place, from 1, by date, kind and sequence inside each patient."""
    return events.withColumn("place", F.row_number().over(W.partitionBy("patient_id").orderBy("date", "_rank", "seq"))).drop("_rank")


def provenance(events: DataFrame, sources: DataFrame, mode: str) -> DataFrame:
    """SOURCED_FROM edges of events: by date, by note_id, by timestamp, or by source_refs."""
    own = sources.select("patient_id", F.col("node_id").alias("dst"), "date", "note_id", "timestamp")
    if mode == "source_refs":
        return events.select("patient_id", F.col("event_id").alias("src"), F.explode("source_event_refs").alias("dst"), F.lit("SOURCED_FROM").alias("edge_type"))
    if mode not in ("date", "note_id", "timestamp"):
        raise ValueError(f"unknown provenance mode: {mode}")
    met = events.select("patient_id", F.col("event_id").alias("src"), mode).where(F.col(mode) != "").join(own, ["patient_id", mode])
    return met.select("patient_id", "src", "dst", F.lit("SOURCED_FROM").alias("edge_type"))


def stub_model(system: str, user: str) -> str:
    """A deterministic stand-in for a language model: one observation for each line that names a date."""
    import re

    found = [{"date": m[0], "type": "examination", "description": line.strip()[:160], "priority": "MINOR"} for line in user.splitlines() if (m := re.search(r"\d{4}-\d{2}-\d{2}", line))]
    return json.dumps({"events": found, "background": {}})


def ask(chunks: DataFrame, text: str, out: str, system: str, model: Callable[[str, str], str] = stub_model, longest: int = 120_000) -> DataFrame:
    """chunks with `out`, the model's answer to each text; an error becomes the answer {"error": ...} and the job goes on."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + f", `{out}` string"

    def one(t: str | None) -> str:
        try:
            return model(system, (t or "")[:longest])
        except Exception as problem:  # noqa: BLE001  the client's own errors are data here
            return json.dumps({"error": str(problem)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**{out: part[text].map(one)})

    return chunks.mapInPandas(run, schema)
