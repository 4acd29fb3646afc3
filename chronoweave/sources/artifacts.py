"""Timelines, episodes, manifests and snapshots as files; exports of graphs and cohorts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.schemas import EPISODE, TIMELINE


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of timeline events; a broken line becomes a row in _corrupt_record only."""
    return spark.read.schema(TIMELINE + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, each an array of episodes."""
    return spark.read.schema(EPISODE).option("multiLine", True).json(path)


def read_manifest_ids(spark: SparkSession, path: str) -> DataFrame:
    """The patient ids that any manifest names."""
    rows = spark.read.schema("patients array<struct<patient_id:string>>").option("multiLine", True).json(path)
    return rows.select(F.explode("patients.patient_id").alias("patient_id")).distinct()


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One node-link JSON text for each patient, nodes by id and links by their ends."""
    n = nodes.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("id"), "node_type"))).alias("nodes"))
    e = edges.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type"))).alias("links"))
    return n.join(e, "patient_id", "left").select("patient_id", F.to_json(F.struct(F.lit(True).alias("directed"), "nodes", F.coalesce("links", F.array()).alias("links"))).alias("json"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One GraphML text for each patient."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    node = F.concat(F.lit('<node id="'), escaped("node_id"), F.lit('"><data key="node_type">'), F.col("node_type"), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), escaped("src"), F.lit('" target="'), escaped("dst"), F.lit('"><data key="edge_type">'), F.col("edge_type"), F.lit("</data></edge>"))
    n = nodes.groupBy("patient_id").agg(F.array_join(F.array_sort(F.collect_list(node)), "").alias("n"))
    e = edges.groupBy("patient_id").agg(F.array_join(F.array_sort(F.collect_list(edge)), "").alias("e"))
    text = F.concat(F.lit('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), "n", F.coalesce("e", F.lit("")), F.lit("</graph></graphml>"))
    return n.join(e, "patient_id", "left").select("patient_id", text.alias("graphml"))


def table(rows: list[dict], style: str = "markdown") -> str:
    """A small result as Markdown or LaTeX."""
    if not rows:
        return ""
    names = list(rows[0])
    lines = [[str(r.get(n, "")) for n in names] for r in rows]
    if style == "latex":
        body = [" & ".join(x) + r" \\" for x in [names, *lines]]
        return "\n".join([r"\begin{tabular}{" + "l" * len(names) + "}", body[0], r"\hline", *body[1:], r"\end{tabular}"])
    return "\n".join(["| " + " | ".join(x) + " |" for x in [names, ["---"] * len(names), *lines]])


def first_json(text: str | None, opening: str = "{") -> str | None:
    """The first balanced JSON object (or array) in a text, quotes and escapes respected; null if none closes."""
    closing = {"{": "}", "[": "]"}[opening]
    start = (text or "").find(opening)
    while text and start >= 0:
        depth, quoted, i = 0, False, start
        while i < len(text):
            c = text[i]
            if quoted:
                if c == "\\":
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == opening:
                depth += 1
            elif c == closing:
                depth -= 1
                if not depth:
                    return text[start : i + 1]
            i += 1
        start = text.find(opening, start + 1)
    return None


def repaired(text: str | None) -> str | None:
    """The text as valid JSON: fences and trailing commas go, single quotes are swapped, open brackets are closed; null if hopeless."""
    import re

    if not text:
        return None
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip())
    whole = [bare, bare.replace("'", '"'), _closed(bare)] if bare[:1] in ("{", "[") else []
    for candidate in (*whole, first_json(bare, "{"), first_json(bare, "[")):
        if candidate:
            fixed = re.sub(r",\s*([}\]])", r"\1", candidate)
            try:
                return json.dumps(json.loads(fixed), ensure_ascii=False)
            except ValueError:
                continue
    return None


def _closed(text: str) -> str:
    """A cut-off text with its open string and brackets closed after the last whole element."""
    stack, quoted, i = [], False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
        i += 1
    whole = text + '"' * quoted
    return whole.rstrip().rstrip(",") + "".join(reversed(stack))


def repair_column(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with `out`, the repaired JSON text of a model's answers."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**{out: part[column].map(repaired)})

    return df.mapInPandas(run, schema)
