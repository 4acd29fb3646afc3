"""Episodes: rules, population by date, validation, merging of work-ups."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import clinical
from chronoweave.functions.ids import blake2b_96
from chronoweave.operators import timeline
from chronoweave.schemas import EPISODE
from chronoweave.sources import artifacts

# The rules' keywords and the kinds an episode may have.
SYSTEMIC = ["chemotherapy", "immunotherapy", "targeted", "bevacizumab", "carboplatin", "cisplatin", "pembrolizumab", "nivolumab", "erlotinib", "osimertinib"]
PROGRESSION = ["progression", "progressed", "pd", "worsening", "increase in size"]
RESPONSE = ["partial response", "pr ", "complete response", "cr ", "stable disease", "sd "]
SEVERE = ["grade 3", "grade 4", "hospital", "held", "dose reduction", "stopped"]
KINDS = ["baseline", "diagnosis", "treatment_line", "post_oncological", "systemic_tx_line", "imaging_based_state", "rt_course", "surgery_course", "major_ae", "hospitalization", "progression", "surveillance"]
DIAGNOSTIC = ["biopsy", "pathology", "malignant", "cancer", "carcinoma", "mesothelioma"]
STARTS = ["start", "initiate", "began", "commenced", "first cycle", "cycle 1"]
CONTEXT = ["treatment", "diagnostic", "symptom", "adverse_effect", "lab", "examination"]
STATES = ["baseline", "response", "stable", "progression"]
OUT = "patient_id string, kind string, start_date string, end_date string, anchor_event_id string, event_ids array<string>, line_number int, response_status string"
COLUMNS = ["patient_id", "kind", "start_date", "end_date", "anchor_event_id", "event_ids", "line_number", "response_status"]


def _walk(events: pd.DataFrame, whole_words: bool) -> list[dict]:
    """One patient's episodes from their events in order.

    A systemic treatment opens a line unless the line opened last names it; then it joins the latest open line. Progression closes the
    latest open line, a response marks it.
    """

    def named(told: str, terms: list[str]) -> bool:
        if whole_words:
            return any(re.search(rf"(?<![\w-]){re.escape(t.strip())}(?![\w-])", told) for t in terms)
        return any(t in told for t in terms)

    out: list[dict] = []
    lines: list[dict] = []
    regimen: str | None = None

    def add(kind: str, e, **more) -> dict:
        out.append({"kind": kind, "start_date": e.date, "end_date": e.date, "anchor_event_id": e.event_id, "event_ids": [e.event_id], "line_number": None, "response_status": None} | more)
        return out[-1]

    def latest_open() -> dict | None:
        return next((x for x in reversed(lines) if x["end_date"] is None), None)

    for e in events.sort_values(["date", "_rank", "seq"]).itertuples():
        told = (e.description or "").lower()
        if e.type == "diagnostic" and "malignan" in told:
            add("diagnosis", e)
        if e.type == "treatment" and any(k in told for k in SYSTEMIC):
            if regimen is None or (e.description or "") not in regimen:
                regimen = e.description or ""
                lines.append(add("systemic_tx_line", e, end_date=None, line_number=len(lines) + 1))
            elif (line := latest_open()) is not None:
                line["event_ids"].append(e.event_id)
        if e.type in ("treatment", "procedure") and "radiation" in told:
            add("rt_course", e)
        if e.type == "surgery":
            add("surgery_course", e)
        if e.type in ("imaging", "diagnostic"):
            line = latest_open()
            if named(told, PROGRESSION):
                if line is not None:
                    line["end_date"], line["response_status"] = e.date, "Progression"
                add("progression", e)
            elif named(told if not whole_words else told + " ", RESPONSE) and line is not None:
                line["response_status"] = "Response/SD"
        if e.type == "adverse_effect" and any(k in told for k in SEVERE):
            add("major_ae", e)
    return out


def derive(events: DataFrame, whole_words: bool = True) -> DataFrame:
    """Episodes of each patient by rules. One patient's record is bounded (thousands of rows), and each line depends on the text of the one before.

    whole_words: the words of progression and response must stand alone, so that "PD-L1" is no progression; off, they are bare substrings.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, clinical.PRECEDENCE)), F.col("type")), F.lit(0)), F.lit(999))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = _walk(part, whole_words)
        return pd.DataFrame([{"patient_id": part["patient_id"].iloc[0], **x} for x in found], columns=COLUMNS).astype({"line_number": "Int32"})

    return events.select("patient_id", "seq", "event_id", "date", "type", "description", rank.alias("_rank")).groupBy("patient_id").applyInPandas(run, OUT)


def lite(events: DataFrame, longest: int = 160) -> DataFrame:
    """patient_id and its events as one JSON text for a prompt: place, id, date, type, a short description, priority, modality and site."""
    one = F.struct("seq", "event_id", "date", "type", F.substring(F.coalesce("description", F.lit("")), 1, longest).alias("description"), F.coalesce("priority", F.lit("MINOR")).alias("priority"), "modality", "site")
    return events.groupBy("patient_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("events_json"))


def hints(events: DataFrame) -> DataFrame:
    """Each event that bears on episodes with its role: imaging_anchor (with category), diagnosis, surgery, treatment_start or context."""
    told, kind = F.lower(F.coalesce("description", F.lit(""))), F.lower(F.coalesce("type", F.lit("")))
    role = (
        F.when((kind == "imaging") & (F.upper("priority") == "MAJOR"), "imaging_anchor").when((kind == "diagnostic") & clinical._any(told, DIAGNOSTIC), "diagnosis")
        .when(kind == "surgery", "surgery").when((kind == "treatment") & clinical._any(told, STARTS), "treatment_start").when(kind.isin(CONTEXT), "context")
    )
    category = F.when(role == "imaging_anchor", clinical.imaging_class(F.col("description")))
    return events.withColumns({"role": role, "category": category}).where("role is not null").select("patient_id", "seq", "event_id", "date", "role", "category", F.substring("description", 1, 80).alias("description"))


def cut_by_model(events: DataFrame, model, system: str = "", feedback: DataFrame | None = None) -> DataFrame:
    """Episodes that a model cuts: patient_id and columns of EPISODE; a patient whose answer does not parse has none. feedback: patient_id, errors."""
    prompts = lite(events)
    if feedback is not None:
        prompts = prompts.join(feedback, "patient_id").withColumn("events_json", F.concat("events_json", F.lit("\n\nVALIDATION ERRORS FROM PREVIOUS ATTEMPT:\n"), "errors")).drop("errors")
    answers = timeline.ask(prompts, "events_json", "answer", system, model)
    parsed = artifacts.repair_column(answers, "answer", "fixed").select("patient_id", F.from_json("fixed", f"episodes array<{_structure()}>").alias("x"))
    return parsed.select("patient_id", F.explode("x.episodes").alias("e")).select("patient_id", "e.*")


def _structure() -> str:
    fields = [c.strip() for c in EPISODE.split(", ") if not c.strip().startswith("patient_id")]
    return "struct<" + ", ".join(c.replace(" ", ":", 1) for c in fields) + ">"


def by_model(events: DataFrame, model, system: str = "") -> DataFrame:
    """Episodes of a model where they are valid, at the first or, told what was wrong, at the second try; by rules for the other patients."""
    first = populated(cut_by_model(events, model, system), events)
    wrong = problems(first, events)
    told = wrong.groupBy("patient_id").agg(F.array_join(F.array_sort(F.collect_set("problem")), "\n").alias("errors"))
    lost = events.select("patient_id").distinct().join(first.select("patient_id").distinct(), "patient_id", "left_anti").select("patient_id", F.lit("no episodes generated").alias("errors"))
    again = told.unionByName(lost)
    second = populated(cut_by_model(events, model, system, again), events)
    second = second.join(problems(second, events).select("patient_id").distinct(), "patient_id", "left_anti")
    good = first.join(again.select("patient_id"), "patient_id", "left_anti").unionByName(second, allowMissingColumns=True)
    rest = events.join(good.select("patient_id").distinct(), "patient_id", "left_anti")
    return with_ids(good.unionByName(derive(rest), allowMissingColumns=True))


def patient_info(states: DataFrame) -> DataFrame:
    """patient_id and the snapshot in three sections from flat patient states (strings and arrays by name); missing fields take defaults."""

    def field(name: str, default, source: str | None = None):
        value = F.lit(None) if default is None else F.array() if default == [] else F.lit(default)
        return (F.coalesce(F.col(source or name), value) if (source or name) in states.columns else value).alias(name)

    demographics = [field("name", "Unknown"), field("date_of_birth", "Unknown"), field("sex", "Unknown"), field("height_cm", None), field("weight_kg", None), field("ecog_performance_status", "Unknown"), field("previous_conditions", ""), field("therapy_toxicities", "None"), field("allergies", []), field("smoking_history", "Unknown"), field("medications", []), field("dnr", "No")]
    tumor = [field("diagnosis", "Unknown"), field("tnm_staging", "Unknown"), field("histology", "Unknown"), field("metastasis_status", "Unknown"), field("lymph_node_involvement", "Unknown"), field("driver_mutations", None), field("latest_updates", []), field("body_diagram_image", "")]
    treated = [field("current", [], "current_treatment"), field("previous", [], "previous_treatment"), field("radiation_therapy", "No"), F.array().alias("alternatives"), field("surgical_candidate", "Not assessed")]
    return states.select("patient_id", F.struct(*demographics).alias("PATIENT DEMOGRAPHICS"), F.struct(*tumor).alias("TUMOR INFORMATION"), F.struct(*treated).alias("TREATMENTS"))


def populated(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """Episodes without event_ids get those of their patient dated inside them; an open end has no bound.

    A baseline takes the baseline_information events of any date, or where there are none the critical_information ones.
    """
    keyed = episodes.withColumn("_id", F.struct("patient_id", "kind", "start_date", "anchor_event_id"))
    empty = keyed.where(F.coalesce(F.size("event_ids"), F.lit(0)) <= 0).select("_id", "patient_id", "kind", "start_date", "end_date")
    kind = F.col("type") if "type" in events.columns else F.lit(None).cast("string")
    own = events.select("patient_id", "event_id", "date", "seq", kind.alias("_type"))
    base = own.where("_type in ('baseline_information', 'critical_information')")
    lowest = F.min("_type").over(W.partitionBy("patient_id"))  # baseline_information comes first
    base = base.withColumn("_least", lowest).where("_type = _least").drop("_least")
    inside = (F.col("date") >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col("date") <= F.col("end_date")))
    met = empty.where("kind <> 'baseline'").join(own, "patient_id").where(inside).unionByName(empty.where("kind = 'baseline'").join(base, "patient_id"))
    listed = met.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "seq", "event_id"))), lambda x: x["event_id"]).alias("_found"))
    out = keyed.join(listed, "_id", "left")
    return out.withColumn("event_ids", F.when(F.coalesce(F.size("event_ids"), F.lit(0)) > 0, F.col("event_ids")).otherwise(F.coalesce("_found", F.array().cast("array<string>")))).drop("_id", "_found")


def corrected_dates(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """start_date and end_date from the members' dates where there are any."""
    keyed = episodes.withColumn("_id", F.struct("patient_id", "kind", "start_date", "anchor_event_id"))
    member = keyed.select("_id", "patient_id", F.explode("event_ids").alias("event_id")).join(events.select("patient_id", "event_id", "date"), ["patient_id", "event_id"])
    bounds = member.where("date <> ''").groupBy("_id").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    out = keyed.join(bounds, "_id", "left")
    return out.withColumns({"start_date": F.coalesce("_lo", "start_date"), "end_date": F.coalesce("_hi", "end_date")}).drop("_id", "_lo", "_hi")


def with_ids(episodes: DataFrame) -> DataFrame:
    """Ids of patient, kind, start and anchor where missing or temporary."""
    made = blake2b_96(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("patient_id", "kind", "start_date", "anchor_event_id")]))
    old = F.col("episode_id") if "episode_id" in episodes.columns else F.lit(None).cast("string")
    return episodes.withColumn("episode_id", F.when(old.isNull() | old.startswith("temp"), made).otherwise(old))


def problems(episodes: DataFrame, events: DataFrame, most: int = 25) -> DataFrame:
    """patient_id, episode (place by start) and what is wrong with it. Places follow the column `place` where there is one.

    Bounds are those of the patient's dated events; a baseline may start a day before them and have an anchor of its own that says so.
    """
    given = F.col("place") if "place" in episodes.columns else F.coalesce("start_date", F.lit(""))
    along = W.partitionBy("patient_id").orderBy(given, "kind")
    state = F.col("disease_state") if "disease_state" in episodes.columns else F.lit(None).cast("string")
    kind = F.col("type") if "type" in events.columns else F.lit("imaging")
    bounds = events.where("date <> ''").groupBy("patient_id").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    anchors = events.select("patient_id", F.col("event_id").alias("anchor_event_id"), kind.alias("_kind")).groupBy("patient_id", "anchor_event_id").agg(F.max(F.col("_kind") == "imaging").alias("_image"))
    e = episodes.withColumn("_state", state).join(bounds, "patient_id", "left").join(anchors, ["patient_id", "anchor_event_id"], "left")
    e = e.withColumns({"episode": F.row_number().over(along), "_n": F.count("*").over(W.partitionBy("patient_id")), "_twice": F.count("line_number").over(W.partitionBy("patient_id", "line_number")), "_last": F.max("start_date").over(along.rowsBetween(W.unboundedPreceding, -1))})
    base, named = F.col("kind") == "baseline", F.coalesce(F.col("anchor_event_id"), F.lit("")) != ""
    early = F.datediff(F.try_to_date("_lo", "yyyy-MM-dd"), F.try_to_date("start_date", "yyyy-MM-dd"))
    line = F.col("kind").isin("systemic_tx_line", "treatment_line")
    found = F.array_compact(F.array(
        F.when(~F.col("kind").isin(KINDS), "unknown kind"),
        F.when(F.try_to_date("start_date", "yyyy-MM-dd").isNull(), "bad start"),
        F.when(F.col("end_date") < F.col("start_date"), "ends before it starts"),
        F.when(~named, "no anchor"),
        F.when(named & F.col("_image").isNull() & ~(base & F.lower("anchor_event_id").contains("baseline")), "unknown anchor"),
        F.when((early > 0) & ~(base & (early <= 1)), "starts before all events"),
        F.when(F.col("end_date") > F.col("_hi"), "ends after all events"),
        F.when(F.col("start_date") < F.col("_last"), "out of order"),
        F.when(line & (F.coalesce("line_number", F.lit(0)) < 1), "no line number"),
        F.when(F.col("line_number").isNotNull() & (F.col("_twice") > 1), "line used twice"),
        F.when((F.col("kind") == "imaging_based_state") & named & ~F.coalesce("_image", F.lit(False)), "anchor is no imaging"),
        F.when((F.col("kind") == "imaging_based_state") & ~F.col("_state").isin(STATES), "unknown state"),
        F.when(F.col("_n") > most, "too many episodes"),
    ))
    own = e.select("patient_id", "episode", F.explode(found).alias("problem"))
    ids = e.select("patient_id", "episode", F.explode("event_ids").alias("event_id"))
    missing = ids.join(events.select("patient_id", "event_id"), ["patient_id", "event_id"], "left_anti").select("patient_id", "episode", F.lit("unknown event").alias("problem"))
    return own.unionByName(missing.distinct())


def merged_workups(episodes: DataFrame) -> DataFrame:
    """Runs of initial_diagnostics of one patient become one episode."""
    along = W.partitionBy("patient_id").orderBy("start_date", "kind")
    same = (F.col("kind") == "initial_diagnostics") & (F.lag("kind").over(along) == "initial_diagnostics")
    run = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(along.rowsBetween(W.unboundedPreceding, 0))
    return episodes.withColumn("_run", run).groupBy("patient_id", "_run").agg(
        F.min("kind").alias("kind"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.min_by("anchor_event_id", "start_date").alias("anchor_event_id"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_date", "event_ids"))), lambda x: x["event_ids"]))).alias("event_ids"),
    ).drop("_run")
