"""Retrieval over the fixture's events, cohort tables and the sampler."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import cohort, retrieval
from chronoweave.sources import eventstream

DATA = Path(__file__).parent / "data" / "streams"
EVENT = "patient_id string, seq int, node_id string, type string, timestamp string, date string, time string, code string, name string, value string, visit_id string, care_site_id string"


def event(i, kind, day, name="", value="", code="", visit="", site="", patient="p"):
    return (patient, i, f"n{i}", kind, f"{day} 10:00", day, "10:00", code, name, value, visit, site)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        event(1, "note", "2021-01-01", "ONC note", "No metastasis seen. EGFR positive, egfr again. Lymph nodes fine.", visit="v1", site="c1"),
        event(2, "note", "2021-03-01", "CT chest", "CT chest. Technique: axial. Findings: new metastatic focus. Impression: worse. Exam 2/27/2021. Code status: DNR.", visit="v2"),
        event(3, "condition", "2021-02-01", "COPD", code="J44"), event(4, "condition", "2020-02-01", "COPD old", code="J44"), event(5, "condition", "2020-02-01", "", code=""),
        event(6, "drug_exposure", "2021-02-01", "Cisplatin", code="D1"), event(7, "drug_exposure", "2021-04-01", "cisplatin", code="D1"),
        event(8, "image", "2021-03-01", "CT abdomen"), event(9, "image", "2021-03-07", "CT chest"), event(10, "image", "2021-03-20", "CT chest"), event(11, "image", "2021-03-20", "MRI brain"),
        event(12, "note", "2021-05-01", "op", "Prior lobectomy and tomography. KEGFRX no gene. Full code."),
    ]
    return spark.createDataFrame(rows, EVENT).cache()


def test_topics_count_events_and_take_the_latest(events):
    got = retrieval.topic(events, "metastasis").first()
    assert (got["n"], got["node_id"]) == (2, "n2") and "metastatic" in got["snippet"]
    genes = {r["gene"]: r["n"] for r in retrieval.driver_genes(events).collect()}
    assert genes == {"EGFR": 1}


def test_code_status_conditions_and_drugs(events):
    got = [(r["node_id"], r["keyword"]) for r in retrieval.code_status(events).orderBy("rank").collect()]
    assert got[0][0] == "n12" and {g[0] for g in got} == {"n2", "n12"}
    conditions = retrieval.distinct_conditions(events).collect()
    assert [(r["key"], r["name"], r["first_date"], r["n"]) for r in conditions] == [("J44", "COPD old", "2020-02-01", 2)]
    drug = retrieval.drug_exposures(events).first()
    assert (drug["name"], drug["first_date"], drug["last_date"], drug["n"], drug["ids"]) == ("Cisplatin", "2021-02-01", "2021-04-01", 2, "n6,n7")


def test_latest_documents(spark, events):
    sites = spark.createDataFrame([("p", "c1", "THORACIC ONCOLOGY")], "patient_id string, care_site_id string, care_site_name string")
    note = retrieval.latest_note_of_visits(events, sites, ["oncology", "tumor board"]).first()
    assert (note["node_id"], note["n"]) == ("n1", 1)
    assert retrieval.chest_ct_report(events).first()["node_id"] == "n2"


def test_imaging_dates_and_recent_studies(events):
    got = sorted((r["modality"], r["date"]) for r in retrieval.imaging_dates(events).collect())
    assert got == [("CT", "2021-02-27"), ("CT", "2021-03-20"), ("MRI", "2021-03-20")]
    recent = retrieval.recent_imaging(events, "2021-03-25", 10).collect()
    assert sorted(r["modality"] for r in recent) == ["CT", "MRI"]
    assert {r["operation"] for r in retrieval.surgical_history(events).collect()} == {"lobectomy"}
    assert retrieval.tnm(events).count() == 0
    assert [r["kind"] for r in retrieval.latest_by_kind(events, "metastasis").orderBy("kind").collect()] == ["note", "radiology"]


def test_context_guidance_and_chunks(events):
    row = retrieval.context(events).first()
    assert row["metastasis"]["n"] == 2 and row["allergy"] is None and row["conditions"][0]["name"] == "COPD old"
    told = retrieval.guidance(retrieval.context(events)).first()["guidance"]
    assert "metastasis: 2 mentions" in told and "conditions: 2020-02-01 COPD old" in told
    blocks = retrieval.serialized(events)
    assert blocks.count() == events.select("date").distinct().count()
    chunks = retrieval.chunked(blocks, 200).collect()
    assert len(chunks) > 2 and sum(c["text"].count("=== ") for c in chunks) == blocks.count()


def test_fixture_streams_run_through_retrieval(spark):
    events = eventstream.events(eventstream.read_streams(spark, str(DATA)))
    assert retrieval.drug_exposures(events).first()["name"] == "cisplatin"
    assert retrieval.serialized(events).where("date = '2021-01-05'").first()["block"].splitlines()[0] == "=== 2021-01-05 ==="


def test_cohort_tables_and_corrections(spark):
    df = spark.createDataFrame([("a", 60.0), ("a", 70.0), ("b", None), (None, 80.0)], "c string, x double")
    got = {(r["variable"], r["level"]): r for r in cohort.table_one(df, ["c"], ["x"]).collect()}
    assert got["c", "a"]["pct"] == 50.0 and got["c", "missing"]["n"] == 1 and got["x", ""]["median"] == 70
    results = spark.createDataFrame([("p", "v", "k", True, "Correct", 9), ("q", "v", "k", False, "Incorrect", 2)], "patient_id string, variable string, category string, primary boolean, correctness string, score int")
    whole = [r for r in cohort.scores(results).collect() if r["variable"] is None and r["category"] is None and r["primary"] is None][0]
    assert (whole["n"], whole["mean_score"], whole["pct_correct"], whole["patients"]) == (2, 5.5, 50.0, 2)
    snapshot = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], "patient_id string, variable string, value string")
    decisions = spark.createDataFrame([("p", "a", True, "high", "9"), ("p", "b", True, "low", "9"), ("p", "c", True, "high", " ")], "patient_id string, variable string, wrong boolean, confidence string, corrected string")
    assert {r["variable"]: r["value"] for r in cohort.corrections_applied(snapshot, decisions).collect()} == {"a": "9", "b": "2", "c": "3"}


def test_sampler_follows_the_conditional_shares(spark):
    rows = [("x", "positive", "negative")] * 60 + [("x", "negative", "positive")] * 20 + [("y", "negative", "negative")] * 20
    df = spark.createDataFrame(rows, "d string, g string, h string")
    cascade = [("d", []), ("g", ["d"]), ("h", ["d"])]
    tables = cohort.frequencies(df, cascade)
    got = cohort.sampled(spark, tables, cascade, 4000, seed=3, exclusive=("g", "h"))
    share = got.agg(F.avg((F.col("d") == "x").cast("int")).alias("d"), F.avg(((F.col("d") == "x") & (F.col("g") == "positive")).cast("int")).alias("g")).first()
    assert share["d"] == pytest.approx(0.8, abs=0.03) and share["g"] == pytest.approx(0.6, abs=0.03)
    assert got.where("g = 'positive' and h = 'positive'").count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, cohort.sampled(spark, tables, cascade, 4000, seed=3, exclusive=("g", "h")).repartition(3).collect()))


def test_whole_texts_and_whole_words(spark):
    rows = [event(1, "note", "2021-01-01", "n", "x" * 50_000), event(2, "note", "2021-01-02", "n", "METASTASIS, later MET amplified. driver mutation"), event(3, "note", "2021-01-03", "n", "T2 N1 M0, T4 before"), event(4, "measurement", "2021-01-03", "CEA", "5")]
    events = spark.createDataFrame(rows, EVENT)
    blocks = {r["date"]: r["block"] for r in retrieval.serialized(events).collect()}
    assert len(blocks["2021-01-01"]) > 50_000 and "--- Labs 2021-01-03 10:00 ---\n[E4] CEA: 5" in blocks["2021-01-03"]
    assert max(r["size"] for r in retrieval.serialized(events, max_chars=100).collect()) < 300
    genes = {r["gene"]: r["snippet"] for r in retrieval.driver_genes(events).collect()}
    assert set(genes) == {"MET", "_driver_mutation_keyword"}
    hit = retrieval.mentions(events, ["MET"], 5, word=True, case_sensitive=True).first()
    assert hit["at"] == 19 and hit["snippet"] == "...ater MET ampl..."
    assert {r["component"]: r["stated"] for r in retrieval.tnm(events).collect()} == {"T": "T2", "N": "N1", "M": "M0"}
    told, refs = retrieval.listing(events)
    assert "[E3] n3: T2 N1" in told.first()["listing"] and refs.count() == 4
