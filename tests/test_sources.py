"""XML streams, cutoffs, source graphs, files and answers of models, on self-made data."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoweave.sources import artifacts, eventstream

DATA = Path(__file__).parent / "data" / "streams"


@pytest.fixture(scope="module")
def events(spark):
    return eventstream.events(eventstream.read_streams(spark, str(DATA))).cache()


def test_events_in_document_order(events):
    got = events.where("patient_id = 'p1'").orderBy("seq").select("type", "date", "time", "node_id").collect()
    assert [r["type"] for r in got] == ["visit", "note", "condition", "condition", "procedure", "image", "measurement", "measurement", "drug_exposure", "note"]
    assert [r["node_id"] for r in got[:2]] == ["visit_v1", "note_n1"] and got[5]["node_id"] == "img_i1" and got[4]["node_id"] == "proc_q1"
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()[:24]
    assert got[2]["node_id"] == got[3]["node_id"] == md5("2021-01-05 08:00_condition_C34")
    assert got[6]["node_id"] == md5("2021-01-05 09:30_measurement_CEA") and (got[6]["date"], got[6]["time"]) == ("2021-01-05", "09:30")


def test_text_keeps_lines_and_entities(events):
    value = events.where("note_id = 'n1'").first()["value"]
    assert "right lobe,\nno effusion" in value and "Size < 3 cm" in value


def test_parsing_texts_gives_the_same(spark, events):
    texts = spark.createDataFrame([((DATA / f).read_text(),) for f in ("p1.xml", "p2.xml")], "x string")
    again = eventstream.events(eventstream.parse_streams(texts, "x"))
    assert sorted(map(str, again.collect())) == sorted(map(str, events.collect()))


def test_people_and_care_sites(spark):
    streams = eventstream.read_streams(spark, str(DATA))
    p = {r["patient_id"]: r for r in eventstream.people(streams).collect()}
    assert p["p1"]["gender"] == "Female" and p["p1"]["age_years"] == 71 and p["p2"]["birthdate"] is None
    assert eventstream.care_sites(streams).collect()[0]["care_site_name"] == "THORACIC ONCOLOGY"


def test_cutoff_is_one_of_place(spark, events):
    cut = spark.createDataFrame([("p1", "2021-03-01"), ("p2", "2030-01-01")], "patient_id string, c string").select("patient_id", F.to_date("c").alias("cutoff"))
    kept = eventstream.before_cutoff(events, cut).collect()
    assert {r["type"] for r in kept if r["date"] > "2021-01-31" and r["patient_id"] == "p1"} == set()
    assert sum(r["patient_id"] == "p2" for r in kept) == 3


def test_graph_nodes_and_edges(events):
    nodes = {r["node_id"]: r for r in eventstream.nodes(events).collect()}
    assert nodes["visit_node_v1"]["attrs"]["event_count"] == "3"
    same = [n for n in nodes.values() if n["attrs"].get("code") == "C34"]
    assert len(same) == 1 and same[0]["attrs"]["name"] == "lung mass again" and same[0]["seq"]["event"] == 2
    edges = {(r["src"], r["dst"], r["edge_type"]) for r in eventstream.edges(events).collect()}
    assert ("img_i1", "proc_q1", "PROCEDURE_FOR") in edges and ("note_n1", "img_i1", "IMAGE_REPORT_FOR") in edges
    assert ("note_n9", "img_i9", "IMAGE_REPORT_FOR") in edges and not any(a == "note_n2" and k == "IMAGE_REPORT_FOR" for a, _, k in edges)
    assert sum(k == "PRECEDES" for *_, k in edges) == 8 + 2


def test_bare_substrings_only_on_request(spark):
    names = spark.createDataFrame([("resection",), ("CT chest",), ("doctor",)], "n string")
    got = names.select(eventstream.radiology(F.col("n")).alias("s"), eventstream.radiology(F.col("n"), strict=False).alias("l")).collect()
    assert [r["s"] for r in got] == [False, True, False] and [r["l"] for r in got] == [True, True, True]


def test_graph_tables_round_trip(spark, events, tmp_path):
    nodes, edges = eventstream.nodes(events), eventstream.edges(events)
    eventstream.write_graph(nodes, edges, str(tmp_path), buckets=4)
    n, e = eventstream.read_patient(spark, str(tmp_path), "p1", buckets=4)
    assert sorted(map(str, n.collect())) == sorted(map(str, nodes.where("patient_id = 'p1'").collect()))
    assert e.count() == edges.where("patient_id = 'p1'").count()


def test_eligibility_dates_and_resume(spark, tmp_path):
    (tmp_path / "e.csv").write_text("patient_id,first_tb_encounter_date\na,2021-02-03\nb,3/4/2021\nc,2019/01/02\nd,5-6-2022\ne,soon\n")
    done = spark.createDataFrame([("d",)], "patient_id string")
    got = {r["patient_id"]: str(r["cutoff"]) for r in eventstream.eligible(spark, str(tmp_path / "e.csv"), 2020, done).collect()}
    assert got == {"a": "2021-02-03", "b": "2021-03-04"}


def test_exports(events):
    nodes, edges = eventstream.nodes(events), eventstream.edges(events)
    links = {r["patient_id"]: json.loads(r["json"]) for r in artifacts.node_link(nodes, edges).collect()}
    assert links["p1"]["directed"] and len(links["p1"]["links"]) == edges.where("patient_id = 'p1'").count()
    from xml.etree import ElementTree

    for r in artifacts.graphml(nodes, edges).collect():
        ElementTree.fromstring(r["graphml"])
    assert artifacts.table([{"a": 1, "b": "x"}]).splitlines()[2] == "| 1 | x |" and r"\hline" in artifacts.table([{"a": 1}], "latex")


def test_json_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"date":"2021-01-01","type":"lab","values":{"CEA":"5 ↑"},"event_id":"e1"}\nbroken\n')
    rows = artifacts.read_timeline(spark, str(tmp_path / "t.jsonl")).collect()
    assert rows[0]["values"] == {"CEA": "5 ↑"} and rows[1]["_corrupt_record"] == "broken"
    (tmp_path / "m1_manifest.json").write_text(json.dumps({"patients": [{"patient_id": "a"}, {"patient_id": "b"}]}))
    (tmp_path / "m2_manifest.json").write_text(json.dumps({"patients": [{"patient_id": "b"}]}))
    assert sorted(r[0] for r in artifacts.read_manifest_ids(spark, str(tmp_path / "*manifest.json")).collect()) == ["a", "b"]


@pytest.mark.parametrize(("text", "want"), [
    ('```json\n{"a": 1}\n```', {"a": 1}), ('so: {"a": "}"} and {"b": 2}', {"a": "}"}), ('{"a": [1, 2,],}', {"a": [1, 2]}),
    ("{'a': 'b'}", {"a": "b"}), ('[{"a": 1}, {"b": 2', [{"a": 1}, {"b": 2}]), ('{"a": "cut of', {"a": "cut of"}), ("nothing", None), (None, None), ("", None),
])
def test_answers_are_repaired(text, want):
    got = artifacts.repaired(text)
    assert (None if got is None else json.loads(got)) == want


def test_repair_of_a_column(spark):
    got = artifacts.repair_column(spark.createDataFrame([(1, '{"a": 1,}'), (2, None)], "i int, t string"), "t", "j").orderBy("i").collect()
    assert [r["j"] for r in got] == ['{"a": 1}', None]
