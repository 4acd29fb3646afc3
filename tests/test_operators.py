"""Temporal, graph, timeline, episode and similarity operators against small models in plain Python."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import clinical, ids, text
from chronoweave.operators import episodes, graph, rollup, similarity, temporal, timeline


def dates(spark, seed, n=60, people=4):
    rng = random.Random(seed)
    rows = [(f"p{rng.randrange(people)}", i, date(2020, 1, 1) + timedelta(days=rng.randrange(90))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "p string, i int, d date")


@pytest.mark.parametrize("days", [0, 3, 7])
def test_band_joins(spark, days):
    a, left = dates(spark, 1)
    b, right = dates(spark, 2)
    right = right.select("p", F.col("i").alias("j"), F.col("d").alias("e"))
    near = lambda x, y: x[0] == y[0] and abs((x[2] - y[2]).days) <= days
    pairs = sorted((r["i"], r["j"]) for r in temporal.band_join(left, right, ["p"], "d", "e", days).collect())
    assert pairs == sorted((x[1], y[1]) for x in a for y in b if near(x, y))
    semi = sorted(r["i"] for r in temporal.band_join(left, right, ["p"], "d", "e", days, "left_semi").collect())
    anti = sorted(r["i"] for r in temporal.band_join(left, right, ["p"], "d", "e", days, "left_anti").collect())
    assert semi == sorted(x[1] for x in a if any(near(x, y) for y in b)) and sorted(semi + anti) == sorted(x[1] for x in a)


def test_nearest_prefers_the_earlier_date(spark):
    left = spark.createDataFrame([("p", 1, date(2020, 1, 10))], "p string, i int, d date")
    right = spark.createDataFrame([("p", 1, date(2020, 1, 13)), ("p", 2, date(2020, 1, 7)), ("p", 3, date(2020, 3, 1))], "p string, j int, e date")
    assert temporal.nearest(left, right, ["p"], ["i"], "d", "e", 14, ["j"]).first()["j"] == 2


def test_gap_clusters_chain_to_the_row_before(spark):
    rows = [("p", date(2020, 1, 1) + timedelta(days=d)) for d in (0, 6, 12, 20, 27, 35)] + [("p", None)]
    got = temporal.gap_clusters(spark.createDataFrame(rows, "p string, d date"), ["p"], [F.col("d").asc_nulls_first()], F.datediff("d", "_before.d"), 7).where("d is not null").orderBy("d").collect()
    assert [r["cluster"] for r in got] == [2, 2, 2, 3, 3, 4]


def test_greedy_chunks(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randint(1, 60)) for g in "ab" for i in range(50)] + [("c", 0, 500), ("c", 1, 1)]
    want = []
    for g in "abc":
        chunk = held = 0
        for _, i, s in [r for r in rows if r[0] == g]:
            if held and held + s > 100:
                chunk, held = chunk + 1, 0
            held += s
            want.append((g, i, chunk))
    got = temporal.greedy_chunks(spark.createDataFrame(rows, "g string, i int, s int"), ["g"], ["i"], "s", 100).select("g", "i", "chunk_no").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_shortest_paths_and_components(spark):
    rng = random.Random(7)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)}
    edges = spark.createDataFrame(list(pairs), "src int, dst int")
    hops, front = {0: 0}, {0}
    while front:
        front = {b for a, b in pairs if a in front and b not in hops}
        hops |= {b: max(hops.values()) + 1 for b in front}
    assert {r["node"]: r["hops"] for r in graph.bfs(edges, spark.createDataFrame([(0,)], "node int")).collect()} == hops
    far = max(hops, key=lambda n: (hops[n], n))
    path = graph.shortest_path(edges, 0, far)
    assert len(path) == hops[far] + 1 and set(zip(path, path[1:])) <= pairs
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    assert graph.bfs(chain, spark.createDataFrame([(0,)], "node int")).agg(F.max("hops")).first()[0] == 40
    assert graph.shortest_path(chain, 5, 0) == []
    parent = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in range(60):
        for a, b in pairs:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = dict(graph.components(spark.createDataFrame(list(pairs), "a long, b long")).collect())
    assert got == parent


def test_merged_events(spark):
    rows = [(1, 1, "short", None, "chest", "2020-01-02", "MINOR", ["a", "b"]), (1, 2, "much longer", "ct", None, "2020-01-01", "MAJOR", ["b", "c"])]
    got = graph.merged(spark.createDataFrame(rows, "c int, seq int, description string, modality string, site string, date string, priority string, refs array<string>"), "c", "seq").first()
    assert (got["description"], got["modality"], got["site"], got["date"], got["priority"], got["refs"], got["n_merged"]) == ("much longer", "ct", "chest", "2020-01-01", "MAJOR", ["a", "b", "c"], 2)


def test_blake2b_and_ids(spark):
    import hashlib

    got = spark.createDataFrame([("x",), (None,)], "t string").select(ids.blake2b_96(F.col("t")).alias("h"), ids.hashed_id(F.col("t"), F.lit("b")).alias("m")).collect()
    assert got[0]["h"] == hashlib.blake2b(b"x", digest_size=12).hexdigest() and got[1]["h"] is None
    assert got[1]["m"] == hashlib.md5(b"_b").hexdigest()[:24]


TIMELINE = "patient_id string, seq int, event_id string, date string, type string, modality string, site string, description string, priority string, values map<string,string>, source_event_refs array<string>"


def test_roll_up_by_day(spark):
    rows = [
        ("p", 1, "e1", "2021-01-01", "imaging", "ct", "chest", "mass", "MINOR", None, ["r1"]),
        ("p", 2, "e2", "2021-01-01", "imaging", "ct", "chest", "a larger mass", "MINOR", None, ["r2", "r1"]),
        ("p", 3, "e3", "2021-01-01", "imaging", "mri", "head", "clear", "MAJOR", None, None),
        ("p", 4, "e4", "2021-01-01", "lab", None, None, "first", "MINOR", {"CEA": "5 ↑", "LDH": "200"}, None),
        ("p", 5, "e5", "2021-01-01", "lab", None, None, "second", "MINOR", {"CEA": "7 ↑"}, None),
        ("p", 6, "e6", "2021-01-01", "baseline_information", None, None, "left out", "MAJOR", None, None),
    ]
    got = {r["event_id"]: r for r in timeline.in_order(timeline.rolled_up(spark.createDataFrame(rows, TIMELINE))).collect()}
    assert set(got) == {"e2", "e3", "e5"}
    assert got["e2"]["description"] == "a larger mass, mass" and got["e2"]["source_event_refs"] == ["r1", "r2"]
    assert got["e5"]["values"] == {"CEA": "7 ↑"} and got["e5"]["place"] == 3
    assert timeline.rolled_up(spark.createDataFrame(rows, TIMELINE), keep_other=True).count() == 4
    assert len({r["event_id"] for r in timeline.with_event_id(spark.createDataFrame(rows, TIMELINE)).collect()}) == 6


def test_imaging_is_normalised_and_provenance_modes(spark):
    rows = [("p", 1, "e1", "2021-01-01", "imaging", "Computed Tomography", "thorax", "Mass  with contrast seen", "MINOR", None, ["r1"])]
    got = timeline.normalized_imaging(spark.createDataFrame(rows, TIMELINE)).first()
    assert (got["modality"], got["site"], got["description"]) == ("ct", "chest", "Mass seen")
    sources = spark.createDataFrame([("p", "n1", "2021-01-01", "x", "t")], "patient_id string, node_id string, date string, note_id string, timestamp string")
    events = spark.createDataFrame(rows, TIMELINE)
    assert timeline.provenance(events, sources, "date").first()["dst"] == "n1"
    assert timeline.provenance(events, sources, "source_refs").first()["dst"] == "r1"
    with pytest.raises(ValueError, match="unknown"):
        timeline.provenance(events, sources, "guess")


def test_a_failing_model_becomes_a_row(spark):
    def model(system, user):
        if "bad" in user:
            raise RuntimeError("no")
        return timeline.stub_model(system, user)

    got = {r["t"]: r["a"] for r in timeline.ask(spark.createDataFrame([("2021-01-01 seen",), ("bad",)], "t string"), "t", "a", "s", model).collect()}
    assert '"2021-01-01"' in got["2021-01-01 seen"] and got["bad"] == '{"error": "no"}'


def test_episodes_by_rules(spark):
    rows = [
        ("p", 1, "a", "2021-01-01", "diagnostic", None, None, "malignant, PD-L1 positive biopsy", "MINOR", None, None),
        ("p", 2, "b", "2021-01-10", "treatment", None, None, "cisplatin cycle", "MINOR", None, None),
        ("p", 3, "c", "2021-02-10", "treatment", None, None, "cisplatin cycle", "MINOR", None, None),
        ("p", 4, "d", "2021-03-01", "imaging", "ct", "chest", "clear progression", "MAJOR", None, None),
        ("p", 5, "e", "2021-03-10", "treatment", None, None, "nivolumab", "MINOR", None, None),
        ("p", 6, "f", "2021-04-01", "adverse_effect", None, None, "grade 3 rash", "MINOR", None, None),
        ("p", 7, "g", "2021-05-01", "surgery", None, None, "lobectomy", "MAJOR", None, None),
    ]
    events = spark.createDataFrame(rows, TIMELINE)
    got = sorted((r["start_date"], r["kind"], r["end_date"], r["line_number"]) for r in episodes.derive(events).collect())
    assert got == [("2021-01-01", "diagnosis", "2021-01-01", None), ("2021-01-10", "systemic_tx_line", "2021-03-01", 1), ("2021-03-01", "progression", "2021-03-01", None), ("2021-03-10", "systemic_tx_line", None, 2), ("2021-04-01", "major_ae", "2021-04-01", None), ("2021-05-01", "surgery_course", "2021-05-01", None)]
    bare = [r["kind"] for r in episodes.derive(events, whole_words=False).collect()]
    assert bare.count("progression") == 2
    found = episodes.with_ids(episodes.derive(events))
    assert found.where("episode_id is null").count() == 0 and found.select("episode_id").distinct().count() == 6
    assert episodes.problems(found, events).count() == 0


def test_episode_population_bounds_and_problems(spark):
    events = spark.createDataFrame([("p", f"e{i}", f"2021-01-{i:02d}", i) for i in range(1, 8)], "patient_id string, event_id string, date string, seq int")
    rows = [("p", "surveillance", "2021-01-02", "2021-01-04", "e2", [], None), ("p", "progression", "2021-01-06", None, "e6", None, None), ("p", "odd", "soon", "2020-01-01", "", ["e1", "zz"], None)]
    e = spark.createDataFrame(rows, "patient_id string, kind string, start_date string, end_date string, anchor_event_id string, event_ids array<string>, line_number int")
    got = {r["kind"]: r["event_ids"] for r in episodes.populated(e, events).collect()}
    assert got == {"surveillance": ["e2", "e3", "e4"], "progression": ["e6", "e7"], "odd": ["e1", "zz"]}
    bounds = {r["kind"]: (r["start_date"], r["end_date"]) for r in episodes.corrected_dates(episodes.populated(e, events), events).collect()}
    assert bounds["progression"] == ("2021-01-06", "2021-01-07")
    wrong = {r["problem"] for r in episodes.problems(e.where("kind = 'odd'"), events).collect()}
    assert wrong == {"unknown kind", "bad start", "ends before it starts", "no anchor", "unknown event"}
    two = spark.createDataFrame([("p", "initial_diagnostics", "2021-01-01", "2021-01-02", "a", ["a"], None), ("p", "initial_diagnostics", "2021-01-03", "2021-01-05", "b", ["b"], None), ("p", "surgery", "2021-02-01", "2021-02-01", "c", ["c"], None)], e.schema)
    assert sorted((r["kind"], r["end_date"], r["event_ids"]) for r in episodes.merged_workups(two).collect()) == [("initial_diagnostics", "2021-01-05", ["a", "b"]), ("surgery", "2021-02-01", ["c"])]


def test_laboratory_and_category_rules(spark):
    one = lambda c, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "t string").select(c(F.col("t")).alias("x")).collect()]
    assert [(r["value"], r["direction"]) for r in one(clinical.lab_value, "5.4 ↑", "↓3", "7", "neg", "nan")] == [(5.4, "high"), (3.0, "low"), (7.0, "normal"), (None, "normal"), (None, "normal")]
    assert one(clinical.modality, "PET/CT whole body", "CT chest", "resection", "MRI brain", "X-ray") == ["PET-CT", "CT", None, "MRI", "XR"]
    cancers = {"NSCLC stage IV": "NSCLC", "Non-small cell": "NSCLC", "SCLC": "SCLC", "small cell carcinoma": "SCLC", "squamous cell of lung": "NSCLC", "pulmonary mass": "NSCLC", "thymic carcinoma": "Thymoma/Thymic", "breast": "Other Primary", "mesothelioma, small cell": "Mesothelioma", "melanoma": "Other", "": "Unknown", None: "Unknown"}
    assert one(clinical.diagnosis_class, *cancers) == list(cancers.values())
    cells = {"Adeno": "Adenocarcinoma", "squamous": "Squamous Cell", "LARGE CELL": "Large Cell", "small cell": "Small Cell", "sarcomatoid": "Sarcomatoid", "carcinoid": "Carcinoid", "mesothelioma": "Mesothelioma", "odd": "Other/NOS", "": "Unknown/NOS", None: "Unknown/NOS"}
    assert one(clinical.histology_class, *cells) == list(cells.values())
    smokers = {"never, 10 pack-years": ("Never", None), "30 pack years": ("Former", 30.0), "quit 2001": ("Former", None), "current, 12.5 ppy": ("Current", 12.5), "Non-smoker": ("Never", None), "not documented": ("Unknown", None), "": ("Unknown", None), None: ("Unknown", None)}
    assert [(r["category"], r["pack_years"]) for r in one(clinical.smoking, *smokers)] == list(smokers.values())
    shares = {"<1%": "negative", "TPS 60%": "high", "5 %": "low", "0%": "negative", "not detected": "negative", "positive": "low", "high": "unknown", "not tested": "unknown", "?": "unknown", None: "unknown"}
    assert one(clinical.pdl1, *shares) == list(shares.values())
    results = {"exon 19 deletion": "positive", "not tested": "not_tested", "Not detected": "negative", "Wild-type": "negative", "pending": "negative", "": "not_tested", None: "not_tested"}
    assert one(clinical.mutation_status, *results) == list(results.values())
    grades = {"1-2": "1-2", "2": "2", "ECOG 1": "1", "not recorded": "Unknown", "n/a": "Unknown", "": "Unknown", None: "Unknown"}
    assert one(clinical.ecog, *grades) == list(grades.values())
    images = {"progressed": "progression", "partial response": "response", "unchanged": "surveillance", "initial scan": "baseline", "CT": "unknown", None: "unknown"}
    assert one(clinical.imaging_class, *images) == list(images.values())
    assert one(clinical.regimen, "Carboplatin + pemetrexed", "concurrent radiation", "rest", None) == [["pemetrexed", "platinum_doublet"], ["chemoradiation"], [], []]
    assert one(clinical.yes_no, "yes, bone", "No", None) == ["Yes", "No", "Unknown"]
    drugs = {"chemotherapy": ["cisplatin"], "radiation": ["radi"], "immunotherapy": ["nivolumab"]}
    assert one(lambda c: clinical.regimen(c, drugs), "Cisplatin + radiation", "nivolumab", "rest") == [["chemotherapy", "radiation"], ["immunotherapy"], []]
    assert one(clinical.anatomic_sites, "Chest and abdomen", "toe") == ["chest/abdomen", "unspecified"]
    assert one(text.us_date, "on 3/4/2021 and", "none") == ["2021-03-04", None]
    assert one(lambda c: text.sentence_with(c, "two"), "One. It has Two. Three", "none here") == ["It has Two", "none here"]


def test_bm25_of_a_small_corpus(spark):
    from math import log

    docs = {1: "a b c a".split(), 2: "b b d".split(), 3: "c d e f".split(), 4: "a f".split(), 5: [], 6: "g".split()}
    asked = "a a d".split()
    df = lambda w: sum(w in d for d in docs.values())
    idf = {w: log((6 - df(w) + 0.5) / (df(w) + 0.5)) for w in "abcdefg"}
    mean = sum(idf.values()) / 7
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    avg = sum(map(len, docs.values())) / 6
    want = {k: sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in asked) for k, d in docs.items() if set(asked) & set(d)}
    corpus = spark.createDataFrame(list(docs.items()), "d int, x array<string>")
    got = {r["d"]: r["score"] for r in similarity.bm25(corpus, spark.createDataFrame([(1, asked)], "q int, x array<string>"), doc="d", query="q", tokens="x").collect()}
    assert got == pytest.approx(want)


def test_weights_seats_and_gate(spark):
    with pytest.raises(KeyError):
        similarity.weighted({"age": F.lit(1)}, {"line": 1.0})
    row = spark.range(1).select(similarity.weighted({"a": F.lit(1.0), "b": F.lit(1.0)}, {"a": 1.0, "b": -0.25}).alias("s")).first()
    assert row["s"] == pytest.approx(0.75)
    assert similarity.allocate({"a": 900, "b": 90, "c": 1}, 50) == {"a": 45, "b": 4, "c": 1} and similarity.allocate({}, 5) == {}
    assert similarity.stratified(spark.range(100).selectExpr("id", "cast(id % 3 as string) as s"), "s", "id", 9).count() == 9
    people = spark.createDataFrame([(1, "x", "Yes"), (2, "x", "Unknown"), (3, "x", "No"), (4, "y", "Yes")], "i int, d string, m string")
    got = sorted((r["a_i"], r["b_i"]) for r in similarity.gate(people, "i", "d", "m").collect())
    assert got == [(1, 2), (2, 1), (2, 3), (3, 2)]


def test_beta_regression_finds_the_weights():
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    mu = 1 / (1 + np.exp(-(x @ np.array([2.0, 0.0, -1.0]) - 0.5)))
    y = np.clip(rng.beta(mu * 40, (1 - mu) * 40), 0.01, 0.99)
    t, sd = similarity.beta_regression(x, y, np.zeros(3), np.full(3, 3.0))
    assert t[:3] == pytest.approx([2.0, 0.0, -1.0], abs=0.35) and (sd > 0).all()


def test_index_percentiles_and_drift(spark):
    values = [(v,) for v in range(1, 11)]
    got = rollup.index_percentile(spark.createDataFrame(values, "v int").withColumn("g", F.lit(1)), ["g"], "v", {"m": 0.5, "p": 0.9}).first()
    assert (got["n"], got["m"], got["p"]) == (10, 6, 10)
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("aab", "bc"))
    assert {r["k"]: r["delta"] for r in rollup.drift(a, b, "k").collect()} == pytest.approx({"a": -66.666667, "b": 16.666667, "c": 50.0})


def test_components_of_all_lines_are_those_of_union_find(spark, tmp_path):
    """Lines of any quantity and discount link their orders; an order without a shared part stands alone."""
    import random

    from chronoweave.plans import catalogue

    rng = random.Random(6)
    lines = [(rng.randrange(1, 120), rng.randrange(1, 160), float(rng.randrange(1, 51)), rng.randrange(11) / 100) for _ in range(170)] + [(500, 900, 1.0, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parent = {o: o for o, *_ in lines}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    seen = {}
    for o, p, *_ in lines:
        a, b = find(o), find(seen.setdefault(p, o))
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, catalogue.QUERIES["connected_components_all"](spark, str(tmp_path)).collect()))
    assert got == {o: find(o) for o in parent} and len(set(got.values())) > 2


def test_components_mark_many_links_without_overflow(spark, monkeypatch):
    """Hashes of 40 bits summed overflow from some 16 million links on: here a few links stand for them."""
    hashed = F.xxhash64
    monkeypatch.setattr(graph.F, "xxhash64", lambda *c: hashed(*c).bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1)))
    monkeypatch.setattr(graph.F, "pmod", lambda x, _: x)
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert dict(map(tuple, graph.components(links).collect())) == dict.fromkeys(range(10), 0)


def test_merged_components_follow_the_sqls_order_above_a_million_parts(spark, tmp_path):
    import duckdb

    from chronoweave.plans import catalogue

    duckdb.sql("CREATE TABLE lineitem AS SELECT * FROM (VALUES (1, 1, 1150000, 'A', TIMESTAMP '1995-01-01', 5.0), (1, 2, 3, 'R', TIMESTAMP '1995-01-02', 5.0), (2, 1, 7, 'R', TIMESTAMP '1995-01-02', 5.0)) AS t(l_orderkey, l_linenumber, l_partkey, l_returnflag, l_shipdate, l_quantity)")
    duckdb.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    want = duckdb.sql(catalogue.ORACLE_SQL["merged_components"])
    got = catalogue.QUERIES["merged_components"](spark, str(tmp_path)).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and want.fetchall()[0][2]


def people(spark, seed, n=240):
    rng = random.Random(seed)
    rows = [(i // 2 if i < 8 else i, rng.choice(["x", "x", "y", None]), rng.choice(["Yes", "No", "Unknown", None]), rng.choice([None, *[x / 4 for x in range(-40, 40)]]), rng.choice("pqr")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i int, d string, m string, v double, s string")


def test_gate_counts_are_those_of_the_pairs(spark):
    rows, df = people(spark, 3)
    want = {r["a_i"]: r["count"] for r in similarity.gate(df, "i", "d", "m").groupBy("a_i").count().collect()}
    assert {r["i"]: r["n"] for r in similarity.gate_counts(df, "i", "d", "m").collect()} == want and len(want) > 100


@pytest.mark.parametrize("seed,step", [(4, 0.5), (5, 0.1), (6, 0.01)])
def test_best_of_the_gate_are_those_of_all_pairs(spark, seed, step):
    rows, df = people(spark, seed)

    def level(distance, value, alike):
        return similarity.half_up(np.maximum(0.0, 1 - distance * step), 1) + 0.2 * alike

    best = similarity.gated_best(df, "i", "d", "m", "v", "s", 3, level)
    pairs = similarity.gate(df, "i", "d", "m")
    near = F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("a_v") - F.col("b_v")) * step), 1) + 0.2 * (F.col("a_s") == F.col("b_s")).cast("int")
    top = lambda p: sorted(map(tuple, temporal.top_per_group(p.select("a_i", "b_i", near.alias("n")), ["a_i"], [F.col("n").desc(), "b_i"], 3).select("a_i", "b_i").collect()))
    assert top(best) == top(pairs) and best.count() < pairs.count() / 4


def test_least_numbers_of_runs():
    rng = np.random.default_rng(2)
    values = rng.permutation(500)
    low = rng.integers(0, 500, 300)
    high = np.minimum(500, low + rng.integers(0, 500, 300) // rng.choice([1, 30], 300))
    got = similarity._Least(values, 6, 500).of(low, high)
    assert all([x for x in g if x < 500] == sorted(values[a:b])[:6] for g, a, b in zip(got.tolist(), low, high, strict=True))


def test_candidates_pass_the_gate_and_twins_come_first(spark):
    from chronoweave.operators import cases

    texts = {"a": ("NSCLC", "Yes", "exon 19 deletion", "lobectomy then osimertinib"), "b": ("NSCLC", "Yes", "exon 20", "lobectomy then osimertinib"), "c": ("NSCLC", "suspected", "wild type", "hospice care"), "d": ("SCLC", "Yes", "exon 19 deletion", "lobectomy then osimertinib"), "e": ("NSCLC", "No", "exon 19 deletion", "lobectomy")}
    rows = [(p, "1950-01-01", None, "never", "1", d, "adenocarcinoma", m, "No", {"EGFR": g}, ["drug"], None, "No", note) for p, (d, m, g, note) in texts.items()]
    lines = [(p, "treatment_line", 1, "osimertinib" if p != "c" else "nivolumab", "palliative", "none", "2020-01-01") for p in texts]
    episodes_ = spark.createDataFrame(lines, "patient_id string, kind string, line_number int, treatment string, intent string, termination_reason string, start_date string")
    index = spark.createDataFrame([(p, "2021-01-01", "2019-01-01", "2021-01-01", 3, 4) for p in texts], "patient_id string, tb_date string, start string, end string, event_count int, node_count int")
    records = cases.records(spark.createDataFrame(rows, cases.SNAPSHOT), episodes_, index)
    found = cases.candidates(records, spark.createDataFrame([("a",)], "patient_id string"), 3).orderBy("rank").collect()
    assert [r["candidate"] for r in found] == ["b", "c"] and found[0]["nets"] == "biology,narrative,trajectory" and found[0]["mean_score"] > found[1]["mean_score"]
    assert cases.posterior_weights('{"posterior_weights": {' + ", ".join(f'"{k}": 1' for k in similarity.PRIOR_WEIGHTS) + "}}") == dict.fromkeys(similarity.PRIOR_WEIGHTS, 1.0)
    with pytest.raises(ValueError, match="smoking_match"):
        cases.posterior_weights('{"posterior_weights": {' + ", ".join(f'"{k}": 1' for k in list(similarity.PRIOR_WEIGHTS)[:-1]) + "}}")


def test_a_models_episodes_are_checked_and_rules_step_in(spark):
    import json

    rows = [("p", 1, "a", "2021-01-01", "surgery", None, None, "lobectomy", "MAJOR", None, None), ("q", 1, "b", "2021-02-01", "surgery", None, None, "wedge", "MAJOR", None, None)]
    events = spark.createDataFrame(rows, TIMELINE)

    def model(system, user):
        good = {"kind": "surgery_course", "start_date": "2021-01-01", "end_date": "2021-01-01", "anchor_event_id": "a"}
        return "```json\n" + json.dumps({"episodes": [good if '"a"' in user else good | {"kind": "odd"}]}) + "\n```"

    got = {r["patient_id"]: r for r in episodes.by_model(events, model).collect()}
    assert got["p"]["kind"] == "surgery_course" and got["p"]["event_ids"] == ["a"] and got["q"]["anchor_event_id"] == "b" and got["q"]["episode_id"]
    info = episodes.patient_info(spark.createDataFrame([("p", "NSCLC", ["x"])], "patient_id string, diagnosis string, current_treatment array<string>")).first()
    assert info["TUMOR INFORMATION"]["diagnosis"] == "NSCLC" and info["TREATMENTS"]["current"] == ["x"] and info["PATIENT DEMOGRAPHICS"]["dnr"] == "No"


def test_pairs_of_cases_are_dealt_out_and_read_codes(spark):
    """Diagnoses do not gather in a few tasks; a pair costs no maps and no decimals."""
    from chronoweave.plans import catalogue

    for name in ("case_features", "calibration_vector", "case_scores"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "map_entries" not in plan and "array_intersect" not in plan and "Repartition" in plan and "broadcast" in plan, name


def test_fast_rounding_is_sparks(spark):
    rng = random.Random(7)
    values = [0.5e-6, 1.5e-6, 2.5e-6, 0.1234565, 0.1234575, 0.0, 1.0, None, *[rng.randrange(10**7) / 1e7 for _ in range(300)], *[rng.random() for _ in range(300)]]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(similarity.rounded("x", 6).alias("a"), F.round("x", 6).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)
    assert similarity.half_up(np.array(values[:7]), 6).tolist() == [r["b"] for r in rows[:7]]


def test_candidates_are_those_of_all_pairs(spark):
    from chronoweave.operators import cases
    from chronoweave.plans import clinical_queries as q

    r = q._cases(lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")).cache()
    wanted = r.where("cast(patient_id as int) % 10 = 0").select("patient_id")
    coded = cases.coded(r)
    pairs = cases.scored(cases.gated(coded.join(wanted, "patient_id", "left_semi"), coded, F.col("a_patient_id") != F.col("b_patient_id"))).cache()
    notes = similarity.bm25(r, r.join(wanted, "patient_id", "left_semi").withColumnRenamed("patient_id", "asked"), doc="patient_id", query="asked", tokens="tb_note_tokens")
    told = pairs.join(notes, [F.col("a_patient_id") == F.col("asked"), F.col("b_patient_id") == F.col("patient_id")])
    plain = lambda p, score: p.select(F.col("a_patient_id").alias("patient_id"), F.col("b_patient_id").alias("candidate"), F.col(score).alias("score"))
    want = similarity.merge_nets({"biology": plain(pairs, "biology"), "trajectory": plain(pairs, "trajectory"), "narrative": plain(told, "score")}, "patient_id", "candidate", "score", 4)
    shown = lambda d: sorted(map(tuple, d.select("patient_id", "candidate", "nets", F.round("mean_score", 6), "rank").collect()))
    assert shown(cases.candidates(r, wanted, 4)) == shown(want)
