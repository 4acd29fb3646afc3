"""Quality rules, toxicity, quality classifier: statistics by brute force, held-out accuracy, defined edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import quality_classifier, quality_rules, toxicity
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    w = WORD.findall(text or "")
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if count[run] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_statistics_are_those_of_brute_force(documents, rows):
    judged = quality_rules.judge(documents, [])
    got = judged.select("doc_id", *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], quality_rules.base_failed(F.col("stats")).alias("b"), F.col("reason").isNull().alias("kept")).collect()
    assert sorted(tuple(r) for r in got) == sorted((r[0], *statistics(r[1]), not statistics(r[1])[-1]) for r in rows)


def labelled(n, seed):
    """(doc_id, text, quality, toxic): junk carries symbols or shouts; toxic texts a few words of their own."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = prose(rng, rng.randint(30, 120)).split()
        quality, toxic = int(rng.random() > 0.25), int(rng.random() < 0.3)
        if not quality:
            words = [w + "***&" for w in words] if rng.random() < 0.5 else [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zlomgrit", "kravvotz", "Plimxnar", "wubbezok,"])
        out.append((i, " ".join(words), quality, toxic))
    return out


@pytest.fixture(scope="module")
def marked(spark):
    rows = labelled(500, 6)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] % 4] + [(None, 1, 1), (9_999, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_rules_tell_junk_from_prose(marked):
    rows, docs, labels = marked
    rules = quality_rules.learn(docs, labels)
    assert rules and all(1 <= len(r.conditions) <= 3 for r in rules)
    kept = {r[0] for r in quality_rules.clean(docs, rules).collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert sum((r[0] in kept) == bool(r[2]) for r in held) >= 0.97 * len(held)
    assert all(r[0] in kept for r in held if r[2])


def test_without_labels_the_base_rule_alone_decides(marked, spark, documents, none):
    _, docs, labels = marked
    assert quality_rules.learn(docs, labels.where("false")) == []
    assert quality_rules.learn(docs, labels.where("quality = 1")) == []
    assert quality_rules.judge(none, []).count() == 0
    assert quality_rules.clean(documents, []).columns == documents.columns


def test_toxicity_on_held_out_texts(marked, spark):
    rows, docs, labels = marked
    model = toxicity.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert sum((scores[r[0]] >= 0.5) == bool(r[3]) for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n"), (4, "zlomgrit " * 5000)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert found[1] == found[2] == found[3] < 0.5 <= found[4] <= 1


def test_toxicity_without_both_labels_is_their_share(marked, none, documents):
    _, docs, labels = marked
    assert toxicity.train(docs, labels.where("toxic = 1")).score("any") == 1.0
    nothing = toxicity.train(docs, labels.where("false"))
    assert nothing.score(None) == 0.0
    assert toxicity.score(documents, nothing).count() == documents.count()
    assert toxicity.score(none, nothing).count() == 0


def test_quality_neighbours_on_held_out_texts(marked, spark):
    rows, docs, labels = marked
    model = quality_classifier.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert sum((scores[r[0]] >= 0.7) == bool(r[2]) for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "word " * 20_000)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in quality_classifier.score(odd, model).collect()}
    assert found[1] == found[2] == pytest.approx(model.share) and all(0 <= v <= 1 for v in found.values())


def test_neighbours_are_exact_whatever_the_blocks(marked):
    rows, _, _ = marked
    model = quality_classifier.learn([(r[1].encode(), r[2]) for r in rows[:300]])
    texts = [r[1].encode() for r in rows[300:360]]
    assert model.scores(texts, rows=7, block=13) == pytest.approx(model.scores(texts, rows=256, block=4096), abs=1e-5)


def test_quality_without_labels(marked, none):
    _, docs, labels = marked
    model = quality_classifier.train(docs, labels.where("false"))
    assert {r["score"] for r in quality_classifier.score(docs, model).collect()} == {0.0}
    assert quality_classifier.score(none, model).count() == 0


def test_lengths_are_those_of_zstandard(marked):
    """A window's difference against direct calls with the model's dictionaries; more of a toxic word is nearer to toxic text."""
    import zstandard

    rows, _, _ = marked
    model = toxicity.learn([(r[1], r[3], r[0] % 3) for r in rows], 0.3)
    how = zstandard.ZstdCompressionParameters(**toxicity.LEVELS, write_content_size=0, write_checksum=0, write_dict_id=0)
    sizes = {}
    for side in (model.toxic, model.ordinary):
        held = zstandard.ZstdCompressionDict(toxicity.spread(side + model.common), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes[side] = zstandard.ZstdCompressor(dict_data=held, compression_params=how)
    for word in (b"zlomgrit", b"kravvotz", b"the", b"river", b"zlomgri", b"zlomgritting"):
        window = model.before + toxicity.spread(word) + model.after
        near, far = (len(sizes[s].compress(window)) for s in (model.toxic, model.ordinary))
        assert abs(model.difference(word) - (far - near)) <= 1
    assert model.difference(b"zlomgrit") >= model.thresholds[0] > model.difference(b"the")
    assert model.difference(b"zlomgritting") > 0


def test_queries_hold_rows_out_and_cut_scores(spark, tmp_path, marked):
    from zlib import crc32

    from chronoweave.llm import queries

    rows, docs, labels = marked
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, n, rest, cut in (("op2_toxicity", 5, 0, 0.5), ("op3_quality_classifier", 4, 2, 0.7)):
        got = [r.asDict() for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(rows)
        assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % n == rest) and r["predicted"] == int(r["score"] >= cut) and 0 <= r["score"] <= 1 for r in got)
    judged = {r["doc_id"]: r for r in queries.QUERIES["op1_quality_rules"](spark, str(tmp_path)).collect()}
    assert all(tuple(judged[r[0]])[1:7] == statistics(r[1]) for r in rows) and not any(r["kept"] and r["base_failed"] for r in judged.values())


def test_clashing_names(spark, marked):
    rows, docs, labels = marked
    odd = docs.withColumns({"score": F.lit("mine"), "stats": F.lit(1), "_stats0": F.lit(2), "reason": F.lit("mine")})
    assert set(quality_rules.clean(odd, []).columns) == set(odd.columns)
    assert quality_rules.clean(odd, []).select("reason").first()[0] == "mine"
    for module in (toxicity, quality_classifier):
        assert dict(module.score(odd, module.train(docs, labels.limit(40))).dtypes)["score"] == "double"
