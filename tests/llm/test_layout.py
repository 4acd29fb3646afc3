"""Sharding, mixing, encoding, page extraction and the pipeline."""

from __future__ import annotations

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoweave.llm import bpe, html_extract, mixing, sharding
from chronoweave.llm.queries import vocabulary_text
from tests.llm.conftest import prose


def check_shards(got, rows, shards):
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    for slots in size.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for slots in size.values():
        assert abs(sum(b for _, b in slots) - total / shards) <= largest + 0.02 * total / shards
    return size


def test_shards_are_near_equal_in_bytes_and_gapless(documents, rows):
    got = sharding.shard(documents, 4).collect()
    check_shards(got, rows, 4)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], len((r[1] or "").encode()) + 1) for r in rows)
    assert "lang" in got[0].asDict()


def test_one_text_in_most_rows_is_split_and_small_groups_stay(spark):
    rng = random.Random(3)
    rows = [(i, "the same text") for i in range(900)] + [(1000 + i, prose(rng, 5)) for i in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check_shards(got, rows, 8)
    assert len({r["shard"] for r in got if r["text"] == "the same text"}) >= 4


def test_shards_of_little(spark, none):
    assert sharding.shard(none, 8).count() == 0
    got = sharding.shard(spark.createDataFrame([(1, None), (1, None), (1, None)], "doc_id long, text string"), 2).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) in ([(0, 0), (0, 1), (0, 2)], [(1, 0), (1, 1), (1, 2)])


def test_exponent_meets_entropy_and_repetition():
    shares = [0.7, 0.2, 0.08, 0.02, 0.0]
    x = mixing.exponent_for(shares, target_entropy=1.2)
    assert mixing.entropy(mixing.weights(shares, x)) == pytest.approx(1.2, abs=1e-6)
    y = mixing.exponent_for(shares, max_repetition=2.0)
    assert mixing.repetition(shares, mixing.weights(shares, y), None) == pytest.approx(2.0, abs=1e-6)
    assert mixing.exponent_for(shares) == 1.0 and mixing.exponent_for([0.5, 0.5], max_repetition=1.5) == 0.0
    assert mixing.exponent_for([], max_repetition=2.0) == 0.0


def test_mix_meets_its_budget(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(5, 30)), "big" if i % 6 else rng.choice(["small", "tiny", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, max_repetition=2.0).collect()
    words = {r[0]: len(r[1].split()) for r in rows}
    source = {r[0]: r[2] for r in rows}
    assert {r["doc_id"] for r in got} == set(words)
    assert all(r["source"] == source[r["doc_id"]] for r in got)
    passes = {}
    for s in ("big", "small", "tiny", None):
        own = sum(w for i, w in words.items() if source[i] == s)
        passes[s] = sum(words[r["doc_id"]] for r in got if r["source"] == s) / own
    totals = [(s, sum(v == s for v in source.values()), sum(w for i, w in words.items() if source[i] == s)) for s in (None, "big", "small", "tiny")]
    for p in mixing.plan(totals):
        assert passes[p.source] == pytest.approx(p.epochs + p.rest / p.tokens, abs=31 / p.tokens)
    assert max(passes.values()) <= 2.001 and min(passes.values()) == 1
    epochs = {(r["doc_id"], r["epoch"]) for r in got}
    assert len(epochs) == len(got)


def test_mix_with_a_smaller_budget_and_odd_rows(documents, rows, none):
    assert mixing.mix(none).count() == 0
    whole = mixing.mix(documents)
    assert set(documents.columns) <= set(whole.columns)
    assert {r["doc_id"] for r in whole.collect()} == {r[0] for r in rows}
    tokens = sum(len((r[1] or "").split()) for r in rows)
    half = mixing.mix(documents, budget=tokens // 2, max_repetition=None)
    spent = half.select(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    assert spent <= tokens // 2


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.no_truncation()
    made.no_padding()
    return made


def test_encoding_is_the_librarys(documents, rows, library):
    got = {(r["doc_id"], r["text"]): r for r in bpe.encode(documents, vocabulary_text()).collect()}
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0], r[1]]["tokens"] == ids
        assert got[r[0], r[1]]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_encoding_of_odd_texts(library):
    codec = bpe.Codec(bpe.vocabulary(vocabulary_text()), remembered=50)
    rng = random.Random(1)
    letters = "abcdeé ß日本\n\t  'st 🙂ee aaaa0123  　\x00�"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", " <|endoftext|>x", "      ", "aaaaaaaaa"]) for _ in range(1500)]
    texts += ["".join(rng.choice(["the", "ing", " ", "er", "re", "st", "tion", "'s", "anti"]) for _ in range(40)) for _ in range(500)]
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        tokens = codec.encode(part)
        assert tokens == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [codec.decode(t) for t in tokens] == [library.decode(t, skip_special_tokens=False) for t in tokens]


def test_pairs_are_compatible_if_merging_keeps_them():
    import numpy as np

    codec = bpe.Codec(bpe.vocabulary(vocabulary_text()))
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50_256, 4_000), rng.integers(0, 50_256, 4_000)
    want = [codec.merged(codec.bytes[x] + codec.bytes[y]) == [x, y] for x, y in zip(a, b, strict=True)]
    assert codec.compatible(a, b).tolist() == want and not all(want)


PAGE = """<!DOCTYPE html><html><head><title>Head &amp; shoulders</title><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1><nav class="menu"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies to serve you.</p></div><article><h1>The  rain&nbsp;came</h1><p><b>First paragraph,
over lines &lt;here&gt;.<br><p>Second &#169; paragraph with <a href="/x">a link</a> in it.<div class="ad">Buy it now</div>
<ul><li>One thing<li>Another thing</ul><!-- gone --><p>Last words.</p></article><aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">C</a></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked it a lot, thank you.</p></div></section><form action="/s"><p>Search</p><input name="q"></form><footer>&copy; us</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_extract.labelled_pages(1500))


def test_extraction_of_a_page(model):
    assert model.text(PAGE).split("\n\n") == ["The rain came", "First paragraph, over lines <here>.", "Second © paragraph with a link in it.", "One thing", "Another thing", "Last words."]


def test_extraction_of_held_out_templates(model):
    right = 0
    pages = html_extract.labelled_pages(200, seed=77)
    for page in pages:
        nodes, blocks = html_extract.parse(page)
        truth = {}
        for x in nodes:
            truth[id(x)] = x.label if x.label is not None else truth[id(x.parent)] if x.parent is not None else 0
        want = "\n\n".join(t for node, t in blocks if truth[id(node)])
        right += model.text(re.sub(r' data-content-label="\d"', "", page)) == want
    assert right >= 0.95 * len(pages)


def test_marginals_are_those_of_enumeration(model):
    from itertools import product
    from math import exp

    nodes, _ = html_extract.parse("<div class='x'><p>one</p><ul><li>a<li>b</ul></div><footer>f</footer>")
    scores = [model.unary(x) for x in nodes]
    got, _ = model.marginals(nodes, scores)
    at = {id(x): i for i, x in enumerate(nodes)}
    total, on = 0.0, [0.0] * len(nodes)
    for ys in product((0, 1), repeat=len(nodes)):
        w = exp(sum(s for s, y in zip(scores, ys, strict=True) if y) + sum(model.pair[ys[at[id(x.parent)]]][ys[i]] for i, x in enumerate(nodes) if x.parent is not None))
        total += w
        on = [o + w * y for o, y in zip(on, ys, strict=True)]
    assert got == pytest.approx([o / total for o in on], abs=1e-9)


def test_extraction_of_odd_pages(spark, model):
    rows = [(1, None, "u", "x"), (2, "", "u", "x"), (3, "no markup at all", "u", "x"), (4, "<article><p>open <b>all the way", "u", "x"), (5, "<" * 1000 + "p>" * 1000, "u", "x"), (6, '<p class="x" id=">">q</p>', "u", "x"), (1, None, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = html_extract.extract(df, model=model).collect()
    assert len(got) == 7 and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert [r["text"] for r in got if r["page_id"] == 4] == ["open all the way"]
    assert html_extract.extract(df.limit(0), model=model).count() == 0


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    base = [prose(rng, rng.randint(40, 90)) for _ in range(80)]
    passage = prose(rng, 60)
    texts = [*base, base[0], base[1], *[f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(3)], *["***&& " + prose(rng, 60).replace(" ", "*** ") for _ in range(20)], None, "", "short"]
    rows = [(i, t, "en", f"s{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(not (t or "").startswith("***")), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert set(range(80)) <= ids and not ids & {80, 81} and not ids & set(range(85, 105)) and not ids & {105, 106, 107}
    assert all(r["decodes"] for r in out)
    first, later = ([r for r in out if r["doc_id"] == i][0]["n_tokens"] for i in (82, 83))
    assert later < 0.75 * first


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 11))
    assert set(entry.oracle_sql()) <= names


def test_targets_are_met_or_refused():
    shares = [0.7, 0.2, 0.1]
    for target in (0.3, 0.8, 1.05):
        assert mixing.entropy(mixing.weights(shares, mixing.exponent_for(shares, target_entropy=target))) == pytest.approx(target, abs=1e-6)
    for wrong in ({"target_entropy": 1.2}, {"target_entropy": -0.1}, {"max_repetition": 2.0, "budget_share": 10.0}, {"target_entropy": 1.0, "max_repetition": 1.01}):
        with pytest.raises(ValueError):
            mixing.exponent_for(shares, **wrong)


def test_a_hundred_thousand_cells_are_no_literals(spark):
    df = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    placed = sharding.shard(df, 8, cell_bytes=1, least_cells=100_000)
    check_shards(placed.collect(), range(3_000), 8)
    assert len(placed._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_long_words_merge_in_a_moment(library):
    import time

    codec = bpe.Codec(bpe.vocabulary(vocabulary_text()))
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("abctheringé日") for _ in range(rng.randint(90, 300))).encode()
        parts = [codec.ids[word[i : i + 1]] for i in range(len(word))]
        assert codec._merged_short(list(parts)) == codec._merged_long(list(parts))
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    start = time.perf_counter()
    assert codec.encode([word])[0] == library.encode(word, add_special_tokens=False).ids
    assert time.perf_counter() - start < 60


def test_other_tokenizers_are_refused():
    import json

    spec = json.loads(vocabulary_text())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        with pytest.raises(ValueError, match="byte-level"):
            bpe.vocabulary(json.dumps(spec | change))


@pytest.mark.parametrize("page", ["<a" * 500_000, '<a "' * 250_000, '<a ">" ' * 150_000 + "'", "<b>" * 300_000 + "</i>" * 200_000, "<ul><li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<iframe " * 100_000 + ">" + "<template>" * 100_000, "<p " + "a" * 500_000 + " b=>"])
def test_odd_markup_is_read_in_a_moment(page):
    import time

    start = time.perf_counter()
    html_extract.parse(page)
    assert time.perf_counter() - start < 15


def test_formulas_and_held_objects_stay(model):
    page = "<article><p>Let <math><mi>x</mi></math> be <object>held</object> &amp; 3 < 4 in all of the words.</p></article>"
    assert model.text(page) == "Let x be held & 3 < 4 in all of the words."


def test_query_of_shards_and_tokens(spark, tmp_path, documents, rows, library):
    from zlib import crc32

    from chronoweave.llm import queries
    from hashlib import sha256

    documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in queries.QUERIES["op5_sharding"](spark, str(tmp_path)).collect()]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((r[0], len((r[1] or "").encode()) + 1, crc32((r[1] or "").encode())) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)} and {r["shard"] for r in got} <= set(range(8))
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.QUERIES["op6_bpe"](spark, str(tmp_path)).collect()) == sorted(want)
    mixed = queries.QUERIES["op4_mixing"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in mixed} == {r[0] for r in rows}
    prints = [r.asDict() for r in queries.QUERIES["op10_simhash_dedup"](spark, str(tmp_path)).collect()]
    assert len(prints) == len(rows) and all(len(r["fingerprint"]) == 16 and r["component_id"] <= r["doc_id"] for r in prints)
