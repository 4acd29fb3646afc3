"""Fingerprints, near duplicates, components and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from chronoweave.llm import simhash, simhash_dedup, substring_dedup
from chronoweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def fingerprint(terms, ties):
    votes, total = [0] * 64, 0
    for h, w in terms:
        total += w
        for b in range(64):
            votes[b] += w * (h >> b & 1)
    return sum(1 << b for b in range(64) if total and (2 * votes[b] >= total if ties else 2 * votes[b] > total))


def shingle_hashes(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    return [(xxhash.xxh64(r.encode(), seed=42).intdigest(), 1) for r in runs]


def pair_hashes(text):
    w = WORD.findall(text or "")
    pairs = [(w[i], w[i + 1]) for i in range(len(w) - 1)] if len(w) > 1 else [(x,) for x in w]
    out = []
    for p in pairs:
        h = 42
        for x in p:
            h = xxhash.xxh64(x.encode(), seed=h).intdigest()
        out.append((h, min(32, sum(map(len, p)))))
    return out


def linked(values, near):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if near(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_groups_are_those_of_brute_force(documents, rows):
    got = [(r[0], r[1] % (1 << 64), r[2]) for r in simhash_dedup.groups(documents).collect()]
    prints = [(r[0], fingerprint(shingle_hashes(r[1], 3), False)) for r in rows]
    root = linked({f for _, f in prints}, lambda a, b: (a ^ b).bit_count() <= 3)
    lowest = {}
    for i, f in prints:
        lowest[root[f]] = min(i, lowest.get(root[f], i))
    assert sorted(got) == sorted((i, f, lowest[root[f]]) for i, f in prints)


def test_links_find_all_near_pairs_of_any_place(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b for b in base}
    for b in base:
        for k in range(1, 6):
            values.add(b ^ sum(1 << p for p in rng.sample(range(64), k)))
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fingerprint long")
    for radius in (1, 3, 5):
        got = {tuple(sorted((a % (1 << 64), b % (1 << 64)))) for a, b in simhash_dedup.links(df, radius).collect()}
        assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= radius}
    found = {(q % (1 << 64), f % (1 << 64)) for q, f, _ in simhash.within(df, df, radius=3).collect()}
    assert found == {(a, b) for a in values for b in values if (a ^ b).bit_count() <= 3}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(30)]
    star = [(100, i) for i in range(101, 140)]
    got = dict(components(spark.createDataFrame([*chain, *star, (7, 7), (1, 0)], "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_and_their_edits(documents, rows):
    got = sorted(tuple(r) for r in simhash.fingerprints(documents).collect())
    ordered = sorted(((r[0], r[1] or "") for r in rows))
    want = []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        f, e, n = (fingerprint(pair_hashes(t), True) for t in (text, edited, after))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), simhash._signed(f), simhash._signed(e), 1 - (f ^ e).bit_count() / 64, 1 - (f ^ n).bit_count() / 64))
    assert got == sorted(want)


def test_neighbours_over_many_buckets(documents, rows):
    plain = documents.select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    got = sorted((r["k"], r["t"], r["_next"]) for r in simhash.with_next(plain, "k", "t", rows_a_bucket=7).where(~F.col("_extra")).collect())
    ordered = sorted((r[0], r[1] or "") for r in rows)
    assert got == sorted((k, t, ordered[(i + 1) % len(ordered)][1]) for i, (k, t) in enumerate(ordered))
    deep = simhash.with_next(plain, "k", "t", rows_a_bucket=3, fan_out=5)
    assert sorted((r["k"], r["t"], r["_next"]) for r in deep.where(~F.col("_extra")).collect()) == got
    assert deep.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= 9 and deep.select("_bucket").distinct().count() > 15


def test_empty_tables(none):
    assert simhash_dedup.groups(none).count() == 0
    assert simhash.fingerprints(none).count() == 0
    assert simhash_dedup.first_of_groups(none).columns == none.columns
    assert substring_dedup.dedup(none).count() == 0


def removed(rows, window=13):
    first = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            first[run] = min(first.get(run, r[0]), r[0])
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < r[0]:
                gone.update(range(i, i + window))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_substring_dedup_is_that_of_brute_force(documents, rows):
    kept = substring_dedup.dedup(documents)
    assert set(documents.columns) <= set(kept.columns)
    assert sorted(tuple(r) for r in kept.select("doc_id", "n_words", "n_removed", "kept").collect()) == removed(rows)
    assert sum(r[2] for r in removed(rows)) > 100


def test_a_full_bitmap_only_costs_time(documents, rows):
    kept = substring_dedup.dedup(documents, bitmap_bits=6)
    assert sorted(tuple(r) for r in kept.select("doc_id", "n_words", "n_removed", "kept").collect()) == removed(rows)


def test_the_bitmap_grows_with_the_repeated_anchors(documents, rows, monkeypatch):
    made, filled = substring_dedup._bitmap, []

    def seen(repeated, bits):
        words = made(repeated, bits)
        filled.append((bits, sum(int(w).bit_count() for w in words.view("uint64")) / 2**bits))
        return words

    monkeypatch.setattr(substring_dedup, "BITMAP_BITS", 6)
    monkeypatch.setattr(substring_dedup, "_bitmap", seen)
    kept = substring_dedup.dedup(documents)
    assert sorted(tuple(r) for r in kept.select("doc_id", "n_words", "n_removed", "kept").collect()) == removed(rows)
    assert 6 < filled[0][0] < 26 and filled[0][1] < 0.2 and substring_dedup.bitmap_size(30_000_000) == 29 and substring_dedup.bitmap_size(0) == 6


def test_spans_are_paths_with_their_source(documents, rows):
    spans = substring_dedup.repeated_spans(documents).collect()
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    for s in spans:
        run, source = words[s["doc"]][s["start"] : s["end"]], " ".join(words[s["source"]])
        assert s["source"] < s["doc"] and len(run) >= 13 and " ".join(run[:13]) in source and " ".join(run[-13:]) in source


def test_null_keys_stay_whole(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r[0] or 0, r[1]) for r in substring_dedup.dedup(df).select("doc_id", "n_removed").collect()) == [(0, 0), (1, 0), (2, 30)]


def test_first_of_groups_keeps_clean_and_drops_near_copies(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(8)
    base = [prose(rng, 150) for _ in range(40)]
    near = [" ".join(w if i != 70 else "changed" for i, w in enumerate(b.split())) for b in base[:20]]
    rows = [(i, t) for i, t in enumerate([*base, *near, *base[:5]])]
    kept = {r[0] for r in simhash_dedup.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(40)) <= kept
    assert not kept & set(range(60, 65)) and len(kept & set(range(40, 60))) <= 1


def test_one_repeated_line_does_not_make_texts_alike(spark):
    """Every text has 2,000 words of its own and one line of eight words 45 times: 36 distinct shingles or fewer in common."""
    line = " ".join(f"rule{i}" for i in range(8))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(2000)) + f" {line}" * 45) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash_dedup.similar_groups(df).collect())) == [(i, i) for i in range(12)]
    assert simhash_dedup.first_of_groups(df).count() == 12


def test_similar_groups_are_those_of_brute_force_around_the_threshold(spark):
    """Texts with every seventh to every ninetieth word changed, short and long: pairs from 0.6 to 0.95, on both sides of 0.8."""
    import random

    rng = random.Random(5)
    texts = [None, "", " \n", "lone", "Lone", "four words are here"]
    for k in range(50):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([9, 12, 30, 80, 200]))]
        texts.append(" ".join(base))
        for _ in range(3):
            step = rng.choice([15, 25, 40, 45, 50, 60, 90])
            texts.append(" ".join(w if rng.randrange(step) else f"n{rng.randrange(10**6)}" for w in base) + rng.choice(["", " end", " the end of it"]))
    sets = [{h for h, _ in shingle_hashes(t, 5)} for t in texts]
    near = lambda a, b: sets[a] == sets[b] or bool(sets[a] | sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    between = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a & b]
    assert sum(0.7 <= x < 0.8 for x in between) > 10 and sum(0.8 <= x < 0.9 for x in between) > 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(map(tuple, simhash_dedup.similar_groups(df).collect())) == linked(list(range(len(texts))), near)
    sure = simhash_dedup._common
    try:  # the order of the prefixes is free: with some shingles taken for common ones the groups are the same
        simhash_dedup._common = lambda plain, width: [simhash._signed(h) for h in sorted(set().union(*sets))[::3]]
        assert dict(map(tuple, simhash_dedup.similar_groups(df).collect())) == linked(list(range(len(texts))), near)
    finally:
        simhash_dedup._common = sure


def test_keys_of_passages_are_numbers(spark):
    import pytest

    with pytest.raises(ValueError, match="whole numbers"):
        substring_dedup.dedup(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
