"""Near duplicates by SimHash with pigeonring filtering.

Two fingerprints of 64 bits that differ in at most `radius` bits, cut into `radius + 1` segments on a ring, have a segment from which every
chain of consecutive segments stays within its proportional budget: the first agrees, the first two differ in at most one bit
together, the first three in two, and so on. Candidates are indexed by a start segment and by three quarters of the segment after
it (one differing bit spoils one quarter at most), the chains are checked, and only then the whole distance.

Fingerprints of one text's shingles come from one hash aggregation. Copies are folded to distinct fingerprints before
any candidate is formed, so a group of copies costs one index entry. Groups are connected components; `roots` finds them without
expanding a large group of near copies into its pairs, `links` lists all pairs.

`similar_groups` links texts by the Jaccard similarity of their shingles, the pipeline's rule, with pigeonring chains over other fingerprints.

Defined results: null and empty texts have no shingles and fingerprint zero, linked like any other; very long texts take part whole;
repeated rows stay, in one group; of equal keys and texts any one stands for all; null keys are ignored when a group's smallest key is taken;
an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import simhash
from chronoweave.llm.common import discard, let, release, stored, words
from chronoweave.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(text: Column, width: int, seeds: int = 1) -> Column:
    """struct(h, w) of each run of `width` words of the text with A-Z lowered; fewer words: the whole sequence; none: empty.

    h is the shingle's XXH64 with seed 42; w is 1.
    """

    def of(w: Column) -> Column:
        joined = lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, width)])
        terms = F.transform(w, lambda x, i: F.struct(F.xxhash64(joined(x, i)).alias("h"), F.lit(1).alias("w")))
        return F.slice(terms, 1, F.greatest(F.size(w) - (width - 1), F.lit(1)))

    return let(words(F.translate(text, UPPER, LOWER)), of)


def _segment(x: Column, start: int, bits: int) -> Column:
    """`bits` bits of the long x from bit `start`, around the ring."""
    start %= 64
    turned = F.shiftrightunsigned(x, start).bitwiseOR(F.shiftleft(x, 64 - start)) if start else x
    return turned.bitwiseAND(F.lit(simhash._signed((1 << bits) - 1)))


def _keys(x: Column, radius: int) -> list[Column]:
    """Index keys of a fingerprint: for each start segment and each quarter of the next segment that may differ."""
    m = radius + 1
    edge = [64 * i // m for i in range(m + 1)]
    out = []
    for i in range(m):
        first, after = edge[i + 1] - edge[i], (i + 1) % m
        width = edge[after + 1] - edge[after]
        run = _segment(x, edge[i], first + width)
        quarter = [first + width * q // 4 for q in range(5)]
        for q in range(4):
            spoilt = sum(1 << b for b in range(quarter[q], quarter[q + 1]))
            out.append(F.struct(F.lit(len(out)).alias("i"), run.bitwiseAND(F.lit(simhash._signed(((1 << (first + width)) - 1) & ~spoilt))).alias("key")))
    return out


def _chains(differ: Column, radius: int) -> Column:
    """_viable for the radius + 1 segments of one word."""
    m = radius + 1
    edge = [64 * i // m for i in range(m + 1)]
    return _viable([F.bit_count(_segment(differ, edge[i], edge[i + 1] - edge[i])) for i in range(m)], radius)


def _viable(at: list[Column], radius: int | Column) -> Column:
    """Whether from some start all chains of the ring of differences stay within their share of the radius."""
    m, some = len(at), F.lit(False)
    for i in range(m):
        every, total = F.lit(True), F.lit(0)
        for length in range(1, m):
            total = total + at[(i + length - 1) % m]
            every = every & (total * m <= F.lit(length) * radius)
        some = some | every
    return some


def links(distinct: DataFrame, radius: int = 3, *, fingerprint: str = "fingerprint") -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints that differ in at most `radius` bits."""
    keyed = distinct.select(F.col(fingerprint).alias("f"), F.explode(F.array(*_keys(F.col(fingerprint), radius))).alias("t")).select("f", "t.i", "t.key")
    left, right = keyed.select(F.col("f").alias("a"), "i", "key"), keyed.select(F.col("f").alias("b"), "i", "key")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    met = left.join(right, [left["i"] == right["i"], left["key"] == right["key"], F.col("a") < F.col("b"), _chains(differ, radius), F.bit_count(differ) <= radius])
    return met.select("a", "b").distinct()


def fingerprinted(documents: DataFrame, *, key: str, text: str, width: int) -> DataFrame:
    """One row for each row of documents: key and fingerprint."""
    plain = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    terms = shingles(F.col("_text"), width)
    return simhash.vote(plain.select("_key", "_row", terms.alias("_terms")), ["_key", "_row"], F.col("_terms")).drop("_row").withColumnRenamed("_key", key)


def roots(distinct: DataFrame, pieces: list[Column], words: list[str], near: Callable[[str, str], Column]) -> DataFrame:
    """node, root: the components of the distinct fingerprints that share a key of `pieces` (structs of i and key) and are near.

    near(x, y) is the whole test, on the columns `words` with x and y behind their names. No group is expanded into its pairs. First each
    fingerprint meets one pivot of each of its buckets (the smallest), which joins a large group of near copies with as many links
    as it has members. Then only fingerprints of different components meet, and of these only those outside the pivot's component
    meet all of a bucket: every link between two components is still found, so the components are those of all links.
    """
    at = ["i", "key"]
    side = lambda df, x, *more: df.select(*at, F.col("fingerprint").alias(x), *[F.col(n).alias(n + x) for n in words], *more)
    spread = lambda df: df.select("*", F.explode(F.array(*pieces)).alias("t")).select(*df.columns, "t.i", "t.key")
    pivots = spread(distinct).groupBy(*at).agg(F.min("fingerprint").alias("b"), *[F.min_by(n, "fingerprint").alias(n + "b") for n in words], F.count("*").alias("n")).where("n > 1").drop("n")
    star = side(spread(distinct), "a").join(stored(pivots, "pivots"), at).where((F.col("a") != F.col("b")) & near("a", "b"))
    first = components(star.select("a", "b").distinct())
    label = F.coalesce("root", "fingerprint").alias("label")
    known = stored(distinct.join(first, distinct["fingerprint"] == first["node"], "left").select("fingerprint", *[n for n in words if n != "fingerprint"], label), "labelled")
    release(distinct.sparkSession)
    major = stored(spread(known).groupBy(*at).agg(F.min_by("label", "fingerprint").alias("major")), "majors")
    placed = stored(spread(known).join(major, at), "placed")
    release(distinct.sparkSession)
    minor = side(placed.where("label <> major"), "a", F.col("label").alias("la"))
    others = side(placed, "b", F.col("label").alias("lb"))
    met = minor.join(others, at).where((F.col("la") != F.col("lb")) & near("a", "b"))
    rest = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    kept = known.where("fingerprint <> label").select(F.col("fingerprint").alias("a"), F.col("label").alias("b"))
    return components(kept.unionByName(rest))


def _grouped(each: DataFrame, distinct: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """each (key, fingerprint) with component_id, from distinct (fingerprint, _first) and the roots of linked fingerprints."""
    member = distinct.join(found, distinct["fingerprint"] == found["node"], "left").select("fingerprint", "_first", F.coalesce("root", "fingerprint").alias("_root"))
    member = stored(member, "members")
    lowest = stored(member.groupBy("_root").agg(F.min("_first").alias("component_id")), "lowest")
    named = member.join(lowest, "_root").select("fingerprint", "component_id")
    return each.join(named, "fingerprint").select(key, "fingerprint", "component_id")


def groups(documents: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """key, fingerprint (long) and component_id, the smallest key that links reach, for every row of documents."""
    each = stored(fingerprinted(documents, key=key, text=text, width=width), "fingerprints")
    firsts = stored(each.groupBy("fingerprint").agg(F.min(key).alias("_first")), "distinct")

    def near(x: str, y: str) -> Column:
        differ = F.col(f"fingerprint{x}").bitwiseXOR(F.col(f"fingerprint{y}"))
        return _chains(differ, radius) & (F.bit_count(differ) <= radius)

    return _grouped(each, firsts, roots(firsts, _keys(F.col("fingerprint"), radius), ["fingerprint"], near), key)


#: Similar texts share at least SHARE[0] of SHARE[1] of the shingles that either has (Jaccard).
SHARE = (4, 5)
#: Shingles of at least COMMON texts in a sample of one in SAMPLE count as common, at most MOST_COMMON of them: only speed depends on these.
SAMPLE, COMMON, MOST_COMMON = 16, 8, 5_000
#: A prefix holds one shingle in SPARE more than it must; as many more have to be shared.
SPARE = 20


def _distinct_shingles(text: Column, width: int) -> Column:
    """The sorted hashes of a text's different shingles: a repeated shingle counts once."""
    return F.sort_array(F.array_distinct(shingles(text, width).getField("h")))


def _sized(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return (SHARE[1] * a >= SHARE[0] * b) & (SHARE[1] * b >= SHARE[0] * a)


def _least(n: Column) -> Column:
    """How many shingles of its prefix a set of this size shares with any similar set that has no smaller demand."""
    return F.floor(n / SPARE).cast("int") + 1


def _prefix(shingle_set: Column, common: list[int]) -> Column:
    """The first shingles of a set in one order for all sets: all but SHARE of the set, and _least.

    Of t shingles that two sets share, the first k are among the first n - (t - k) of either: similar sets share the smaller _least of both in
    their prefixes. Any common order is right; here it is by hash, and common shingles come last, so that a line of many texts seldom
    makes candidates.
    """
    n = F.size(shingle_set)
    ordered = shingle_set
    if common:
        known = lambda x: x.isin(common)
        ordered = F.concat(F.filter(shingle_set, lambda x: ~known(x)), F.filter(shingle_set, known))
    return F.slice(ordered, 1, n - _at_least(n) + _least(n))


def _at_least(n: Column) -> Column:
    """How many shingles a similar set shares with one of n, and has, at least."""
    return F.ceil(n * SHARE[0] / SHARE[1]).cast("int")


def _common(plain: DataFrame, width: int) -> list[int]:
    some = plain.where(F.pmod("_th", F.lit(SAMPLE)) == 0).dropDuplicates(["_th"])
    counts = some.select(F.explode(_distinct_shingles(F.col("_text"), width)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return [r[0] for r in counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").collect()]


#: Words of 64 bits in a set's fingerprint, the segments of its ring.
PARITY_WORDS = 8


#: Rounds of pivots before texts of different components meet: speed alone depends on it.
PIVOT_ROUNDS = 2


def _parities(sets: DataFrame) -> DataFrame:
    """a and p0, p1, ...: PARITY_WORDS words in which each element of a set (fingerprint, s) flips one bit, chosen by its hash.

    Two sets' parities differ in at most as many bits as there are elements that only one of them has.
    """
    each = sets.select(F.col("fingerprint").alias("a"), F.explode("s").alias("h"))
    word, bit = F.shiftrightunsigned("h", 61), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 55) & 63 as int))")
    flips = [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(PARITY_WORDS)]
    return each.groupBy("a").agg(*flips)


def _within_reach() -> Column:
    """Whether fingerprints p0.. and q0.. of sets of n and m shingles may be those of similar sets: chains of the ring first, then all bits.

    Sets of n and m that share at least SHARE of what either has differ in so many shingles at most: no similar pair fails.
    """
    at = [F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(PARITY_WORDS)]
    both = F.col("n") + F.col("m")
    radius = both - 2 * F.ceil(SHARE[0] * both / sum(SHARE)).cast("int")
    return _viable(at, radius) & (sum(at[1:], at[0]) <= radius)


def similar_groups(documents: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """key and component_id, the smallest key of its group, for every row: the groups that texts of a Jaccard similarity of SHARE or more link.

    Compared are the sets of shingles, exactly up to equal 64-bit hashes. Candidates share enough shingles of their prefixes (see _prefix), which
    no similar pair fails to do. As in `roots`, a shingle's texts meet its pivot first, and then only texts of different components meet: of
    these, inside the join, pigeonring chains over 512-bit fingerprints whose Hamming distance bounds the sets' difference prune
    all but near ones, and what is left is held against the whole sets. A vote's sign bits (SimHash proper) bound nothing at a
    similarity of 0.8, so a bit is a parity here. Equal sets are folded first. Texts without words form one group.
    """
    plain = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_th"))
    shingled = plain.select("_key", "_th", _distinct_shingles(F.col("_text"), width).alias("_set"))
    cut = _prefix(F.col("_set"), _common(plain, width))
    whole = stored(shingled.select(F.col("_key").alias(key), "_th", F.xxhash64("_set").alias("fingerprint"), F.size("_set").alias("n"), cut.alias("_cut")), "sets")
    whose = F.min(F.struct(F.col(key).alias("_key"), "_th")).alias("_whose")
    cuts = stored(whole.groupBy("fingerprint").agg(F.min(key).alias("_first"), whose, F.first("n").alias("n"), F.first("_cut").alias("_cut")), "cuts")
    each, distinct = stored(whole.select(key, "fingerprint"), "each"), stored(cuts.drop("_cut"), "distinct")
    discard(whole)
    spread = cuts.select(F.col("fingerprint").alias("a"), "n", F.explode("_cut").alias("h"))
    pivots = lambda df: df.groupBy("h").agg(F.min("a").alias("b"), F.max("a").alias("z")).where("b <> z").select("h", "b")
    several = stored(pivots(spread), "pivots")
    met = stored(spread.join(several.select("h"), "h"), "met")
    discard(cuts, several)
    release(documents.sparkSession)

    def enough(rows: DataFrame) -> DataFrame:
        """The rows (a, n, ...) of those a that have as many of them as a similar set would share."""
        kept = rows.groupBy("a").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= _least(_at_least(F.col("n")))).select("a")
        return rows.join(kept, "a", "left_semi")

    shared = stored(enough(met), "shared")
    discard(met)
    release(documents.sparkSession)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """fingerprint and s, the whole set, of the nodes."""
        wanted = distinct.join(nodes, "fingerprint", "left_semi").select("fingerprint", "_whose._key", "_whose._th")
        found = plain.withColumnsRenamed({"_key": "_k", "_th": "_t"}).join(wanted, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_th")))
        return found.dropDuplicates(["fingerprint"]).select("fingerprint", _distinct_shingles(F.col("_text"), width).alias("s"))

    def similar(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Those of the pairs (a, b) whose whole sets are similar; known: sets that hold those of the pairs."""
        pairs = stored(pairs, "pairs")
        nodes = pairs.select(F.col("a").alias("fingerprint")).union(pairs.select("b")).distinct()
        sets = stored(sets_of(nodes) if known is None else known.join(nodes, "fingerprint", "left_semi"), "candidates")
        release(documents.sparkSession)
        side = lambda x: sets.select(F.col("fingerprint").alias(x), F.col("s").alias("s" + x))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        in_both = F.size(F.array_intersect("sa", "sb"))
        found = stored(both.where(sum(SHARE) * in_both >= SHARE[0] * (F.size("sa") + F.size("sb"))).select("a", "b"), "similar")
        discard(pairs, sets)
        return found

    def apart_in(rows: DataFrame, links: DataFrame) -> DataFrame:
        """Of the rows (h, a, n) those of shingles that more than one component has, with the component la and whether it is another than most."""
        labels = components(links).select(F.col("node").alias("a"), F.col("root").alias("la"))
        labelled = stored(rows.join(labels, "a", "left").select("h", "a", "n", F.coalesce("la", "a").alias("la")), "labelled")
        major = labelled.groupBy("h").agg(F.mode("la").alias("major"), F.min("la").alias("y"), F.max("la").alias("z")).where("y <> z").select("h", "major")
        placed = stored(labelled.join(major, "h").select("h", "a", "n", "la", (F.col("la") != F.col("major")).alias("minor")), "placed")
        apart = stored(enough(placed), "apart")
        discard(labelled, placed)
        release(documents.sparkSession)
        return apart

    sizes = distinct.select(F.col("fingerprint").alias("b"), F.col("n").alias("m"))
    starred = shared.join(pivots(shared), "h").where("a <> b").groupBy("a", "n", "b").agg(F.count("*").alias("c"))
    starred = starred.join(sizes, "b").where(_sized(F.col("n"), F.col("m")) & (F.col("c") >= _least(F.least("n", "m"))))
    links = similar(starred.select("a", "b"))
    apart = apart_in(shared.select("h", "a", "n"), links)
    discard(shared)
    sets = stored(sets_of(apart.select(F.col("a").alias("fingerprint")).distinct()), "sets")
    parity = stored(_parities(sets), "parities")
    release(documents.sparkSession)
    second = [F.col(f"p{k}").alias(f"q{k}") for k in range(PARITY_WORDS)]
    for turn in range(PIVOT_ROUNDS):  # another member of the largest component for each shingle
        pivot = apart.where("not minor").groupBy("h").agg(F.min(F.struct(F.xxhash64("h", "a", F.lit(turn)), F.col("a").alias("b"), F.col("n").alias("m"))).alias("x")).select("h", "x.b", "x.m")
        pairs = apart.where("minor").join(pivot, "h").where(_sized(F.col("n"), F.col("m"))).select("a", "n", "b", "m").distinct()
        near = pairs.join(parity, "a").join(parity.select(F.col("a").alias("b"), *second), "b").where(_within_reach())
        links = links.unionByName(similar(near.select("a", "b"), sets))
        before, apart = apart, apart_in(apart.select("h", "a", "n"), links)
        discard(before)
    marked = apart.join(parity, "a")
    others = marked.select("h", F.col("a").alias("b"), F.col("n").alias("m"), F.col("la").alias("lb"), F.col("minor").alias("also"), *second)
    once = (F.col("la") != F.col("lb")) & (~F.col("also") | (F.col("a") < F.col("b")))
    across = marked.where("minor").join(others, "h").where(once & _sized(F.col("n"), F.col("m")) & _within_reach())
    counted = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("n", "m").alias("n")).groupBy("a", "b").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    rest = similar(counted.where(F.col("c") >= _least(F.col("n"))).select("a", "b"), sets)
    discard(apart, parity, sets)
    return _grouped(each, distinct.select("fingerprint", "_first"), components(links.unionByName(rest)), key).drop("fingerprint")


def first_of_groups(documents: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """The documents with the smallest key of their group; rows that share a key stay or go together, and null keys stay."""
    later = similar_groups(documents, key=key, text=text, width=width).where(F.col(key) > F.col("component_id")).select(key).distinct()
    return documents.join(stored(later, "later"), key, "left_anti").select(documents.columns)
