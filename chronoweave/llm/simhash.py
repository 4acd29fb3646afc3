"""SimHash document fingerprints, in Spark expressions only, and exact search for near ones.

Every term of a text is hashed to 64 bits; each bit votes for or against by the term's weight; the fingerprint's bit is the sign of the
sum. The votes of two bits share one 64-bit sum (32 bits each), so a text's fingerprint is one hash aggregation of 32 sums, inside
generated code. Near fingerprints are found with permuted block tables: the bits are cut into blocks, and two fingerprints that
differ in at most `radius` bits agree on all bits of some choice of `blocks - radius` blocks, one table for each choice.

Defined results: null and empty texts have no terms and fingerprint 0; very long texts vote whole, as long as the weights of one text sum to less
than 2^31 (some 60 million words); repeated rows are rows of their own; null keys come first; an empty table gives no rows; other columns
are not read, so their names do not matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import let, words

#: Cuts (8 bytes each) up to which their table is broadcast.
BROADCAST_CUTS = 2_000_000
LANES = 32
PAIR = (1 << 32) | 1


def vote(df: DataFrame, keys: list[str], terms: Column, *, out: str = "fingerprint", ties: bool = False, hashes: int = 1) -> DataFrame:
    """One row for each value of `keys`: the fingerprint, as a long, of its `terms`, an array of struct(h, w).

    A bit is set if the weight of the terms that have it is more than half (with `ties`: at least half) of all weight; without
    terms the fingerprint is 0. The weights of one text must sum to less than 2^31. With more `hashes` each text gets as many
    rows, numbered by the column _i; all but the first vote with a hash of h and that number.
    """
    each = df.select(*keys, F.explode_outer(terms).alias("_x")).select(*keys, F.col("_x.h").alias("_h"), F.col("_x.w").cast("long").alias("_w"))
    if hashes > 1:
        each = each.select("*", F.explode(F.array(*map(F.lit, range(hashes)))).alias("_i"))
        each = each.withColumn("_h", F.when(F.col("_i") == 0, F.col("_h")).otherwise(F.xxhash64("_i", "_h")))
        keys = [*keys, "_i"]
    lanes = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(PAIR)) * F.col("_w")).alias(f"_s{k}") for k in range(LANES)]
    summed = each.groupBy(*keys).agg(F.sum("_w").alias("_votes"), *lanes)
    bit = lambda ones, k: F.when(2 * ones >= F.col("_votes") if ties else 2 * ones > F.col("_votes"), F.lit(_signed(1 << k))).otherwise(F.lit(0).cast("long"))
    halves = []
    for base in (0, LANES):
        for k in range(LANES):
            ones = F.shiftrightunsigned(f"_s{k}", 32) if base else F.col(f"_s{k}").bitwiseAND(F.lit((1 << 32) - 1))
            halves.append(bit(ones, k + base))
    whole = halves[0]
    for x in halves[1:]:
        whole = whole.bitwiseOR(x)
    return summed.select(*keys, F.coalesce(F.when(F.col("_votes") > 0, whole), F.lit(0).cast("long")).alias(out))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def as_hex(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of bits that differ."""
    return F.lit(1.0) - distance(a, b) / F.lit(64.0)


def pair_terms(text: Column) -> Column:
    """Terms of a text: each word with the next one, weighted by their code points, at most 32; a lone word stands for itself."""

    def of(w: Column) -> Column:
        weight = lambda x, i: F.least(F.lit(32), F.length(x) + F.coalesce(F.length(F.get(w, i + 1)), F.lit(0)))
        terms = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1)).alias("h"), weight(x, i).alias("w")))
        return F.slice(terms, 1, F.greatest(F.size(w) - 1, F.lit(1)))

    return let(words(text), of)


def with_next(df: DataFrame, key: str, text: str, *, rows_a_bucket: int = 4_000, fan_out: int = 2_000) -> DataFrame:
    """df's rows in buckets of neighbouring keys, each with the text of the row after it (after the last: the first).

    Adds _bucket, _rank (place in the bucket), _next, and _extra: true on the copy of the next bucket's first row that each bucket ends
    with. One exchange of the rows; no task holds more than a bucket of about `rows_a_bucket` rows, and equal keys, however many rows there are:
    beyond fan_out buckets each of them is cut again, by a table of cuts that is joined. Nulls come first among keys; equal keys are
    ordered by text.
    """
    at = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    n, lowest = df.agg(F.count("*"), F.min(at)).first()
    wanted = max(1, -(-n // rows_a_bucket))
    first = min(wanted, fan_out)
    cuts = df.agg(F.percentile_approx(at, [i / first for i in range(1, first)], 20 * first)).first()[0] if first > 1 else []
    cuts = sorted({c for c in cuts or [] if c != lowest})
    placed = df.withColumns({"_at": at, "_c": F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at)) if cuts else F.lit(0)})
    opens_coarse = F.col("_at").isin(cuts) if cuts else F.lit(False)
    if wanted > first:
        inner = -(-wanted // first)
        fine = placed.groupBy("_c").agg(F.min("_at").alias("_low"), F.percentile_approx("_at", [i / inner for i in range(1, inner)], 20 * inner).alias("_cuts"))
        fine = fine.select("_c", F.array_sort(F.array_distinct(F.filter("_cuts", lambda c: c > F.col("_low")))).alias("_cuts"))
        fine = fine.withColumn("_before", F.lag(F.size("_cuts")).over(W.orderBy("_c")))  # fan_out rows at most
        placed = placed.join(F.broadcast(fine) if wanted <= BROADCAST_CUTS else fine, "_c")
        own = F.size(F.filter("_cuts", lambda c: c <= F.col("_at")))
        ends = {"_own": F.struct(F.col("_c").alias("c"), own.alias("f")), "_previous": F.when(F.array_contains("_cuts", F.col("_at")), F.struct(F.col("_c").alias("c"), (own - 1).alias("f"))).when(opens_coarse, F.struct((F.col("_c") - 1).alias("c"), F.col("_before").alias("f")))}
        last = fine.orderBy(F.desc("_c")).select("_c", F.size("_cuts")).first()
    else:
        ends = {"_own": F.struct(F.col("_c").alias("c"), F.lit(0).alias("f")), "_previous": F.when(opens_coarse, F.struct((F.col("_c") - 1).alias("c"), F.lit(0).alias("f")))}
        last = (len(cuts), 0)
    wraps = F.when(F.col("_at") == F.lit(lowest), F.struct(F.lit(last[0] if last else 0).alias("c"), F.lit(last[1] if last else 0).alias("f"))).otherwise(F.col("_previous"))
    placed = placed.withColumns(ends).withColumn("_previous", wraps)
    copies = F.array_compact(F.array(F.struct(F.col("_own").alias("b"), F.lit(False).alias("x")), F.when(F.col("_previous").isNotNull(), F.struct(F.col("_previous").alias("b"), F.lit(True).alias("x")))))
    spread = placed.withColumn("_copy", F.explode(copies)).select(*df.columns, F.col("_copy.b").alias("_bucket"), F.col("_copy.x").alias("_extra"))
    order = W.partitionBy("_bucket").orderBy("_extra", F.asc_nulls_first(key), F.asc_nulls_first(text))
    return spread.withColumns({"_rank": F.row_number().over(order), "_next": F.lead(text, 1).over(order)})


def fingerprints(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The fingerprint of each document and of its edited text, whose last quarter comes from the next document.

    Returns key, n_chars, edited_sha256, fingerprint and edited_fingerprint (long), near_edited and near_next. A null or empty text has
    fingerprint 0; among equal keys the order of the texts decides which is next; the one row of a table is its own next. `how` is that of with_next.
    """
    plain = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    joined = with_next(plain, "_key", "_text", **how).withColumn("_n", F.length("_text").cast("long"))
    cut = F.floor(F.col("_n") / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.col("_n").cast("int") - cut), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut))
    both = joined.withColumn("_edited", edited).withColumn("_sha", F.sha2("_edited", 256))
    keys = ["_bucket", "_rank", "_extra", "_key", "_n", "_sha"]
    each = both.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t")))).alias("_v"))
    voted = vote(each.select(*keys, F.col("_v.k").alias("_k"), F.col("_v.t").alias("_t")), [*keys, "_k"], pair_terms(F.col("_t")), out="_f", ties=True)
    wide = voted.groupBy(*keys).agg(F.max(F.when(F.col("_k") == 0, F.col("_f"))).alias("fingerprint"), F.max(F.when(F.col("_k") == 1, F.col("_f"))).alias("edited_fingerprint"))
    after = wide.withColumn("_f", F.lead("fingerprint", 1).over(W.partitionBy("_bucket").orderBy("_rank")))
    return after.where(~F.col("_extra")).select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_f")).alias("near_next"),
    )


def within(queries: DataFrame, corpus: DataFrame, *, radius: int = 3, blocks: int = 6, fingerprint: str = "fingerprint") -> DataFrame:
    """All pairs (query, found, distance) of distinct fingerprints of the two tables that differ in at most `radius` bits.

    Each of C(blocks, radius) tables keys a fingerprint by the bits outside one choice of `radius` blocks; equal keys are candidates.
    Work on distinct fingerprints, so that copies meet once; nulls are left out.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for left_out in combinations(range(blocks), radius):
        mask = sum(1 << b for i in range(blocks) if i not in left_out for b in range(edges[i], edges[i + 1]))
        masks.append(_signed(mask))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col(fingerprint).alias(name)).where(F.col(name).isNotNull()).distinct()
        tables = F.array(*[F.struct(F.lit(i).alias("i"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
        return one.select(name, F.explode(tables).alias("t")).select(name, F.col("t.i").alias("i"), F.col("t.key").alias("key"))

    met = keyed(queries, "query").join(keyed(corpus, "found"), ["i", "key"]).where(distance(F.col("query"), F.col("found")) <= radius)
    return met.select("query", "found", distance(F.col("query"), F.col("found")).alias("distance")).distinct()
