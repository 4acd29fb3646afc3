"""Quality rules: a learned decision list over text statistics, as Spark expressions only.

Sequential covering. Each rule is a conjunction of thresholds on interpretable statistics. It is grown on two thirds
of the labelled rows, one condition at a time by FOIL gain, and pruned on the other third; rows it covers leave, and the next
rule is learned from the rest. Every step reads its counts from one Spark aggregation of binned statistics, so the driver
sees histograms, never rows. The list ends as one CASE expression over the documents' statistics.

Defined results: a null text has no words; an empty text fails the base rule; very long texts are measured whole; nulls among labels are
left out, and a key with both labels counts as the lower one; without rows of both labels no rule is learned and the base rule alone decides;
repeated rows are judged alike; an empty table gives no rows; other columns are carried along, but input columns named like the outputs
`stats` and `reason` are replaced by `judge` (`clean` returns the input's columns whatever their names).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import WORD, let, stored, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def repeated_words(spoken: Column, width: int = WINDOW) -> Column:
    """Number of words in windows of `width` words that occur twice or more among the words `spoken`.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Only arrays with a repeated window are sorted.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(ordered: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(ordered, a)["h"] == F.get(ordered, b)["h"], F.lit(False))
            hit = F.filter(F.transform(ordered, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"])), lambda i: i.isNotNull())
            return F.array_sort(hit)

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda i, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - i, F.lit(width))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, s: acc + s)

        return let(pairs, lambda ordered: let(repeated(ordered), length))

    def doubled(hashed: Column, done: int) -> Column:
        """Hashes of windows of `width` words from those of `done` words, a power of two below."""
        if done == width:
            whole = F.slice(hashed, 1, F.size(spoken) - (width - 1))
            return let(whole, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
        step = min(done, width - done)
        return let(F.transform(hashed, lambda h, i: F.xxhash64(h, F.get(hashed, i + step))), lambda longer: doubled(longer, done + step))

    hashes = F.transform(spoken, lambda w: F.xxhash64(w))
    return F.when(F.size(spoken) <= width, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: doubled(h, 1)))


def statistics(text: Column) -> Column:
    """A struct of counts and ratios of one text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(whole) - F.length(F.regexp_replace(whole, f"[{chars}]+", ""))

    def lines(split: Column) -> Column:
        return F.size(split) - F.size(F.array_distinct(split))

    spoken = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    of_words = let(
        words(whole),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        ),
    )
    counts = F.struct(
        of_words.alias("w"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        let(spoken, lambda s: F.struct(lines(s).cast("long").alias("dup"), F.size(s).cast("long").alias("n"))).alias("l"),
        without("A-Z").cast("long").alias("n_upper"),
        without("!?").cast("long").alias("n_shout"),
    )

    def named(c: Column) -> Column:
        n = F.greatest(c["w"]["n_words"], F.lit(1)).cast("double")
        chars = F.greatest(c["w"]["word_chars"], F.lit(1)).cast("double")
        return F.struct(
            c["w"]["n_words"].alias("n_words"),
            c["w"]["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["l"]["dup"].alias("n_dup_lines"),
            c["w"]["n_repeat_words"].alias("n_repeat_words"),
            (c["w"]["word_chars"] / n).alias("word_length"),
            (c["n_symbols"] / n).alias("symbols_a_word"),
            (c["l"]["dup"] / F.greatest(c["l"]["n"], F.lit(1))).alias("repeated_lines"),
            (c["w"]["n_repeat_words"] / n).alias("repeated_words"),
            (c["w"]["n_distinct"] / n).alias("distinct_words"),
            (c["n_upper"] / chars).alias("upper_case"),
            (c["n_shout"] / n).alias("shouts_a_word"),
        )

    return let(counts, named)


#: The statistics that rules may test.
FEATURES = ("word_length", "symbols_a_word", "repeated_lines", "repeated_words", "distinct_words", "upper_case", "shouts_a_word", "n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = stats[self.feature].cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self, stats: Column) -> Column:
        whole = F.lit(True)
        for c in self.conditions:
            whole = whole & c.column(stats)
        return whole

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def base_failed(stats: Column) -> Column:
    """Too short, or more than 30 of 100 words stand in repeated windows."""
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


def _histogram(rows: DataFrame, edges: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """Per feature and bin: rows to reject and rows to keep. A bin is the number of edges below the value."""

    def placed(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges[f])), lambda e: F.col(f) > e))

    bins = F.array(*[F.struct(F.lit(f).alias("f"), placed(f).alias("b")) for f in FEATURES if edges[f]])
    counted = rows.select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
    for f, b, p, n in counted.collect():
        out[f][b] = (p, n)
    return out


def _best(rows: DataFrame, edges: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition, int, int] | None:
    """The condition with the largest FOIL gain over rows that hold p0 to reject and n0 to keep."""
    best = None
    prior = math.log2((p0 + 1) / (p0 + n0 + 2))
    found = _histogram(rows, edges)
    for f in FEATURES:
        if not edges[f]:
            continue
        below_p = below_n = 0
        for i, edge in enumerate(edges[f]):
            p, n = found[f].get(i, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for above, (cp, cn) in ((False, (below_p, below_n)), (True, (p0 - below_p, n0 - below_n))):
                gain = cp * (math.log2((cp + 1) / (cp + cn + 2)) - prior)
                if cp and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(f, above, edge), cp, cn)
    return best


def _centred(rows: DataFrame, condition: Condition) -> Condition:
    """The condition with its threshold moved half way to the next value, which changes nothing for `rows` and most for new ones."""
    value = F.col(condition.feature)
    low, high = rows.agg(F.max(F.when(value <= condition.threshold, value)), F.min(F.when(value > condition.threshold, value))).first()
    return condition if low is None or high is None else Condition(condition.feature, condition.above, (low + high) / 2)


def _counts(rows: DataFrame, prefixes: list[Column]) -> list[tuple[int, int]]:
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    got = rows.agg(*[total(F.when(c, F.col("bad"))).alias(f"p{i}") for i, c in enumerate(prefixes)], *[total(F.when(c, 1 - F.col("bad"))).alias(f"n{i}") for i, c in enumerate(prefixes)]).first()
    return [(got[f"p{i}"], got[f"n{i}"]) for i in range(len(prefixes))]


def learn(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample_rows: int = 20_000, max_rules: int = 8, max_conditions: int = 3, thresholds: int = 24, min_precision: float = 0.9, min_covered: int = 3) -> list[Rule]:
    """The ordered rules that reject a document.

    `sample_rows` bounds the labelled rows that are read (those with the smallest hashes of their key); labels beyond it
    change nothing but the estimate's variance. Rows that the base rule settles teach nothing and are left out.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y"))
    picked = picked.orderBy(F.xxhash64(F.lit(17), "_k"), "_k").limit(sample_rows)
    joined = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(picked), "_k")
    stats = joined.select("_k", (F.col("_y") == 0).cast("int").alias("bad"), statistics(F.col("_t")).alias("s"))
    rows = stored(stats.repartition(8, "_k"), "quality-statistics").where(~base_failed(F.col("s")))
    rows = rows.select("bad", (F.pmod(F.xxhash64(F.lit(3), "_k"), F.lit(3)) == 0).alias("prune"), *[F.col(f"s.{f}").cast("double").alias(f) for f in FEATURES])
    quantiles = rows.select(*[F.percentile_approx(f, [i / thresholds for i in range(1, thresholds)], 10_000).alias(f) for f in FEATURES]).first()
    spread = rows.where("bad = 1").select(*[F.percentile_approx(f, [0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98], 10_000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted({float(v) for v in [*(quantiles[f] or []), *(spread[f] or [])]}) for f in FEATURES}
    stats_of = F.struct(*FEATURES)
    rules: list[Rule] = []
    left = rows
    for _ in range(max_rules):
        grow, prune = left.where(~F.col("prune")), left.where("prune")
        cover, conditions = grow, []
        (p, n), = _counts(cover, [F.lit(True)])
        if not p:
            break
        while n and len(conditions) < max_conditions:
            best = _best(cover, edges, p, n)
            if best is None or best[0] <= 0 or (best[2], best[3]) == (p, n):
                break
            p, n = best[2], best[3]
            conditions.append(_centred(cover, best[1]))
            cover = cover.where(conditions[-1].column(stats_of))
        if not conditions:
            break
        prefixes = [Rule(tuple(conditions[: i + 1])) for i in range(len(conditions))]
        on_prune = _counts(prune, [r.column(stats_of) for r in prefixes])
        on_grow = _counts(grow, [r.column(stats_of) for r in prefixes])
        value = lambda i: ((on_prune[i][0] - on_prune[i][1]) / max(1, sum(on_prune[i])), on_prune[i][0], -i)
        i = max(range(len(prefixes)), key=value)
        p, n = (a + b for a, b in zip(on_prune[i], on_grow[i], strict=True))
        if p + n < min_covered or p < min_precision * (p + n) or p <= n:
            break
        rules.append(prefixes[i])
        left = left.where(~prefixes[i].column(stats_of))
    return rules


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The name of the first rule that fires, as one CASE expression; null where none does."""
    chain = F.when(base_failed(stats), F.lit("base"))
    for rule in rules:
        chain = chain.when(rule.column(stats), F.lit(str(rule)))
    return chain


def judge(documents: DataFrame, rules: list[Rule], *, text: str = "text", stats: str = "stats", reason: str = "reason") -> DataFrame:
    """documents with their statistics and the rule that rejects them (null: kept)."""
    measured = documents.withColumn(stats, statistics(F.col(text)))
    return measured.withColumn(reason, verdict(rules, F.col(stats)))


def clean(documents: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    free = [next(f"{name}{i}" for i in range(len(documents.columns) + 1) if f"{name}{i}" not in documents.columns) for name in ("_stats", "_reason")]
    judged = judge(documents, rules, text=text, stats=free[0], reason=free[1])
    return judged.where(F.col(free[1]).isNull()).select(documents.columns)
