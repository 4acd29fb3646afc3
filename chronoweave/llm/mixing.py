"""Mixing sources to target weights, in DataFrame functions only: temperature, bisection, budgeted block permutations.

A source's weight is its share of all tokens (words) raised to an exponent, normalised. The exponent is bisected until the weights'
entropy meets a target, or until no source is repeated more often than a limit allows. The budget, by default the least at which
every document is used once, gives each source its tokens: whole epochs, and of one more epoch a prefix of a permutation. A source with n
documents is cut into about sqrt(n) blocks by hash; an epoch visits the blocks in an order of its own, and the blocks' token sums show
which ones fit; inside the block where the budget ends, documents follow by hash while they fit. So only block sums
are ordered, never a source's rows, and what is broadcast holds at most sqrt(sources x documents) rows.

Limits: ValueError for more than MOST_SOURCES distinct sources, whose totals and plan the driver holds, and for targets that no exponent
meets. Tables of blocks are broadcast up to BROADCAST_ROWS rows; larger ones are joined.

Defined results: a null source is a source; very long texts count whole; a null text has no tokens; a source without tokens has weight 0 and its documents stay
once; documents that agree in key and text share their fate; an empty table gives no rows; other columns are carried along, but those named
epoch, block or draw are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import stored, without, words

MOST_SOURCES, BROADCAST_ROWS = 100_000, 1_000_000


@dataclass(frozen=True)
class Plan:
    source: str | None
    documents: int
    tokens: int
    weight: float
    epochs: int  #: whole passes
    rest: int  #: tokens of the pass that is cut short

    @property
    def blocks(self) -> int:
        return math.isqrt(max(0, self.documents - 1)) + 1


def weights(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to the exponent, normalised; a share of 0 stays 0."""
    raised = [s**exponent if s else 0.0 for s in shares]
    total = sum(raised)
    return [r / total if total else 0.0 for r in raised]


def entropy(probabilities: list[float]) -> float:
    """In nats."""
    return -sum(p * math.log(p) for p in probabilities if p)


def repetition(shares: list[float], chosen: list[float], budget_share: float | None) -> float:
    """The most passes over any source, for a budget in units of all tokens (None: the least that uses every source once)."""
    passes = [w / s for s, w in zip(shares, chosen, strict=True) if s]
    if not passes:
        return 0.0
    return max(passes) * (1 / min(passes) if budget_share is None else budget_share)


def exponent_for(shares: list[float], *, target_entropy: float | None = None, max_repetition: float | None = None, budget_share: float | None = None) -> float:
    """The exponent whose weights have the target entropy, else the smallest one of at most 1 that respects the limit; by bisection.

    Weights grow more even as the exponent falls: 0 makes them equal, above 1 they are sharper than the shares. ValueError if no
    exponent meets the target, or none the limit, or the one of the target not the limit.
    """
    some = [s for s in shares if s]
    if target_entropy is None and max_repetition is None:
        return 1.0
    if not some:
        return 0.0
    within = lambda x: max_repetition is None or repetition(shares, weights(shares, x), budget_share) <= max_repetition * (1 + 1e-9)
    if target_entropy is None:
        if not within(1.0):
            raise ValueError(f"no weights repeat every source {max_repetition} times at most: the budget is too large")
        return 0.0 if within(0.0) else _bisected(within, 0.0, 1.0)
    low_enough = lambda x: entropy(weights(shares, x)) <= target_entropy + 1e-12
    top, ties = max(some), sum(s == max(some) for s in some)
    if not math.log(ties) <= target_entropy <= math.log(len(some)) + 1e-9:
        raise ValueError(f"entropies of these sources are between {math.log(ties):.6g} and {math.log(len(some)):.6g}, not {target_entropy}")
    high = 1.0
    steepest = 700 / max(1e-12, math.log(top / min(some)) or 1.0)  # beyond it the smallest weights vanish in floating point
    while not low_enough(high) and high < steepest:
        high *= 2
    found = 0.0 if low_enough(0.0) else _bisected(low_enough, 0.0, high)
    if not within(found):
        raise ValueError(f"the weights of entropy {target_entropy} repeat a source more than {max_repetition} times")
    return found


def _bisected(right: Callable[[float], bool], low: float, high: float) -> float:
    """The smallest value from low, which is not right, to high, from which on all are."""
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if right(middle) else (middle, high)
    return high


def plan(totals: list[tuple], *, budget: int | None = None, target_entropy: float | None = None, max_repetition: float | None = 2.0) -> list[Plan]:
    """What each of the sources (source, documents, tokens) contributes."""
    every = sum(t for _, _, t in totals)
    shares = [t / every if every else 0.0 for _, _, t in totals]
    of_all = None if budget is None or not every else budget / every
    chosen = weights(shares, exponent_for(shares, target_entropy=target_entropy, max_repetition=max_repetition, budget_share=of_all))
    least = max((s / w for s, w in zip(shares, chosen, strict=True) if w), default=0.0)
    out = []
    for (source, documents, tokens), weight in zip(totals, chosen, strict=True):
        wanted = weight * (least * every if budget is None else budget)
        wanted = max(wanted, tokens) if budget is None else wanted
        epochs = int(wanted // tokens + 1e-9) if tokens else 1
        out.append(Plan(source, documents, tokens, weight, epochs, max(0, int(wanted - epochs * tokens + 0.5)) if tokens else 0))
    return out


def mix(documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, budget: int | None = None, target_entropy: float | None = None, max_repetition: float | None = 2.0) -> DataFrame:
    """documents, each as often as its source's budget asks, with `epoch`, `block` and `draw`.

    Ordering one epoch's rows by draw gives its permutation: blocks in random order, documents in random order inside.
    """
    spark, documents = documents.sparkSession, without(documents, "epoch", "block", "draw")
    spot = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    narrow = stored(documents.select(F.col(source).alias("_s"), spot.alias("_u"), F.size(words(F.col(text))).cast("long").alias("_t")), "mixing")
    totals = [tuple(r) for r in narrow.groupBy("_s").agg(F.count("*"), F.sum("_t")).limit(MOST_SOURCES + 1).collect()]
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    plans = plan(sorted(totals, key=lambda r: (r[0] is not None, r[0])), budget=budget, target_entropy=target_entropy, max_repetition=max_repetition)
    small = sum(p.blocks for p in plans if p.rest) <= BROADCAST_ROWS
    held = lambda df: F.broadcast(df) if small else df
    schema = "_p string, _blocks long, _epochs long, _rest long"
    table = spark.createDataFrame([(p.source, p.blocks, p.epochs, p.rest) for p in plans], schema)

    def planned(df: DataFrame, by: str) -> DataFrame:
        met = df.join(F.broadcast(table), F.col(by).eqNullSafe(F.col("_p")), "left").drop("_p")
        return met.withColumn("_b", F.pmod("_u", "_blocks"))

    of_block = planned(narrow, "_s").where("_rest > 0").groupBy("_s", "_b", "_epochs", "_rest").agg(F.sum("_t").alias("_t"))
    order = W.partitionBy("_s").orderBy(_draw(seed, F.col("_epochs"), F.col("_s"), F.col("_b")), "_b")
    ordered = of_block.withColumn("_upto", F.sum("_t").over(order))
    state = F.when(F.col("_upto") <= F.col("_rest"), F.lit(1)).when(F.col("_upto") - F.col("_t") < F.col("_rest"), F.lit(2))
    blocks = stored(ordered.select("_s", "_b", state.alias("_state"), (F.col("_rest") - F.col("_upto") + F.col("_t")).alias("_room")).where("_state is not null"), "blocks")
    last = planned(narrow, "_s").join(held(blocks.where("_state = 2").select(F.col("_s").alias("_q"), F.col("_b").alias("_c"), "_room")), F.col("_s").eqNullSafe(F.col("_q")) & (F.col("_b") == F.col("_c")))
    by_spot = last.groupBy("_s", "_u", "_room").agg(F.sum("_t").alias("_t")).withColumn("_upto", F.sum("_t").over(W.partitionBy("_s").orderBy("_u")))
    ends = by_spot.where("_upto <= _room").groupBy("_s").agg(F.max("_u").alias("_end"))
    cut = blocks.join(ends, blocks["_s"].eqNullSafe(ends["_s"]) & (blocks["_state"] == 2), "left").select(blocks["_s"].alias("_q"), F.col("_b").alias("_c"), "_state", "_end")
    placed = planned(documents.withColumn("_u", spot), source).join(held(cut), F.col(source).eqNullSafe(F.col("_q")) & (F.col("_b") == F.col("_c")), "left")
    fits = (F.coalesce("_state", F.lit(0)) == 1) | F.coalesce(F.col("_u") <= F.col("_end"), F.lit(False))
    copies = F.coalesce(F.col("_epochs"), F.lit(1)) + F.when(fits, F.lit(1)).otherwise(F.lit(0))
    spread = placed.withColumn("_n", copies).where("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    draw = F.struct(_draw(seed, F.col("epoch"), F.col(source), F.col("_b")).alias("block"), F.xxhash64(F.col("epoch"), F.col("_u")).alias("row"))
    return spread.select(*documents.columns, F.col("epoch").cast("int").alias("epoch"), F.col("_b").alias("block"), draw.alias("draw"))


def _draw(seed: int, epoch: Column, source: Column, block: Column) -> Column:
    """Where an epoch's permutation puts a block."""
    return F.xxhash64(F.lit(seed), epoch.cast("long"), source, block.cast("long"))
