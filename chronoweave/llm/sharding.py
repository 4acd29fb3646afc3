"""Sharding by histogram sort: shards of near equal bytes, found by exact counts, then one exchange.

The sort key of a row is (h, g): 64-bit hashes of its text and of its row identity, both as unsigned numbers, 128 bits together. So equal
texts are neighbours. A probe is a key boundary, the start of a cell: all keys with the same first bits. Each round counts the exact
bytes of the cells in question across all partitions; a cell that lies across a shard's target boundary by more than the tolerance is cut into 2^BITS
finer ones, until every splitter is within tolerance of its target. At most one cell for each splitter is cut in a round, so the driver
holds 2^BITS counts for each shard, whatever the input. A splitter falls inside a group of equal texts only if the group is larger than the
tolerance. Every row's shard follows from comparing its key with the splitters.

For the slots each shard is dealt into cells of a bounded size by further bits of the key; large groups of equal texts are cut by the bits
of g. Counts of cells, summed up in order inside each shard, give each cell's first slot; rows meet them by a join on the cell, and move
once. No task holds a whole shard.

Defined results: a null text has size 1; very long texts are rows like any other; an empty table gives no rows; repeated rows each get a slot
of their own, and rows that agree in text and identity, which nothing tells apart, may take each other's and stay in one cell; null identities are
allowed; other columns are carried along, but input columns named size, shard or slot are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import discard, stored, without

BITS, WIDTH = 12, 128
#: Cells of which the table of first slots is broadcast; more are joined.
BROADCAST_CELLS = 500_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _top(x: Column, bits: int) -> Column:
    """The first bits of the long x as a number."""
    return F.shiftrightunsigned(x, 64 - bits) if bits else F.lit(0).cast("long")


def _within(cell: tuple[int, int]) -> Column:
    """Whether (h, g) lies in the cell (depth, its first bits as a number)."""
    depth, value = cell
    if depth <= 64:
        return _top(F.col("_h"), depth) == _signed(value)
    return (F.col("_h") == _signed(value >> (depth - 64))) & (_top(F.col("_g"), depth - 64) == _signed(value & ((1 << (depth - 64)) - 1)))


def _step(depth: int) -> int:
    """By how many bits a cell of this depth is cut; no cut spans h and g."""
    return min(BITS, (64 if depth < 64 else WIDTH) - depth)


def _counted(narrow: DataFrame, cells: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """Bytes, rows, least and largest h of each part of the cells that holds rows."""
    which, digit = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, cell in reversed(list(enumerate(cells))):
        depth, step = cell[0], _step(cell[0])
        part = F.shiftleft(F.col("_h"), depth) if depth < 64 else F.shiftleft(F.col("_g"), depth - 64)
        which, digit = F.when(_within(cell), F.lit(i)).otherwise(which), F.when(_within(cell), _top(part, step)).otherwise(digit)
    found = narrow.select(which.alias("i"), digit.alias("d"), "_h", "size").where("i is not null").groupBy("i", "d").agg(F.sum("size"), F.count("*"), F.min("_h"), F.max("_h"))
    out = {}
    for i, d, size, rows, low, high in found.collect():  # 2^BITS for each cell at most
        depth, value = cells[i]
        out[depth + _step(depth), value << _step(depth) | d] = (size, rows, low, high)
    return out


def splitters(narrow: DataFrame, shards: int, tolerance: float) -> tuple[list[int], int]:
    """The first key, of 128 bits, of each shard but the first, and the bytes of all rows of narrow (h, g, size)."""
    cells = _counted(narrow, [(0, 0)])
    total = sum(c[0] for c in cells.values())
    targets, slack = [total * k / shards for k in range(1, shards)], tolerance * total / shards
    start = lambda cell: cell[1] << (WIDTH - cell[0])
    while True:
        ordered, below, across = sorted(cells, key=start), 0, []
        cuts: list[tuple[float, int]] = [(0.0, 0)]  # bytes before a boundary, and its key
        for cell in ordered:
            size, rows, low, high = cells[cell]
            if any(below + slack < t < below + size - slack for t in targets) and cell[0] < WIDTH and rows > 1:
                across.append(cell)
            below += size
            cuts.append((below, start(cell) + (1 << (WIDTH - cell[0]))))
        if not across:
            return [min(cuts, key=lambda c: abs(c[0] - t))[1] for t in targets], total
        single = [c for c in across if cells[c][2] == cells[c][3] and c[0] < 64]  # one text: on to the bits of g
        for cell in single:
            found = cells.pop(cell)
            cells[64, found[2] % (1 << 64)] = found
        wanted = [c for c in across if c not in single]
        for cell in wanted:
            del cells[cell]
        cells |= _counted(narrow, wanted) if wanted else {}


def _shard(cuts: list[int]) -> Column:
    """How many of the cuts are at or below the key (h, g)."""
    flip = lambda x: x.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  unsigned order as signed order
    number = F.lit(0)
    for cut in cuts:
        if cut >> WIDTH:  # the end of all keys
            continue
        h, g = (F.lit(_signed((part ^ (1 << 63)) % (1 << 64))) for part in (cut >> 64, cut % (1 << 64)))
        number = number + F.when((flip(F.col("_h")) > h) | ((flip(F.col("_h")) == h) & (flip(F.col("_g")) >= g)), 1).otherwise(0)
    return number


def shard(documents: DataFrame, shards: int = 8, *, text: str = "text", identity: str = "doc_id", tolerance: float = 0.005, cell_bytes: int = 64 << 20, least_cells: int = 256) -> DataFrame:
    """documents with size, shard and slot.

    `tolerance` is the share of a shard's bytes by which a splitter may miss its target. A cell holds about `cell_bytes`, or 1/least_cells of
    all bytes if that is less, and a few times that at most, unless a single key holds more.
    """
    documents = without(documents, "size", "shard", "slot")
    h, g = F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit(""))), F.xxhash64(F.lit(2), F.col(identity))
    narrow = stored(documents.select(h.alias("_h"), g.alias("_g"), size_of(F.col(text)).alias("size")), "shard-keys")
    cuts, total = splitters(narrow, shards, tolerance)
    share = max(1.0, min(cell_bytes, total / least_cells))
    bits = min(40, max(0, math.ceil(math.log2(max(1.0, total / share)))))
    placed = narrow.select("_h", "_g", "size", _shard(cuts).alias("_shard"), _top(F.col("_h"), bits).alias("_c"))
    sizes = placed.groupBy("_shard", "_c").agg(F.sum("size").alias("_bytes"))
    large = stored(sizes.where(F.col("_bytes") > 4 * share).select("_shard", "_c", F.least(F.lit(40), F.ceil(F.log2(F.col("_bytes") / share))).cast("int").alias("_deep")), "large-cells")
    few = large.count() <= BROADCAST_CELLS
    deal = lambda df: df.join(F.broadcast(large) if few else large, ["_shard", "_c"], "left").withColumn("_d", F.coalesce(F.call_function("shiftrightunsigned", F.col("_g"), 64 - F.col("_deep")), F.lit(0).cast("long"))).drop("_deep")
    along = W.partitionBy("_shard").orderBy("_c", "_d").rowsBetween(W.unboundedPreceding, -1)  # cells, not rows
    counts = deal(placed).groupBy("_shard", "_c", "_d").agg(F.count("*").alias("_rows"))
    first = stored(counts.select("_shard", "_c", "_d", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_first")), "first-slots")
    few_cells = first.count() <= BROADCAST_CELLS
    discard(narrow)
    moved = documents.withColumn("size", size_of(F.col(text))).withColumns({"_h": h, "_g": g})
    moved = deal(moved.withColumns({"_shard": _shard(cuts), "_c": _top(F.col("_h"), bits)}))
    moved = moved.join(F.broadcast(first) if few_cells else first, ["_shard", "_c", "_d"])
    order = W.partitionBy("_shard", "_c", "_d").orderBy("_h", "_g")
    slotted = moved.withColumn("slot", F.col("_first") + F.row_number().over(order) - 1)
    return slotted.select(*documents.columns, "size", F.col("_shard").alias("shard"), "slot")
