"""Substring dedup over a De Bruijn graph of word k-mers.

Each run of `window` consecutive words is an edge of the graph, from the run's first words to its last. An edge that starts in two
documents is repeated. Repeated edges are found in two steps. First, each run is represented by its least inner `anchor`-word hash, so
one of about four places is counted; anchors seen in one document only cannot lie in a repeated run. The repeated anchors go
into a bitmap (two bits each), which may let through too much and never too little; its size follows their number. Then the runs whose anchor is in the
bitmap are counted exactly. A join brings each repeated edge back to its places: places next to each other whose edges neither branch
in nor out (by a 32-bit sketch of their neighbouring words) compact to one path, and the path's source coordinates (the smallest document that has it, against the place's own)
decide whether its words go. Nothing is gathered by edge: hot edges meet in hash aggregations and a join that can be split; what is
gathered by document is bounded by that document.

Edges are compared by 64-bit hashes of their words' 64-bit hashes.

Defined results: a null text has no words; rows with a null key are kept whole and hide nothing; rows that share a key count as one
document, and places that go in one of them go in all; very long texts are read whole; other columns are carried along, but those named like an output are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.common import discard, release, stored, without
from chronoweave.llm.rolling import Powers, runs, slices, sliding_min, word_hashes

WINDOW, ANCHOR = 13, 6
#: Sizes of the bitmap of repeated anchors as powers of two (8 MiB to 128 MiB), and its places for each of them: one other anchor in 40 passes at most.
BITMAP_BITS, MOST_BITMAP_BITS, PLACES = 26, 30, 12


def bitmap_size(anchors: int) -> int:
    """The power of two that gives each repeated anchor PLACES bits; 90 million fill the largest, beyond which more pass."""
    return min(MOST_BITMAP_BITS, max(BITMAP_BITS, (PLACES * anchors - 1).bit_length()))


def _valid(owner: np.ndarray, width: int) -> np.ndarray:
    """Whether the run that starts at each place stays in one text."""
    return owner[: len(owner) - width + 1] == owner[width - 1 :]


def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(batch.column(0).is_valid())


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in slices(_keyed(batch), 1):
                hashed, owner, _ = word_hashes(part.column(1), powers)
                if len(hashed) < window:
                    continue
                least = sliding_min(runs(hashed, anchor), window - anchor + 1)
                ok = _valid(owner, window)
                least, owner = least[ok], owner[: len(ok)][ok]
                if not len(least):
                    continue
                fresh = np.ones(len(least), bool)
                fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                keys = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(least[fresh].view(np.int64)), pa.array(keys[owner[fresh]])], names=["h", "doc"])

    return run


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of the bitmap for each hash, as in _bitmap."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def _bitmap(repeated: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of repeated anchors as 64-bit words. At most 2^(bits - 6) words reach the driver."""
    at = F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1)))
    each = repeated.select(F.explode(at).alias("i"))
    packed = each.groupBy(F.shiftrightunsigned("i", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("set"))
    table = packed.toArrow()
    words = np.zeros(1 << max(0, bits - 6), np.int64)
    words[table.column("word").to_numpy()] = table.column("set").to_numpy()
    return words


def _edges(window: int, anchor: int, shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bitmap = Powers(), np.frombuffer(shared.value, np.int64)

        def marked(at: np.ndarray) -> np.ndarray:
            return (bitmap[at >> 6] >> (at & 63)) & 1 == 1

        for batch in batches:
            for part in slices(_keyed(batch), 1):
                hashed, owner, first = word_hashes(part.column(1), powers)
                if len(hashed) < window:
                    continue
                least = sliding_min(runs(hashed, anchor), window - anchor + 1)
                high, low = _bits(least, bits)
                at = np.flatnonzero(_valid(owner, window) & marked(high) & marked(low))
                if not len(at):
                    continue
                whole = runs(hashed, window)[at]
                none = np.uint64(0)
                of = owner[at]
                before = np.where(at > first[of], hashed[np.maximum(at - 1, 0)], none)
                after = np.where(at + window < first[of + 1], hashed[np.minimum(at + window, len(hashed) - 1)], none)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                one = np.uint64(1)
                near = (one << ((before >> np.uint64(59)) + np.uint64(32))) | (one << (after >> np.uint64(59)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole.view(np.int64)), pa.array(keys[of]), pa.array((at - first[of]).astype(np.int32)), pa.array(near.view(np.int64))],
                    names=["h", "doc", "pos", "near"],
                )

    return run


def repeated_spans(documents: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, bitmap_bits: int | None = None) -> DataFrame:
    """doc, start, end (word places, end exclusive) and source: paths of `doc` that a smaller document, `source`, also has."""
    spark = documents.sparkSession
    plain = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    anchors = plain.mapInArrow(_anchors(window, anchor), "h long, doc long")
    twice = anchors.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("h")
    twice = stored(twice, "anchors")
    bitmap_bits = bitmap_size(twice.count()) if bitmap_bits is None else bitmap_bits
    shared = spark.sparkContext.broadcast(_bitmap(twice, bitmap_bits).tobytes())
    discard(twice)
    places = plain.mapInArrow(_edges(window, anchor, shared, bitmap_bits), "h long, doc long, pos int, near long")
    release(spark)
    ends = [F.min("doc").alias("source"), F.max("doc").alias("_last"), F.bit_or("near").alias("near")]
    edges = places.groupBy("h").agg(*ends).where("source < _last")
    half = F.lit((1 << 32) - 1)
    joins, forks = (F.bit_count(x) > 1 for x in (F.shiftrightunsigned("near", 32), F.col("near").bitwiseAND(half)))
    edges = stored(edges.select("h", "source", (joins.cast("int") + 2 * forks.cast("int")).alias("turn")), "edges")
    release(spark)
    met = places.select("h", "doc", "pos").join(edges, "h").where("source < doc")
    later = met.select("doc", (F.col("pos").cast("long") * 4 + F.col("turn")).alias("_at"), "source")
    later = later.select("doc", "source", F.shiftright("_at", 2).cast("int").alias("pos"), (F.col("_at") % 2 == 1).alias("joins"), (F.shiftright("_at", 1) % 2 == 1).alias("forks"), "_at")
    along = W.partitionBy("doc").orderBy("_at")
    opens = F.coalesce((F.col("pos") != F.lag("pos").over(along) + 1) | F.col("joins") | F.lag("forks").over(along) | (F.col("source") != F.lag("source").over(along)), F.lit(True))
    paths = later.withColumn("_open", opens).withColumn("_path", F.sum(F.col("_open").cast("int")).over(along))
    return paths.groupBy("doc", "_path").agg(F.min("pos").alias("start"), (F.max("pos") + window).alias("end"), F.min("source").alias("source")).drop("_path")


def dedup(documents: DataFrame, *, key: str = "doc_id", text: str = "text", out: str = "kept", **how) -> DataFrame:
    """documents with `out` (the words that stay, joined by one space), n_words, n_removed and the spans that went; the key is a whole number."""
    if not isinstance(documents.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be a column of whole numbers: the smaller one keeps a passage")
    documents = without(documents, out, "n_words", "n_removed", "spans")
    spans = repeated_spans(documents, key=key, text=text, **how)
    listed = spans.groupBy(F.col("doc").alias("_doc")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "source"))).alias("spans"))
    listed = stored(listed, "spans")
    del spans
    release(documents.sparkSession)
    joined = documents.join(listed, F.col(key).cast("long") == F.col("_doc"), "left").drop("_doc")
    names = joined.columns
    fields = [*joined.schema.fields, T.StructField(out, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, by = names.index(text), names.index("spans")
        for batch in batches:
            for part in slices(batch, at, 2 << 20):
                kept, n_words, n_removed = [], [], []
                for raw, gone in zip(part.column(at).cast(pa.binary()).to_pylist(), part.column(by).to_pylist(), strict=True):
                    spoken = (raw or b"").split()
                    n_words.append(len(spoken))
                    if gone:
                        stays, upto = [], 0
                        for span in gone:
                            stays += spoken[upto : max(upto, span["start"])]
                            upto = max(upto, span["end"])
                        spoken = stays + spoken[upto:]
                    kept.append(b" ".join(spoken).decode("utf-8"))
                    n_removed.append(n_words[-1] - len(spoken))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[f.name for f in fields])

    return joined.mapInArrow(run, T.StructType(fields))
