"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

A window is one lower-cased word between two runs of common text, spread to two bytes a letter so that a match costs less than its
letters. Each window is compressed with two dictionaries: both end with the same dictionary, trained on whole ordinary documents; one
begins with a dictionary trained on those words of toxic documents that hold a fragment (six bytes) which toxic documents have far more
often, the other one with a dictionary trained on the less frequent words of ordinary documents. The difference of the two lengths is how
much nearer the window is to toxic text: whole words, stems and endings match alike, as far as they match. Windows whose difference reaches
a threshold are hits, for two thresholds; a logistic curve over their shares and numbers, calibrated on labelled rows that trained no
dictionary, gives the score. The thresholds are chosen there too.

Lengths depend on the word alone, so each worker remembers them, up to a bound.

Defined results: null and empty texts have no window and get the score of a text without hits; very long texts are scored whole; nulls
among labels are left out, and a key with both labels counts as toxic; without rows of both labels every score is the share of label 1 (0
without labels); repeated rows and other columns are carried along, but an input column named like the output is replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Windows a worker remembers; the memory is emptied beyond it.
REMEMBERED = 800_000
LEVELS = {"strategy": zstandard.STRATEGY_BTULTRA2, "window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 7, "min_match": 4, "target_length": 128}


def spread(text: bytes) -> bytes:
    """Each byte as two, by two fixed permutations of the byte values."""
    out = bytearray(2 * len(text))
    out[0::2], out[1::2] = text.translate(CODES[0]), text.translate(CODES[1])
    return bytes(out)


def _permutation(seed: int) -> bytes:
    values = list(range(256))
    random.Random(seed).shuffle(values)
    return bytes(values)


CODES = [_permutation(k) for k in range(2)]


@dataclass
class Model:
    toxic: bytes  #: dictionary before the common one
    ordinary: bytes
    common: bytes
    thresholds: tuple[int, int]
    weights: list[float]  #: of 1 and, for each threshold, the share of hits and the logarithm of 1 + hits; one number: a constant score

    def __post_init__(self) -> None:
        self.lengths: dict[bytes, int] = {}
        if len(self.weights) > 1:
            self.near, self.far = (_compressor(spread(own + self.common)) for own in (self.toxic, self.ordinary))
            self.before, self.after = spread(self.common[-12:] + b" "), spread(b" " + self.common[-64:-56])

    def difference(self, word: bytes) -> int:
        """Length with the ordinary dictionary less the length with the toxic one."""
        found = self.lengths.get(word)
        if found is None:
            window = self.before + spread(word) + self.after
            found = self.lengths[word] = len(self.far.compress(window)) - len(self.near.compress(window))
        return found

    def differences(self, text: str | None) -> list[int]:
        if len(self.lengths) > REMEMBERED:
            self.lengths.clear()
        known, out = self.lengths, []
        for word in (text or "").lower().encode("utf-8", "replace").split():
            found = known.get(word)
            out.append(self.difference(word) if found is None else found)
        return out

    def score(self, text: str | None) -> float:
        if len(self.weights) == 1:
            return self.weights[0]
        found = self.differences(text)
        return float(_logistic(np.array(_features(found, self.thresholds)) @ np.array(self.weights)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(**LEVELS, write_content_size=0, write_checksum=0, write_dict_id=0)
    raw.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=how)


def _features(found: list[int], thresholds: tuple[int, int]) -> list[float]:
    out = [1.0]
    for threshold in thresholds:
        hits = sum([d >= threshold for d in found])
        out += [min(10.0, 100.0 * hits / max(1, len(found))), math.log1p(hits)]
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(rows.shape[1])
    for _ in range(30):
        p = _logistic(rows @ w)
        g = rows.T @ (weight * (y - p)) - 1e-2 * w
        h = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained on all of the samples; samples that fit in it whole are one without training."""
    samples = [s for s in samples if len(s) >= 8]
    if sum(map(len, samples)) <= size:
        return b" ".join(dict.fromkeys(samples))
    random.Random(len(samples)).shuffle(samples)  # the trainer takes its pieces from the samples' beginning to their end
    return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()


def _fragments(word: bytes, n: int = 6) -> set[bytes]:
    """The runs of n bytes of a word between spaces; a shorter word is one run."""
    held = b" " + word + b" "
    return {held[i : i + n] for i in range(max(1, len(held) - n + 1))}


class _Marks:
    """Which words of a text hold a fragment that toxic documents have more often, by a likelihood ratio that chance among so many does not reach.

    Fragments, not words: a stem with many endings is seen as one.
    """

    def __init__(self, taught: list[tuple[list[bytes], int]], strictness: float):
        fragments = lambda w: set().union(*map(_fragments, set(w)))
        toxic = Counter(x for w, y in taught if y for x in fragments(w))
        ordinary = Counter(x for w, y in taught if not y for x in fragments(w) if x in toxic)
        n = [sum(y == k for _, y in taught) for k in (0, 1)]
        least = strictness * math.log(len(toxic) + 10)
        term = lambda k, e: k * math.log(k / e) if k else 0.0
        self.found = set()
        self.known: dict[bytes, bool] = {}
        for fragment, a in toxic.items():
            b = ordinary[fragment]
            if a * n[0] > 3 * b * n[1]:
                rate = (a + b) / (n[0] + n[1])
                ratio = 2 * (term(a, n[1] * rate) + term(b, n[0] * rate) + term(n[1] - a, n[1] * (1 - rate)) + term(n[0] - b, n[0] * (1 - rate)))
                if ratio >= least:
                    self.found.add(fragment)

    def __contains__(self, word: bytes) -> bool:
        if word not in self.known:
            self.known[word] = not self.found.isdisjoint(_fragments(word))
        return self.known[word]


def learn(rows: list[tuple[str | None, int, int]], share: float, *, size: int = 4_096, strictness: float = 6.0) -> Model:
    """The model of rows (text, label, fold): folds 0 and 1 train the dictionaries, fold 2 calibrates; share is label 1's among all."""
    texts = [((t or "").lower().encode("utf-8", "replace").split(), y, fold) for t, y, fold in rows]
    if len({y for _, y, _ in texts}) < 2:
        return Model(b"", b"", b"", (0, 0), [float(share)])
    taught = [(w, y) for w, y, fold in texts if fold < 2]
    taught = taught if len({y for _, y in taught}) == 2 else [(w, y) for w, y, _ in texts]
    marks = _Marks(taught, strictness)
    ordinary = [w for w, y in taught if not y]
    seen = Counter(x for w in ordinary for x in set(w))
    common = _dictionary(size, [b" ".join(w[i : i + 8]) for w in ordinary for i in range(0, len(w), 8)])
    toxic = _dictionary(size, [b" ".join(x for x in w if x in marks) for w, y in taught if y])
    rare = _dictionary(size, [b" ".join(x for x in w if 3 <= seen[x] <= len(ordinary) // 10) for w in ordinary])
    model = Model(toxic, rare, common or b" ", (0, 0), [0.0] * 5)
    held = [(w, y) for w, y, fold in texts if fold == 2]
    held = held if len({y for _, y in held}) == 2 else [(w, y) for w, y, _ in texts]
    found = [[model.difference(x) for x in w] for w, _ in held]
    y = np.array([y for _, y in held])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    best = None
    for thresholds in [(low, high) for low in range(2, 7) for high in range(low + 1, 13, 2)]:
        rows_seen = np.array([_features(d, thresholds) for d in found])
        w = _fit(rows_seen, y, weight)
        p = np.clip(_logistic(rows_seen @ w), 1e-6, 1 - 1e-6)
        loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()
        if best is None or loss < best[0]:
            best = (loss, thresholds, w.tolist())
    model.thresholds, model.weights = best[1], best[2]
    return model


def train(
    documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", allowed: Column | None = None,
    rows_a_label: int = 4_000, longest: int = 200_000, chars_a_label: int = 40_000_000,
) -> Model:
    """The model of labelled documents.

    At most `rows_a_label` rows of each label are read, those with the smallest hash of their key, of these none with more than
    `longest` characters, and in the same order no more than `chars_a_label` characters: this bounds the driver's memory, whatever
    the input. `allowed` says which keys' labels may be used.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if allowed is None else allowed))
    known = known.groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    shares = known.groupBy("_y").count().collect()
    total = sum(r["count"] for r in shares)
    share = sum(r["count"] for r in shares if r["_y"] == 1) / total if total else 0.0
    picked, order = None, F.xxhash64(F.lit(23), "_k")
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(order, "_k").limit(rows_a_label)
        picked = part if picked is None else picked.union(part)
    met = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(picked), "_k").withColumn("_n", F.coalesce(F.length("_t"), F.lit(0)))
    upto = F.sum("_n").over(W.partitionBy("_y").orderBy(order, "_k", "_t").rowsBetween(W.unboundedPreceding, 0))
    met = met.where(F.col("_n") <= longest).withColumn("_upto", upto).where(F.col("_upto") <= chars_a_label)
    rows = met.select("_k", "_t", "_y", F.pmod(F.xxhash64(F.lit(29), "_k"), F.lit(3)).cast("int").alias("_f")).toArrow().sort_by([("_k", "ascending"), ("_t", "ascending")])
    return learn(list(zip(rows.column("_t").to_pylist(), rows.column("_y").to_pylist(), rows.column("_f").to_pylist(), strict=True)), share)


#: The models that this process has, with the lengths they remember.
_models: dict[tuple, Model] = {}


def _local(parts: tuple) -> Model:
    if parts not in _models:
        _models.clear()
        _models[parts] = Model(*parts[:-1], list(parts[-1]))
    return _models[parts]


def score(documents: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """documents with the score of each whole text, from 0 to 1. The model is three dictionaries of fixed size."""
    shared = documents.sparkSession.sparkContext.broadcast((model.toxic, model.ordinary, model.common, model.thresholds, tuple(model.weights)))
    fields = [f for f in documents.schema.fields if f.name != out]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = _local(shared.value)
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            scores = [local.score(t) for t in column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(scores, pa.float64())], names=[*names, out])

    return documents.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))
