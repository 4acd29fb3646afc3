"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Terms are hashed runs of three bytes and a few shapes (how much of a text repeats itself, in words and in pairs of words). Log counts are weighted by
inverse document frequency and projected on the leading singular vectors of a labelled sample. The sample's own vectors and labels
are broadcast; for every document exact cosine products with all of them are computed block by block, the nearest ones
vote, and votes are weighted by a power of the similarity.

Defined results: null and empty texts, which have no vector, get the share of label 1 in the sample, as does every text if there are
fewer than two labelled rows; very long texts are scored whole; nulls among labels are left out, and a key with both labels counts as
label 1; equally near neighbours are taken in the order of the sample; repeated rows and other columns are carried along, but an input
column named like the output is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERMS = 4096
SHAPES = 12


def term_counts(text: bytes) -> np.ndarray:
    """Hashed counts of a text's terms, the shapes last; all zero for a text without words."""
    out = np.zeros(TERMS + SHAPES, np.float32)
    words = text.split()
    if not words:
        return out
    padded = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.int32)
    if len(padded) > 2:
        keys = padded[:-2] * 40503 + padded[1:-1] * 2531 + padded[2:] * 157
        out[:TERMS] = np.bincount((keys ^ (keys >> 11)) & (TERMS - 1), minlength=TERMS)
    pairs = list(zip(words, words[1:]))
    for k, x in enumerate((len(set(words)) / len(words), len(set(pairs)) / max(1, len(pairs)) if pairs else 1.0)):
        repeated = 1.0 - x
        for j, edge in enumerate((0.05, 0.15, 0.3, 0.45, 0.6, 0.8)):
            out[TERMS + 6 * k + j] = repeated > edge
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  #: terms x dimensions
    vectors: np.ndarray  #: labelled rows x dimensions, of length 1
    labels: np.ndarray
    share: float
    neighbours: int
    power: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Latent vectors of length 1 of rows of counts; zero rows stay zero."""
        weighted = np.log1p(counts[:, :TERMS]) * self.idf[:TERMS]
        weighted /= np.maximum(1e-9, np.sqrt((weighted * weighted).sum(1, keepdims=True)))
        latent = weighted @ self.basis[:TERMS] + (counts[:, TERMS:] * self.idf[TERMS:]) @ self.basis[TERMS:]
        return latent / np.maximum(1e-9, np.sqrt((latent * latent).sum(1, keepdims=True)))

    def scores(self, texts: list[bytes | None], rows: int = 256, block: int = 2_048) -> np.ndarray:
        """The share of label 1 among each text's nearest neighbours, weighted by similarity."""
        out = np.full(len(texts), self.share)
        if len(self.vectors) < 2:
            return out
        k = min(self.neighbours, len(self.vectors))
        for start in range(0, len(texts), rows):
            counts = np.stack([term_counts(t or b"") for t in texts[start : start + rows]])
            spoken = np.flatnonzero(counts.any(1))
            if not len(spoken):
                continue
            latent = self.project(counts[spoken])
            near, voted = np.zeros((len(spoken), 0), np.float32), np.zeros((len(spoken), 0), np.float32)
            for b in range(0, len(self.vectors), block):
                near = np.concatenate([near, latent @ self.vectors[b : b + block].T], 1)
                voted = np.concatenate([voted, np.broadcast_to(self.labels[b : b + block], (len(spoken), len(self.labels[b : b + block])))], 1)
                if near.shape[1] > k:
                    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    near, voted = np.take_along_axis(near, best, 1), np.take_along_axis(voted, best, 1)
            weight = np.maximum(near, 1e-6).astype(np.float64) ** self.power
            out[start + spoken] = (weight * voted).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def learn(rows: list[tuple[bytes | None, int]], *, dimensions: int = 64, neighbours: int = 15, power: float = 8.0, seed: int = 7) -> Model:
    """The model of rows (text, label): randomised singular vectors of their weighted terms."""
    counts = np.stack([term_counts(t or b"") for t, _ in rows]) if rows else np.zeros((0, TERMS + SHAPES), np.float32)
    y = np.array([y for _, y in rows], np.float32)
    share = float(y.mean()) if len(y) else 0.0
    full = counts.any(1)
    counts, y = counts[full], y[full]
    if len(y) < 2:
        return Model(np.ones(TERMS + SHAPES, np.float32), np.zeros((TERMS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), y, share, neighbours, power)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
    idf[TERMS:] = 0.5
    model = Model(idf, np.eye(TERMS + SHAPES, dtype=np.float32), np.zeros((0, 1), np.float32), y, share, neighbours, power)
    weighted = np.log1p(counts[:, :TERMS]) * idf[:TERMS]
    weighted /= np.maximum(1e-9, np.sqrt((weighted * weighted).sum(1, keepdims=True)))
    weighted = np.concatenate([weighted, counts[:, TERMS:] * idf[TERMS:]], 1)
    k = min(dimensions, *weighted.shape)
    probe = np.random.default_rng(seed).standard_normal((weighted.shape[1], k + 10)).astype(np.float32)
    span = weighted @ probe
    for _ in range(3):
        span, _ = np.linalg.qr(weighted @ (weighted.T @ span))
    _, _, right = np.linalg.svd(span.T @ weighted, full_matrices=False)
    model.basis = np.ascontiguousarray(right[:k].T)
    model.vectors = model.project(counts)
    return model


def train(
    documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", allowed: Column | None = None,
    sample_rows: int = 4_000, longest: int = 200_000, sample_chars: int = 80_000_000,
) -> Model:
    """The model of at most `sample_rows` labelled documents, those with the smallest hash of their key.

    Of these none with more than `longest` characters, and in the same order no more than `sample_chars` characters: this bounds what the
    driver holds and what is broadcast (one vector for each row). `allowed` says which keys' labels may be used.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if allowed is None else allowed))
    known = known.groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    order = F.xxhash64(F.lit(31), "_k")
    picked = known.orderBy(order, "_k").limit(sample_rows)
    met = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(picked), "_k").withColumn("_n", F.coalesce(F.length("_t"), F.lit(0)))
    upto = F.sum("_n").over(W.orderBy(order, "_k", "_t").rowsBetween(W.unboundedPreceding, 0))  # of the sample's rows only
    met = met.where(F.col("_n") <= longest).withColumn("_upto", upto).where(F.col("_upto") <= sample_chars)
    rows = met.select("_k", "_t", "_y").toArrow().sort_by([("_k", "ascending"), ("_t", "ascending")])
    return learn(list(zip(rows.column("_t").cast(pa.binary()).to_pylist(), rows.column("_y").to_pylist(), strict=True)))


def score(documents: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """documents with the score of each whole text, from 0 to 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in documents.schema.fields if f.name != out]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shared.value
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            scores = local.scores(column(text).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(scores, pa.float64())], names=[*names, out])

    return documents.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))
