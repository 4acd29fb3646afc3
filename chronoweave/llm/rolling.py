"""Hashes of words and of runs of words over batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xD1342543DE82EF95


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest batch needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(max(n, 1 << 16), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most `limit` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def word_hashes(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the texts in order: its hash and its text's index; and for each text the index of its first word."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    if high == low:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
    offsets = offsets - low
    inside = ~SEPARATOR[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edge] |= inside[edge]
    closes[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(STEP))
    owner = np.searchsorted(offsets, start, side="right") - 1
    return hashed, owner, np.searchsorted(start, offsets)


def runs(hashed: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` hashes; shorter than the input by width - 1."""
    n = max(0, len(hashed) - width + 1)
    total, factor = np.zeros(n, np.uint64), 1
    for j in range(width):
        factor = factor * STEP % (1 << 64)
        total += hashed[j : j + n] * np.uint64(factor)
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values; shorter than the input by width - 1."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step] if step else out, out[step:]) if len(out) > step else out[:0]
        done += step
    return out
