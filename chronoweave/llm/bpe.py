"""Byte-level BPE encoding and decoding of whole texts: speculate and verify.

A text is cut into words by the tokenizer's own pattern. For words not met before, greedy longest match proposes tokens;
numpy then tests every adjacent pair of all proposals at once. A sequence is what merging by rank gives if and only if each
adjacent pair is what merging its two tokens' bytes gives, which the merge tree answers without merging. Only words with a failing
pair are merged exactly. Results are remembered for each worker in a dictionary of bounded size.

Defined results: a null text counts as empty, an empty text has no tokens and decodes to ''; special tokens' strings in a text
become their ids; very long texts and words are encoded whole; an empty table gives no rows; repeated rows and other columns are carried along, but columns named like an output are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chronoweave.llm.common import without
from chronoweave.llm.rolling import slices

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that one worker remembers; the memory is emptied beyond it, so only time depends on it.
REMEMBERED = 250_000
#: Words of more bytes are merged with a heap.
SHORT = 96


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def vocabulary(document: str) -> dict:
    """Tokens as bytes, merges as pairs of ids and the special tokens of a tokenizer file's text.

    ValueError for a file whose words are cut or merged otherwise than here: the ids would be wrong.
    """
    spec = json.loads(document)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("not a plain byte-level BPE tokenizer: no normalizer, one ByteLevel pre-tokenizer without a prefix space")
    of = {c: b for b, c in enumerate(byte_letters())}
    ids = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in of for c in token)}
    name = spec["model"]["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    merges = [(name[a], name[b], name[a + b]) for a, b in pairs]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return {"ids": ids, "merges": merges, "special": special}


class Codec:
    """Encoder and decoder over one vocabulary; merged tokens are numbered in the order of their merges."""

    def __init__(self, vocab: dict, remembered: int = REMEMBERED):
        self.ids: dict[bytes, int] = vocab["ids"]
        self.order = {(a, b): k for k, (a, b, _) in enumerate(vocab["merges"])}
        self.made = [c for _, _, c in vocab["merges"]]
        self.special: dict[str, int] = vocab["special"]
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.left, self.right, self.rank = np.arange(size), np.arange(size), np.full(size, -1, np.int64)
        for k, (a, b, c) in enumerate(vocab["merges"]):
            if self.rank[c] < 0:
                self.left[c], self.right[c], self.rank[c] = a, b, k
        self.size = size
        keys = np.array([a * size + b for a, b, _ in vocab["merges"]], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int64)
        self.longest = max(map(len, self.ids))
        self.heads: dict[bytes, int] = {}
        for token in self.ids:
            self.heads[token[:2]] = max(self.heads.get(token[:2], 0), len(token))
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}
        self.remembered = remembered

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place, from the left."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        out, i, n, ids, heads = [], 0, len(word), self.ids, self.heads
        while i < n:
            end = i + min(n - i, heads.get(word[i : i + 2], 1))
            while (t := ids.get(word[i:end])) is None:
                end -= 1
            out.append(t)
            i = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a[i] and b[i] together gives just these two tokens.

        Undo the merges that closed the two tokens, the latest first. At each step the last part of the first token and the
        first part of the second stand side by side; if their own pair comes before the merge that was just undone,
        merging would have crossed the boundary. Of two overlapping pairs of one rank the left one is merged first.
        """
        none = np.iinfo(np.int64).max
        good = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), none)
        while len(at):
            key = a * self.size + b
            j = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[j] == key) & (self.pair_rank[j] < limit)
            good[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank, from the left, until none is left; time grows as n log n with the word."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        return self._merged_short(parts) if len(parts) <= SHORT else self._merged_long(parts)

    def _merged_short(self, parts: list[int]) -> list[int]:
        order, token, none = self.order, self.made, len(self.made)
        ranks = [order.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            parts[i : i + 2] = [token[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = order.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = order.get((parts[i], parts[i + 1]), none)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same by a heap of (rank, place) over a linked list; entries of pairs that are no more are skipped."""
        n, order, token = len(parts), self.order, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(order[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in order]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or order.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j], after[i] = token[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (found := order.get((parts[left], parts[after[left]]))) is not None:
                    heappush(heap, (found, left))
        return [t for t in parts if t >= 0]

    def learn(self, fresh: list[str]) -> None:
        """Encode words not met before and remember them."""
        if not fresh:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        proposed = [self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(proposed)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fails = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        for k in np.unique(owner[inner[fails]]):
            proposed[k] = self.merged(raw[k])
        for word, tokens in zip(fresh, proposed, strict=True):
            self.known[word] = tokens

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        if len(self.known) > self.remembered:
            self.known.clear()
        cut: list[list[str]] = []
        for text in texts:
            if self.marks and any(x in text for x in self.special):
                pieces = []
                for part in self.marks.split(text):
                    pieces += [part] if part in self.special else self.pattern.findall(part)
                cut.append(pieces)
            else:
                cut.append(self.pattern.findall(text))
        known = self.known
        for mark, i in self.special.items():
            known[mark] = [i]
        fresh = {w for words in cut for w in words if w not in known}
        self.learn(list(fresh))
        return [[t for w in words for t in known[w]] for words in cut]

    def decode(self, tokens: list[int]) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes
        return b"".join([table[t] for t in tokens]).decode("utf-8", "replace")


def encode(documents: DataFrame, vocab_text: str, *, text: str = "text", out: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """documents with the token ids of their text and the text that decoding the ids gives.

    `vocab_text` is the content of a tokenizer file; its fixed size bounds what is broadcast.
    """
    spark: SparkSession = documents.sparkSession
    documents = without(documents, out, decoded)
    shared = spark.sparkContext.broadcast(vocab_text)
    names = [f.name for f in documents.schema.fields]
    schema = T.StructType([*documents.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary(shared.value))
        at = names.index(text)
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                tokens = codec.encode([x or "" for x in part.column(at).to_pylist()])
                back = [codec.decode(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens, pa.list_(pa.int32())), pa.array(back, pa.string())], names=[*names, out, decoded])

    return documents.mapInArrow(run, schema)
