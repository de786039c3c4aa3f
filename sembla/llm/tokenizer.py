"""Token ids of a public byte-level BPE tokenizer for a whole corpus, in two tiers.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is
a token as a whole. Tier two: the rest is merged by a heap over linked bytes,
O(n log n) for a pre-token of n bytes.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.session import map_arrow

#: Where the vocabulary files lie, unless a path is given.
TOKENIZERS = os.environ.get("SEMBLA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published split pattern of the byte_bpe vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a Python worker remembers, and the longest of them in characters.
CACHE, CACHED_LENGTH = 200_000, 64
#: Longer texts (characters) are split and resolved bit by bit.
LONG = 1_000_000


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one probe, exact comparison.

    A key's bucket has a displacement that sends all keys of the bucket to free
    slots; buckets of one key store their slot itself.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        h = self._hash(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        slot_of = np.zeros(n, np.int64)
        sizes = np.diff(starts)
        free: list[int] = []
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[starts[b] : starts[b + 1]]
            if len(mine) == 0:
                break
            if len(mine) == 1:
                if not free:
                    free = np.flatnonzero(~taken)[::-1].tolist()
                slot = free.pop()
                taken[slot] = True
                slot_of[mine[0]] = slot
                shift[b] = -slot - 1
                continue
            d = 0
            while True:
                d += 1
                slots = self._slot(h[mine], np.full(len(mine), d))
                if not taken[slots].any() and len(set(slots.tolist())) == len(mine):
                    break
            taken[slots] = True
            slot_of[mine] = slots
            shift[b] = d
        self.shift = shift
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int32)
        for k, key, value in zip(slot_of.tolist(), keys, values):
            self.keys[k] = key
            self.values[k] = value

    @staticmethod
    def _hash(keys: Iterable[bytes]) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(k) for k in keys), np.uint64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(29)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key, -1 for keys that aren't there."""
        if not keys:
            return np.zeros(0, np.int32)
        h = self._hash(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._slot(h, np.abs(d)))
        stored = self.keys
        same = np.fromiter((stored[s] == k for s, k in zip(slot.tolist(), keys)), bool, len(keys))
        return np.where(same, self.values[slot], -1).astype(np.int32)


def _merge(ids: list[int], pairs: dict[tuple[int, int], int], limit: int = 2**31) -> list[int]:
    """Merges the lowest-ranked neighbouring pair, leftmost first, until none is left (or none under limit)."""
    n = len(ids)
    if n < 2:
        return ids
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]), limit)) < limit]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        # a link that has changed since it was put on the heap is void
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = r, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (x := pairs.get((r, ids[k]), limit)) < limit:
                heapq.heappush(heap, (x, i, r, ids[k]))
        p = before[i]
        if p >= 0 and (x := pairs.get((ids[p], r), limit)) < limit:
            heapq.heappush(heap, (x, p, ids[p], r))
    return [x for x in ids if x >= 0]


class BytePairEncoder:
    """Both tiers for one vocabulary of ranks; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern = pattern
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        whole: list[bytes] = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                whole.append(token)
                continue
            parts = _merge([self.byte_id[b] for b in token], self.pairs, rank)
            if len(parts) == 2:
                self.pairs[parts[0], parts[1]] = rank
                whole.append(token)
        # a token that its own merges don't give is not taken as a whole
        whole = [t for t in whole if len(t) == 1 or _merge([self.byte_id[b] for b in t], self.pairs) == [ranks[t]]]
        self.whole = PerfectHash(whole, [ranks[t] for t in whole])
        self._known: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_split": None}

    def resolve(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        raw = [p.encode() for p in pieces]
        found = self.whole.find(raw).tolist()
        byte_id, pairs = self.byte_id, self.pairs
        return [[f] if f >= 0 else _merge([byte_id[b] for b in r], pairs) for f, r in zip(found, raw)]

    def _encode_long(self, text: str) -> list[int]:
        ids: list[int] = []
        some: list[str] = []
        for m in self._split.finditer(text):
            some.append(m[0])
            if len(some) >= 50_000:
                ids += [x for row in self.resolve(some) for x in row]
                some = []
        return ids + [x for row in self.resolve(some) for x in row]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; none for an empty or missing one."""
        split = self.__dict__.get("_split") or regex.compile(self.pattern)
        self._split = split
        if any(t and len(t) > LONG for t in texts):
            return [self._encode_long(t) if t and len(t) > LONG else self.encode([t])[0] for t in texts]
        pieces = [split.findall(t) if t else [] for t in texts]
        if len(self._known) > CACHE:
            self._known.clear()
        known = self._known
        new = list({p for row in pieces for p in row if p not in known})
        here = dict(zip(new, self.resolve(new)))
        known.update((p, ids) for p, ids in here.items() if len(p) <= CACHED_LENGTH)
        out = []
        for row in pieces:
            ids: list[int] = []
            for p in row:
                ids += known.get(p) or here[p]
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def load_encoder(path: str | None = None) -> BytePairEncoder:
    """The encoder of a .tiktoken rank file (default: byte_bpe_50k in TOKENIZERS)."""
    with open(path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        rows = (line.split() for line in f if line.strip())
        return BytePairEncoder({base64.b64decode(a): int(b) for a, b in rows})


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """Columns key and ids (array<int>): the token ids of each text, without special tokens.

    A narrow map over the rows, no shuffle. The encoder is read on the driver
    (a vocabulary of fixed size, about 2 MB) and broadcast.

    Edge cases: an empty and a null text give an empty list; strings that look
    like special tokens are ordinary text; texts and pre-tokens may have any
    length; repeated rows give a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_encoder(vocabulary))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = encoder.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                flat = np.fromiter((x for r in rows for x in r), np.int32, int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["k", "ids"])

    out = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).transform(map_arrow, run, f"k {kind}, ids array<int>")
    return out.select(F.col("k").alias(key), F.col("ids").alias(ids))
