"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked for inside long documents. Items are partitioned by
their number of word 5-shingles (up to 8, 16, 32, ...), and for each partition a
document is cut into overlapping windows of twice that many shingles, one every
partition size, so that an item's text, wherever it stands, lies within one
window of at most four times its size. In such a window an item that is
contained to ``CONTAINMENT`` has a Jaccard similarity of 0.17 or more, so one of
``HASHES`` min-hashes agrees with probability 0.998 (0.9999 for a whole copy).
Items of fewer than eight shingles would be a smaller part of their windows, so
documents with any one of their shingles are candidates instead, without loss.
Min-hashes of the windows come from those of blocks of eight, joined pairwise
for each next partition.

Candidates are verified exactly: the distinct shingles of the item that occur
anywhere in the document, over the item's. Shingles as in the Jaccard join:
A-Z lower-cased, whole texts; a text of fewer than five words is one shingle.

Distinct items are taken in blocks of about ``BLOCK_ITEMS`` and ``BLOCK_BYTES``
of text, so what is broadcast is bounded however many there are; a further block costs a further pass over the
documents. Null or empty texts and items match nothing. Rows that repeat an id
are searched one by one, and equal pairs are returned once. A document that ties
on the containment of several items is returned with each. Very long documents
are searched whole, as slices of their own. An empty table gives no pairs. Extra
columns are ignored by ``contained`` and kept by ``without``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import slices, utf8
from quarrylens.llm.kernels import Words, mix, shingle_sets

SHINGLE, HASHES, CONTAINMENT, BLOCK_ITEMS, BLOCK_BYTES = 5, 32, 0.75, 10_000, 32 << 20
_U = np.uint64
_A = mix(np.arange(1, HASHES + 1, dtype=_U)) | _U(1)
_B = mix(np.arange(101, HASHES + 101, dtype=_U))
_BITS = 18


def permuted(h: np.ndarray) -> np.ndarray:
    """HASHES x n: 32-bit values of n fingerprints under each hash function."""
    out = np.empty((HASHES, len(h)), np.uint32)
    for k in range(HASHES):
        out[k] = (h * _A[k] + _B[k]) >> _U(32)
    return out


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def exact_shingles(text: bytes) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


class Index:
    """Min-hashes of items, by partition of sizes."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.ids = np.array(ids, np.int64)
        self.sets = [exact_shingles(t) for t in raw]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        offs = np.cumsum([0, *map(len, raw)])
        h, cut = shingle_sets(Words(buf, offs, fold=True), SHINGLE) if len(buf) else (np.zeros(0, _U), np.zeros(len(raw) + 1, np.int64))
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        members: dict[int, list[int]] = {}
        short = []
        for i, n in enumerate(np.diff(cut)):
            if n >= 8:
                members.setdefault(1 << int(n - 1).bit_length(), []).append(i)
            elif n:
                short.append(i)
        key = np.concatenate([np.zeros(0, _U), *(h[cut[i] : cut[i + 1]] for i in short)])
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << _BITS, bool)
        seen[key >> _U(64 - _BITS)] = True
        #: Shingles of the items of fewer than eight.
        self.short = (seen, key[order], np.repeat(np.array(short, np.int64), np.diff(cut)[short] if short else 0)[order])
        for level, items in members.items():
            low = np.stack([permuted(h[cut[i] : cut[i + 1]]).min(axis=1) for i in items])
            seen = np.zeros((HASHES, 1 << _BITS), bool)
            key = []
            for k in range(HASHES):
                seen[k, low[:, k] >> np.uint32(32 - _BITS)] = True
                key.append((np.uint64(k) << _U(32)) | low[:, k].astype(_U))
            key, item = np.concatenate(key), np.tile(np.array(items), HASHES)
            order = np.argsort(key, kind="stable")
            self.levels[level] = (seen, key[order], item[order])

    def candidates(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) pairs of a slice that share a min-hash."""
        w = Words(raw, offs, fold=True)
        _, doc, h = w.grams(SHINGLE)
        short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
        if len(short):
            hs, cut = shingle_sets(w, SHINGLE)
            doc, h = np.append(doc, short), np.append(h, hs[cut[short]])
        if not len(h):
            return []
        found = []
        seen, key, item = self.short
        maybe = np.flatnonzero(seen[h >> _U(64 - _BITS)])
        a, b = np.searchsorted(key, h[maybe], "left"), np.searchsorted(key, h[maybe], "right")
        for m in np.flatnonzero(b > a):
            found += [(int(doc[maybe[m]]), int(x)) for x in item[a[m] : b[m]]]
        if not self.levels:
            return sorted(set(found))
        new_doc = np.append(True, doc[1:] != doc[:-1])
        at = np.arange(len(h)) - np.flatnonzero(new_doc)[np.cumsum(new_doc) - 1]
        start = np.flatnonzero(at % 8 == 0)
        low, owner, number = np.minimum.reduceat(permuted(h), start, axis=1), doc[start], at[start] // 8
        level = 8
        while True:
            if level in self.levels:
                seen, key, item = self.levels[level]
                window = low.copy()
                pair = np.flatnonzero(owner[1:] == owner[:-1])
                window[:, pair] = np.minimum(low[:, pair], low[:, pair + 1])
                for k in range(HASHES):
                    maybe = np.flatnonzero(seen[k][window[k] >> np.uint32(32 - _BITS)])
                    if len(maybe):
                        value = (_U(k << 32)) | window[k, maybe].astype(_U)
                        a, b = np.searchsorted(key, value, "left"), np.searchsorted(key, value, "right")
                        for m in np.flatnonzero(b > a):
                            found += [(int(owner[maybe[m]]), int(x)) for x in item[a[m] : b[m]]]
            if level >= max(self.levels):
                return sorted(set(found))
            start = np.flatnonzero(number % 2 == 0)
            low, owner, number = np.minimum.reduceat(low, start, axis=1), owner[start], number[start] // 2
            level *= 2


SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def indexes(items: DataFrame, block_items: int) -> Iterator[Broadcast]:
    """The index of each block of items."""
    spark = items.sparkSession
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    blocks = max(1, -(-size["rows"] // block_items), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Index([r["item_id"] for r in block], [r["text"] for r in block]))


def matches(x: Index, column: pa.Array, containment: float) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of the verified pairs of a batch's texts."""
    raw, offs = utf8(column)
    out = []
    for i, j in slices(offs):
        last, own = None, set()
        for d, item in x.candidates(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
            if d != last:
                last, own = d, exact_shingles(raw[offs[i + d] : offs[i + d + 1]].tobytes())
            shared = len(x.sets[item] & own)
            if shared >= containment * len(x.sets[item]):
                out.append((i + d, item, shared))
    return out


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per (doc_id, item_id) of which the document holds at least ``containment`` of the item's shingles."""
    texts = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    found = []
    for index in indexes(items, block_items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            for b in batches:
                out = [(d, int(x.ids[i]), len(x.sets[i]), n, n / len(x.sets[i])) for d, i, n in matches(x, b.column(0), containment)]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(1).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.float64())],
                        ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
                    )

        found.append(texts.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.union, found).distinct()


def without(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs whose text contains no item. Rows are filtered where they are read, by text: no id, no shuffle."""
    at, schema = docs.columns.index("text"), docs.schema
    for index in indexes(items, block_items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            for b in batches:
                keep = np.ones(len(b), bool)
                keep[[d for d, _, _ in matches(x, b.column(at), containment)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def op4_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], containment: float = CONTAINMENT) -> set[tuple[int, int, int, int]]:
    """All pairs, for tests: (doc, item, shingles of the item, shared)."""
    enc = lambda t: (t or "").encode("utf-8", "surrogatepass")
    sets = [(i, exact_shingles(enc(t))) for i, t in items]
    out = set()
    for d, t in docs:
        own = exact_shingles(enc(t))
        for i, s in sets:
            if s and len(s & own) >= containment * len(s):
                out.add((d, i, len(s), len(s & own)))
    return out


