"""Look-ups of corpus-wide values for what documents hold, without a row for each occurrence.

A posting row holds, for a slice of documents and one part of the key space, the
keys that these documents hold, the documents' numbers within the slice and how
often. Values are dealt by the same parts. A part's postings meet its values in
one task, which adds up the terms by document; the sums go back to the slice as
one row. The number of parts grows with the data, so a part stays of one size.
Very frequent keys are best resolved before (from a broadcast of fixed size), so
that no part holds far more postings than the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.kernels import mix

POSTINGS = "slice long, part int, docs binary, keys binary, times binary, tags binary"
SUMS = "slice long, docs binary, sums binary"
#: Keys, or postings, of a part.
PART_ROWS = 2_000_000


def parts_for(n: int, least: int) -> int:
    """Parts for n keys or postings."""
    return max(least, -(-n // PART_ROWS))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def part_column(key: str, parts: int) -> F.Column:
    """The same as ``part_of``, as a column over a table of keys (long)."""

    @F.pandas_udf("int")
    def part(k):
        return k.__class__(part_of(k.to_numpy(np.int64), parts))

    return part(F.col(key))


def postings(slice_id: int, docs: np.ndarray, keys: np.ndarray, times: np.ndarray, tags: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of POSTINGS for occurrences: document number, key (int64), times and a tag (uint8) of each."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    docs, keys, times, tags = docs[order].astype("<i4"), keys[order].astype("<i8"), times[order].astype("<u4"), tags[order].astype("u1")
    for p in np.flatnonzero(np.diff(edge)):
        s = slice(edge[p], edge[p + 1])
        yield slice_id, int(p), docs[s].tobytes(), keys[s].tobytes(), times[s].tobytes(), tags[s].tobytes()


def posting_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], POSTINGS.replace(",", "").split()[::2])


def sums_batch(slice_id: int, docs: np.ndarray, sums: np.ndarray) -> tuple[int, bytes, bytes]:
    """Row of SUMS; sums: documents x terms."""
    return slice_id, docs.astype("<i4").tobytes(), np.ascontiguousarray(sums, "<f8").tobytes()


def read_sums(rows: pa.Table, documents: int, terms: int) -> np.ndarray:
    """All SUMS rows of a slice added up: documents x terms."""
    out = np.zeros((documents, terms))
    for docs, sums in zip(rows.column("docs").to_pylist(), rows.column("sums").to_pylist(), strict=True):
        at = np.frombuffer(docs, "<i4")
        np.add.at(out, at, np.frombuffer(sums, "<f8").reshape(len(at), terms))
    return out


def totals(times: np.ndarray, docs: np.ndarray, values: np.ndarray, documents: int) -> np.ndarray:
    """documents x terms: values (postings x terms) times ``times``, by document."""
    return np.stack([np.bincount(docs, values[:, k] * times, documents) for k in range(values.shape[1])], 1)


def resolve(posted: DataFrame, values: DataFrame, columns: list[str], terms: Callable[[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """SUMS rows of all postings.

    values: part, key and ``columns`` (numbers), a row for each key. terms(found,
    values of the found ones' columns at each posting, keys, tags) gives postings x
    terms; at a posting whose key has no values, ``found`` is false and the values
    mean nothing.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        cols = [right.column(c).to_numpy()[order] for c in columns]
        out = []
        for b in left.to_batches():
            for sid, docs, key, times, tags in zip(*(b.column(c).to_pylist() for c in ("slice", "docs", "keys", "times", "tags")), strict=True):
                doc, k = np.frombuffer(docs, "<i4"), np.frombuffer(key, "<i8")
                at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
                found = keys[at] == k if len(keys) else np.zeros(len(k), bool)
                got = [c[at] if len(keys) else np.zeros(len(k), c.dtype) for c in cols]
                own, at_doc = np.unique(doc, return_inverse=True)
                value = terms(found, got, k, np.frombuffer(tags, "u1"))
                out.append(sums_batch(sid, own, totals(np.frombuffer(times, "<u4"), at_doc, value, len(own))))
        cols_out = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols_out, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slice", "docs", "sums"])

    return posted.groupBy("part").cogroup(values.select("part", "key", *columns).groupBy("part")).applyInArrow(meet, SUMS)
