"""What the two substring operators share: classes of equal texts, and anchors that occur again.

A window of w units can only repeat where its anchor repeats: the anchor is the
smallest fingerprint among the short runs inside the window, so equal windows
have equal anchors at equal places. Anchors are a few in a hundred units (words)
or a few in a thousand (bytes), so the search for repeats shuffles those and not
the windows; texts without a repeated anchor are not looked at again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import Scratch, slices, utf8

#: Stands for a null id where one is needed as a value.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null: empty), t1 and t2: two hashes of the text, which stand for it; carried: a struct of the columns to carry."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), *([F.struct(*carry).alias("carried")] if carry else []))


def text_classes(docs: DataFrame) -> DataFrame:
    """One row per text: t1, t2, rep (smallest id), copies, size (bytes). Combined before the shuffle."""
    return docs.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("size"))


def anchors(docs: DataFrame, choose: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """a (anchor fingerprint), t1, t2, pos of every chosen anchor.

    ``choose`` takes a slice's bytes and offsets and gives (text, position in it,
    fingerprint) of distinct anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(0))
            keys = [np.asarray(b.column(k)) for k in (1, 2)]
            for i, j in slices(offs):
                text, pos, h = choose(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(keys[0][i + text]), pa.array(keys[1][i + text]), pa.array(pos.astype(np.int32))],
                    ["a", "t1", "t2", "pos"],
                )

    return docs.select("text", "t1", "t2").mapInArrow(run, "a long, t1 long, t2 long, pos int")


def repeated(scratch: Scratch, found: DataFrame) -> DataFrame:
    """t1, t2, at: the places (pos, n) of a text's anchors that occur n >= 2 times in all.

    The counts are a table of their own: the join then shuffles both sides, and
    Spark can split an anchor that very many texts hold.
    """
    often = scratch.stage(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "often")
    return found.join(often, "a").groupBy("t1", "t2").agg(F.collect_set(F.struct("pos", "n")).alias("at"))


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [start, end) as maximal runs; touching ones are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.ones(len(s), bool)
    last[:-1] = new[1:]
    return s[new], e[last]
