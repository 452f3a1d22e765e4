"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one vector with a weight. The signs of a vector's products with
random hyperplanes give a signature of ``b`` bits in each of ``L`` tables; b
grows with the logarithm of the number of vectors, so buckets stay small, and L
is such that a pair at the threshold meets in some table with probability
``RECALL``. Within a bucket all cosines are taken in double precision, by matrix
products; a pair counts in the first table where it meets, so nothing is counted
twice. A bucket gives each vector's number of links and a spanning forest of
its links, never the pairs themselves.

Buckets of more than ``BLOCK`` vectors are dealt into blocks by a hash, and each
pair of blocks is a task's unit, so hot buckets are spread and none is capped.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing and are kept; so do vectors of different dimensions. Rows that
repeat an id and vector count as copies of each other. Different vectors that
have the same smallest id are one node: each of its rows has the links of all of
them. Rows with a null id link with nothing, have a null component and are kept. An empty table gives no
rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import Scratch, components, units

THRESHOLD, RECALL, PER_BUCKET, BLOCK, SEED = 0.95, 0.999, 64, 256, 20240501


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a signature, tables) for n vectors."""
    bits = min(30, max(6, round(math.log2(max(1, n) / PER_BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def roots(adjacent: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(adjacent))
    while True:
        low = np.where(adjacent, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, sigs: np.ndarray, table: int, side: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links that each row gains by weight, edge ends a, edge ends b) of one unit.

    side tells the block of each row; cross: only pairs of different blocks are this unit's.
    """
    linked = (x @ x.T) >= threshold
    np.fill_diagonal(linked, False)
    if cross:
        linked &= side[:, None] != side[None, :]
    if linked.any():
        for t in range(table):
            linked &= sigs[:, t][:, None] != sigs[:, t][None, :]
    gain = linked @ weight
    if not gain.any():
        return gain, ids[:0], ids[:0]
    order = np.argsort(ids, kind="stable")
    root = np.empty(len(ids), np.int64)
    root[order] = order[roots(linked[np.ix_(order, order)])]
    away = np.flatnonzero(root != np.arange(len(ids)))
    return gain, ids[away], ids[root[away]]


def neardup(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    # float32 vectors travel as such; products are taken in double precision
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("e").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("e", lambda v: v != 0.0), F.lit(False))
    base = base.withColumn("ok", usable)
    classes = scratch.stage(base.where("ok").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    n = classes.count()
    bits, tables = plan(n, threshold)
    share = spark.sparkContext.broadcast((bits, tables))

    @F.pandas_udf("array<int>")
    def signature(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b, l = share.value  # noqa: E741
        planes: dict[int, np.ndarray] = {}
        for s in parts:
            out: list = [None] * len(s)
            dims = s.map(len).to_numpy()
            for d in np.unique(dims):
                if d not in planes:
                    planes[d] = np.random.default_rng(SEED).standard_normal((d, l * b))
                rows = np.flatnonzero(dims == d)
                x = np.stack(s.iloc[rows].tolist()).astype(np.float64)
                # scaled first, so that no product is lost to overflow or underflow
                x /= np.abs(x).max(axis=1, keepdims=True)
                signs = (x @ planes[d] >= 0).reshape(len(rows), l, b)
                value = signs @ (1 << np.arange(b))
                for r, v in zip(rows, value.astype(np.int32), strict=True):
                    out[r] = v
            yield pd.Series(out)

    signed = scratch.stage(classes.select("rep", "copies", "e", signature("e").alias("sigs")), "signed")
    keyed = signed.select("rep", F.size("e").alias("dim"), F.posexplode("sigs").alias("table", "sig"))
    buckets = scratch.stage(keyed.groupBy("dim", "table", "sig").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = signed.select("rep", "copies", "e", "sigs", F.size("e").alias("dim"), F.posexplode("sigs").alias("table", "sig")).join(buckets, ["dim", "table", "sig"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        met.withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "table", "sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "copies", "e", F.slice("sigs", 1, F.col("table")).alias("sigs"))
    )
    unit = ["dim", "table", "sig", "lo", "hi"]
    sorted_units = dealt.repartition(*unit).sortWithinPartitions(*unit)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in units(batches, len(unit)):
            if len(t) < 2:
                continue
            ids, weight, side = (np.asarray(t.column(k).combine_chunks()) for k in ("rep", "copies", "own"))
            x = np.asarray(t.column("e").combine_chunks().flatten()).reshape(len(ids), -1).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            sigs = np.asarray(t.column("sigs").combine_chunks().flatten()).reshape(len(ids), key[1])  # of the tables before
            gain, a, b = compare(ids, weight, x, sigs, key[1], side, key[3] != key[4], threshold)
            rows = np.flatnonzero(gain)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[rows], a])),
                    pa.array(np.concatenate([ids[rows], b])),
                    pa.array(np.concatenate([gain[rows].astype(np.int64), np.zeros(len(a), np.int64)])),
                ],
                ["a", "b", "links"],
            )

    found = scratch.stage(sorted_units.mapInArrow(solve, "a long, b long, links long"), "found")
    scratch.sweep()
    linked = components(scratch, found.where("a <> b"))
    counts = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    solved = (
        classes.join(counts, classes["rep"] == counts["a"], "left").join(linked, F.col("rep") == F.col("node"), "left")
        .select("e", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    rows = base.select("vec_id", F.when(F.col("ok"), F.col("e")).alias("e")).join(solved, "e", "left")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_hyperplane_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.m AS component_id, v.vec_id = c.m AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""
