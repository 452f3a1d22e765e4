"""Sampled-splitter sharding: range-partition rows by a hashed key into shards of near-equal bytes.

1. A size-weighted sample of composite keys is drawn (a row is taken with a
   probability in proportion to its size, decided by a hash, so a retry draws
   the same rows). Its expected size is ``per_range`` keys for each range.
2. Quantiles of the sorted sample are the splitters of many small ranges; there
   are ``MAX_RANGES`` at most, so that what the driver holds has a bound.
3. Rows are assigned to ranges by binary search; exact bytes and rows of each
   range are counted. Overfull ranges are subdivided by equal widths of the key
   and counted again, until none is overfull or its key can't be divided.
4. Offsets of the ranges and a running sum inside each give the exact place of
   each row in key order. Rows of more than 1 / ``BIG`` of a shard's mean bytes
   (``BIG`` times the shards at most) are dealt first, each to the emptiest
   shard; the others fill up what room is left, as runs of the key order. So
   shards differ from the mean by the size of a small row.

The key is (hash of the text, hash of the id and of a number that each row has of
its own): equal texts are neighbours, and a text, or a text and id, that a third
of all rows share is still split by the second part.

The law is ``bytes``; grown_shard is null. Null texts count 16 bytes; null ids are
ids like others. Very long texts are measured where they are read and not moved.
An empty table gives an empty result. Extra columns are carried along; where one
has the name of a result, the result's name gets underscores until it is free.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.common import Scratch, fresh

SHARDS = 40
#: Ranges at least, for each shard, and rows of a range to aim at.
RANGES_PER_SHARD, ROWS_PER_RANGE = 8, 250_000
#: Sampled keys for each range, and ranges at most: 24 * 16,384 keys of 16 bytes come to the driver.
PER_RANGE, MAX_RANGES = 24, 16_384
#: Rows of more than this part of a shard are dealt one by one.
BIG = 64


def place(h1: np.ndarray, h2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Splitters (b1, b2), sorted as pairs, that are <= each key (h1, h2)."""
    lo, hi = np.searchsorted(b1, h1, "left"), np.searchsorted(b1, h1, "right")
    out = lo.astype(np.int64)
    tied = np.flatnonzero(hi > lo)
    for v in np.unique(h1[tied]):
        rows = tied[h1[tied] == v]
        a, b = lo[rows[0]], hi[rows[0]]
        out[rows] = a + np.searchsorted(b2[a:b], h2[rows], "right")
    return out


def splitters(sample: np.ndarray, ranges: int) -> np.ndarray:
    """Quantile boundaries of sampled (h1, h2) keys: at most ranges - 1 distinct pairs, sorted."""
    if not len(sample):
        return sample.reshape(0, 2)
    sample = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    at = (np.arange(1, ranges) * len(sample)) // ranges
    return np.unique(sample[at], axis=0)


def subdivide(cuts: np.ndarray, rows: np.ndarray, limit: int) -> np.ndarray:
    """Splitters with equal-width ones added in ranges of more than ``limit`` rows; rows[i] is the count of range i."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    edges = [(low, low), *map(tuple, cuts.tolist()), (high, high)]
    more = []
    for i in np.flatnonzero(rows > limit):
        (a1, a2), (b1, b2) = edges[i], edges[i + 1]
        k = int(-(-int(rows[i]) // max(1, limit // 2)))
        for j in range(1, k):
            if b1 > a1 + 1:
                more.append((a1 + (b1 - a1) * j // k, low))
            else:
                more.append((a1, a2 + ((b2 if a1 == b1 else high) - a2) * j // k))
    return np.unique(np.concatenate([cuts.reshape(-1, 2), np.array(more, np.int64).reshape(-1, 2)]), axis=0)


def deal_big(sizes: list[int], shards: int) -> tuple[list[int], np.ndarray]:
    """Shard of each of a few large rows (sizes descending), to the emptiest first; bytes of each shard."""
    filled, to = np.zeros(shards, np.int64), []
    for x in sizes:
        to.append(int(filled.argmin()))
        filled[to[-1]] += x
    return to, filled


def rooms(filled: np.ndarray, rest: int) -> np.ndarray:
    """Bytes of small rows (``rest`` in all) that each shard takes so that all end up level, or as level as large rows allow."""
    level = np.sort(filled)
    total = np.cumsum(level)
    k = np.arange(1, len(level) + 1)
    heights = (rest + total) / k  # level if the k emptiest shards share the rest
    use = int(np.flatnonzero((heights >= level) & (heights <= np.append(level[1:], np.inf)))[0])
    return np.maximum(heights[use] - filled, 0.0)


def shard(df: DataFrame, size_col: str, key_cols: tuple[str, str], shards: int = SHARDS, per_range: int = PER_RANGE, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with two last columns, shard (int) and slot (long, gapless from 0 in each shard).

    key_cols: two long columns; rows that agree in the first are neighbours.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    columns = df.columns
    names = (fresh(df, "shard"), fresh(df, "slot"))
    # each row gets a number, fixed by writing it, which parts rows that are equal in all columns
    packed = df.select(F.struct("*").alias("row"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"), F.coalesce(F.col(key_cols[0]), F.lit(0)).cast("long").alias("k1"), F.xxhash64(key_cols[1], F.monotonically_increasing_id()).alias("k2"))
    rows = scratch.stage(packed, "keyed")
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    n, size = int(total["rows"]), int(total["bytes"] or 0)
    large = size // (BIG * shards) + 1
    # fewer than BIG * shards rows can be that large
    big = rows.where(F.col("size") > large).select("k1", "k2", "size").orderBy(F.desc("size"), "k1", "k2").collect()
    to, filled = deal_big([r["size"] for r in big], shards)
    room = rooms(filled, size - int(filled.sum()))
    ends = np.cumsum(room)
    small = rows.where(F.col("size") <= large)
    ranges = min(MAX_RANGES, max(RANGES_PER_SHARD * shards, -(-n // rows_per_range)))
    odds = F.col("size") * F.lit(float(per_range * ranges) / max(1, size))
    draw = F.pmod(F.xxhash64(F.lit(17), "k1", "k2"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cuts = splitters(small.where(draw < odds).select("k1", "k2").toPandas().to_numpy(np.int64), ranges)

    def ranged(cuts: np.ndarray) -> DataFrame:
        share = spark.sparkContext.broadcast((np.ascontiguousarray(cuts[:, 0]), np.ascontiguousarray(cuts[:, 1])))

        @F.pandas_udf("long")
        def range_of(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(place(a.to_numpy(np.int64), b.to_numpy(np.int64), *share.value))

        return small.withColumn("range", range_of("k1", "k2"))

    def counted(df: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
        by = df.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas()
        out = np.zeros((2, k), np.int64)
        out[0, by["range"]], out[1, by["range"]] = by["bytes"], by["rows"]
        return out[0], out[1]

    dealt = ranged(cuts)
    in_bytes, in_rows = counted(dealt, len(cuts) + 1)
    limit = max(64, 4 * -(-n // ranges))
    while (in_rows > limit).any():
        finer = subdivide(cuts, in_rows, limit)
        if len(finer) == len(cuts):
            break
        cuts = finer
        dealt = ranged(cuts)
        in_bytes, in_rows = counted(dealt, len(cuts) + 1)
    before = spark.sparkContext.broadcast((np.cumsum(in_bytes) - in_bytes, np.cumsum(in_rows) - in_rows, ends))

    @F.pandas_udf("struct<shard:int,rank:long>")
    def placed_at(r: pd.Series, so_far: pd.Series, size: pd.Series, number: pd.Series) -> pd.DataFrame:
        b, k, ends = before.value
        middle = b[r] + so_far.to_numpy() - size.to_numpy() / 2
        return pd.DataFrame({"shard": np.minimum(np.searchsorted(ends, middle, "right"), len(ends) - 1).astype(np.int32), "rank": k[r] + number.to_numpy() - 1})

    w = Window.partitionBy("range").orderBy("k1", "k2", "size")
    ordered = dealt.select("row", "size", "range", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.row_number().over(w).alias("number"))
    placed = scratch.stage(ordered.select("row", placed_at("range", "sum", "size", "number").alias("at")), "placed")
    # as many rows as there are shards
    first = {r["shard"]: (r["low"], r["rows"]) for r in placed.groupBy(F.col("at.shard").alias("shard")).agg(F.min("at.rank").alias("low"), F.count("*").alias("rows")).collect()}
    low = F.create_map(*(F.lit(x) for k in range(shards) for x in (k, first.get(k, (0, 0))[0])))
    out = placed.select("row", F.col("at.shard").alias("shard"), (F.col("at.rank") - low[F.col("at.shard")]).alias("slot"))
    if big:
        taken = {k: first.get(k, (0, 0))[1] for k in range(shards)}
        where = []
        for r, k in zip(big, to, strict=True):
            where.append((r["k1"], r["k2"], r["size"], k, taken[k]))
            taken[k] += 1
        table = spark.createDataFrame(where, "k1 long, k2 long, size long, shard int, slot long")
        out = out.union(rows.where(F.col("size") > large).join(F.broadcast(table), ["k1", "k2", "size"]).select("row", "shard", "slot"))
    return out.select(*(F.col("row")[c].alias(c) for c in columns), F.col("shard").alias(names[0]), F.col("slot").cast("long").alias(names[1]))


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(3), "doc_id").alias("h2"),
    )
    return shard(docs, "size", ("h1", "h2")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
