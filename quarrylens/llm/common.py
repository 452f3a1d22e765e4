"""Shared helpers: scratch tables in the shared folder, Arrow text access, connected components.

Nothing here depends on the size of the input: scratch tables live in the folder
that ``spark.checkpoint.dir`` names (so every executor sees them and a lost
executor only costs a re-read), and text is handed to numpy in slices of a few
megabytes whatever the Arrow batch size is.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy slice holds at most (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20


# --------------------------------------------------------------------------- scratch tables
def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables of one query run, below one folder of the shared checkpoint folder.

    ``stage`` writes a DataFrame as Parquet and reads it back, which cuts the
    lineage; ``drop`` deletes tables that are not needed any more. What the
    returned DataFrame still reads is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._quiet_drop_all)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _quiet_drop_all(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001  the JVM may be gone by then
            pass

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:02d}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := getattr(df, "_scratch_path", None):
                self._delete(path)

    def sweep(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished jobs now rather than at some later collection."""
        for _ in range(3):  # references from Python go first, then what they held
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)


# --------------------------------------------------------------------------- Arrow text
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key, rows) of each run of equal values of the first ``keys`` (integer) columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] | None = None
    for b in batches:
        cols = [np.asarray(b.column(k)) for k in range(keys)]
        change = np.zeros(len(b), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edge = [0, *np.flatnonzero(change).tolist(), len(b)]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if s == e:
                continue
            key = tuple(int(c[s]) for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of df has it (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(id_col: str, m: int):
    """crc32 of the id written as text, modulo m."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(m)


# --------------------------------------------------------------------------- connected components
def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternating large-star / small-star rounds on a distributed edge table. Each
    round takes a group-wise minimum (combined before the shuffle) and joins it
    back, so no neighbourhood is ever gathered in one task; the number of rounds
    grows with the logarithm of the longest path. The edge table of each round is
    written to the shared folder.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    cur = scratch.stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour is tied to the smallest of the neighbourhood
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: smaller neighbours and the node itself are tied to the smallest
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low2, "a")
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b"))).where("a <> b")
        new = scratch.stage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        # a fixed point is a forest of stars: no node is both a leaf and a centre, and each leaf has one centre
        now = new.agg(F.count("*").alias("n"), F.countDistinct("a").alias("k"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(cur)
        cur = new
        state = (now["n"], now["h"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not converge")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
