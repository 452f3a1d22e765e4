"""Merkle manifest of a dataset: Pregel-style supersteps over 16-ary trees, one a source and one above them.

A row is a leaf; its digest is computed by built-in functions. Leaves are put in
order by a range sort; where a source reaches over several ranges, one summary
row of each range tells where it goes on, so no source is gathered anywhere.

Upward supersteps: each node messages its parent (key: tree, index / 16); a
parent that has all its children (16, or up to the child that is the last of its
level) hashes them and goes on as a node itself. A node that is the first and
the last of its level is the top of its tree. The tops of the sources are the
leaves of one more tree, whose top is the root. Reverse supersteps: the parent
sends one message to its run of children, which holds the sibling digests left
and right of each node on the way to the root; a run lives under one key, so a
path travels once for 16 children. At the leaves the siblings are hashed to the
proof, and the root is folded from the leaf (or from a tampered one).

A key has 16 values at most, however large a source is. Supersteps are RDD
shuffles whose lineage begins at a table in the shared folder.

Nulls in any field are written ``-``; a null source is a source of its own and
the first, a null doc_id comes first in its source and is never tampered with.
Rows that repeat a doc_id are ordered by their digests; equal rows are leaves of
their own. Empty and very long texts are leaves like others; an empty table has
no rows and no root. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import Scratch, crc_mod

FANOUT = 16
#: Leaves of a range at most, on the average; smaller inputs have as many ranges as shuffles have partitions.
RANGE_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


# --------------------------------------------------------------------------- leaves
def field(c: Column) -> Column:
    """``-`` for a null, else the byte count, a colon and the value."""
    raw = c.cast("string").cast("binary")
    return F.coalesce(F.concat(F.octet_length(raw).cast("string").cast("binary"), F.lit(b":"), raw), F.lit(b"-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and the tampered leaf (null where nothing is tampered with)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_digest(F.col("text")).alias("leaf"),
        F.when(crc_mod("doc_id", 5) == 0, leaf_digest(F.translate("text", UPPER, LOWER))).alias("tampered"),
    )


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with ord (which source of the range), pos (which row of it) and is_last (null in the last row of the range)."""
    held: pa.RecordBatch | None = None
    last, k, pos = None, -1, 0

    def out(b: pa.RecordBatch, following: str | None) -> pa.RecordBatch:
        nonlocal last, k, pos
        keys = np.array(b.column("key").to_pylist(), object)
        starts = np.append(keys[0] != last, keys[1:] != keys[:-1])
        ords = k + np.cumsum(starts)
        row = np.arange(len(keys))
        began = np.maximum.accumulate(np.where(starts, row, -1))
        poss = np.where(began < 0, pos + row, row - began)
        last, k, pos = keys[-1], int(ords[-1]), int(poss[-1]) + 1
        ends = [*starts[1:].tolist(), None if following is None else following != last]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(ords, pa.int64()), pa.array(poss, pa.int64()), pa.array(ends, pa.bool_())], [*b.schema.names, "ord", "pos", "is_last"])

    for b in batches:
        if not len(b):
            continue
        if held is not None:
            yield out(held, b.column("key")[0].as_py())
        held = b
    if held is not None:
        yield out(held, None)


def ordered(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int, bool]], int, int]:
    """Leaves in order (range, ord, pos), where each range goes on, the number of sources and of a source's leaves at most.

    A range's entry holds the number of the source that it begins with, the leaves
    of that source before it, and whether the source that it ends with ends there.
    """
    spark = docs.sparkSession
    plain = scratch.stage(leaves(docs), "leaves")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), plain.count() // RANGE_ROWS)
    keyed = plain.withColumn("key", F.coalesce(F.sha2(F.col("source").cast("binary"), 256), F.lit(""))).withColumn("row", F.monotonically_increasing_id())
    by = ["source", "doc_id", "leaf", "row"]
    dealt = keyed.repartitionByRange(ranges, *by).sortWithinPartitions(*by).select("doc_id", "leaf", "tampered", "key").withColumn("range", F.spark_partition_id())
    table = scratch.stage(dealt.mapInArrow(numbered, "doc_id long, leaf string, tampered string, key string, range int, ord long, pos long, is_last boolean"), "ordered")
    summary = (
        table.groupBy("range").agg(
            F.max(F.struct("ord", "pos", "key")).alias("z"), F.min(F.struct("ord", "key")).alias("a"), F.max("pos").alias("most")
        ).orderBy("range").collect()
    )
    goes_on: dict[int, tuple[int, int, bool]] = {}
    source, before, most, last = -1, 0, 0, None
    for k, s in enumerate(summary):
        same = s["a"]["key"] == last
        source, before = (source, before) if same else (source + 1, 0)
        ends = k + 1 == len(summary) or summary[k + 1]["a"]["key"] != s["z"]["key"]
        goes_on[s["range"]] = (source, before, ends)
        source += s["z"]["ord"]
        before = s["z"]["pos"] + 1 + (before if s["z"]["ord"] == 0 else 0)
        most, last = max(most, s["most"] + 1, before), s["z"]["key"]
    return table, goes_on, source + 1, most


# --------------------------------------------------------------------------- supersteps
def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def dealt(key: tuple[int, int]) -> int:
    return key[0] * 7919 + key[1]


def levels(n: int) -> int:
    """Supersteps until one node is left; a lone leaf also takes one, in which it stays as it is."""
    k = 1
    while n > FANOUT:
        n = -(-n // FANOUT)
        k += 1
    return k


def run_of(children: list[tuple]) -> list[tuple]:
    """Children of a parent in their order; none may be missing."""
    run = sorted(children, key=lambda c: c[0])
    if [c[0] for c in run] != list(range(len(run))) or len(run) < FANOUT and not run[-1][2]:
        raise ValueError("a parent lacks children")
    return run


def upward(nodes: RDD, supersteps: int, parts: int) -> list[RDD]:
    """Runs of each level: ((tree, parent), [(slot, digest, last, payload), ...]).

    nodes: ((tree, index), (digest, last, payload)).
    """
    out = []
    for step in range(supersteps):
        runs = (
            nodes.map(lambda x: ((x[0][0], x[0][1] // FANOUT), (x[0][1] % FANOUT, *x[1])))
            .groupByKey(parts, dealt).mapValues(run_of)
        )
        out.append(runs)
        # the parents; tops (first and last of their level) go no further, unless they are lone leaves above
        nodes = runs.map(parent_of).filter(lambda x: not (x[0][1] == 0 and x[1][1]))
    return out


def parent_of(run: tuple) -> tuple:
    """((tree, index), (digest, last, None)) of a run's parent; a lone leaf is its own parent."""
    (tree, index), kids = run
    return (tree, index), (kids[0][1] if lone(run) else digest([k[1] for k in kids]), kids[-1][2], None)


def lone(run: tuple) -> bool:
    """One node that is all of its level: only leaves can be, as a level of one is a top."""
    return run[0][1] == 0 and len(run[1]) == 1 and run[1][0][2]


def tops(runs: list[RDD]) -> RDD:
    """((tree, level), digest) of the top of each tree."""
    found = [r.map(parent_of).filter(lambda x: x[0][1] == 0 and x[1][1]).map(lambda x, k=k: ((x[0][0], k), x[1][0])) for k, r in enumerate(runs)]
    return found[0].context.union(found)


def siblings(run: tuple) -> Iterator[tuple[tuple, tuple[str, str] | None]]:
    """(child, digests left and right of it) of each child; None for a lone leaf."""
    kids = run[1]
    for k, kid in enumerate(kids):
        yield kid, None if lone(run) else ("".join(x[1] for x in kids[:k]), "".join(x[1] for x in kids[k + 1 :]))


def downward(runs: list[RDD], heads: RDD, parts: int) -> RDD:
    """((tree, parent), (run, what the parent knows, path of the parent)) of each run of leaves.

    heads: ((tree, level), (known, path)) of each top; ``known`` is passed on as it is.
    """
    paths = None
    for k in range(len(runs) - 1, -1, -1):
        own = heads.filter(lambda x, k=k: x[0][1] == k).map(lambda x: ((x[0][0], 0), x[1]))
        paths = (own if paths is None else paths.union(own)).partitionBy(parts, dealt)
        met = runs[k].join(paths, parts) if runs[k].partitioner == paths.partitioner else runs[k].partitionBy(parts, dealt).join(paths, parts)
        if k == 0:
            return met.map(lambda x: (x[0], (x[1][0], *x[1][1])))
        paths = met.flatMap(lambda x: [((x[0][0], x[0][1] * FANOUT + kid[0]), (x[1][1][0], ([side] if side else []) + x[1][1][1])) for kid, side in siblings((x[0], x[1][0]))])
    raise ValueError("no levels")


def fold(start: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        start = digest([left, start, right])
    return start


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    table, goes_on, sources, most = ordered(Scratch(spark, "merkle"), docs)
    if not goes_on:
        return spark.createDataFrame([], SCHEMA)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(goes_on))
    share = spark.sparkContext.broadcast(goes_on)

    def node_of(r) -> tuple:
        first, before, ends = share.value[r["range"]]
        key = (first + r["ord"], r["pos"] + (before if r["ord"] == 0 else 0))
        return key, (r["leaf"], ends if r["is_last"] is None else r["is_last"], (r["doc_id"], r["tampered"]))

    leaf_runs = upward(table.select("doc_id", "leaf", "tampered", "range", "ord", "pos", "is_last").rdd.map(node_of), levels(most), parts)
    subroots = tops(leaf_runs)
    root_runs = upward(subroots.map(lambda x: ((0, x[0][0]), (x[1], x[0][0] == sources - 1, x[0][1]))), levels(sources), parts)
    (top_key, root), = tops(root_runs).collect()
    at_root = downward(root_runs, spark.sparkContext.parallelize([(top_key, (None, []))], 1), parts)
    heads = at_root.flatMap(
        lambda x: [((x[0][1] * FANOUT + kid[0], kid[3]), (kid[1], ([side] if side else []) + x[1][2])) for kid, side in siblings((x[0], x[1][0]))]
    )

    def rows_of(x: tuple) -> Iterator[tuple]:
        key, (run, subroot, above) = x
        rest = "".join(left + right for left, right in above)
        for kid, side in siblings((key, run)):
            doc_id, tampered = kid[3]
            path = ([side] if side else []) + above
            folded = fold(tampered or kid[1], path)
            yield doc_id, kid[1], subroot, root, digest([*(side or ()), rest]), folded, folded == root

    return spark.createDataFrame(downward(leaf_runs, heads, parts).flatMap(rows_of), SCHEMA, verifySchema=False)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# --------------------------------------------------------------------------- the same in SQL
def _sql(source_levels: int = 6, root_levels: int = 5) -> str:
    """SQL with a CTE for each level: up to 16**6 leaves a source and 16**5 sources."""
    crc = ["c0 AS (SELECT i::BIGINT AS k, i::BIGINT AS c FROM range(256) t(i))"]
    crc += [f"c{n + 1} AS (SELECT k, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END AS c FROM c{n})" for n in range(8)]
    crc.append("crc AS (SELECT list(c ORDER BY k) AS tab FROM c8)")

    def f(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    head = " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars"))
    out = [
        f"""marked AS (SELECT doc_id, source, sha256({head} || {f("text")}) AS leaf, sha256({head} || {f(f"translate(text, '{UPPER}', '{LOWER}')")}) AS tampered,
            xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 5 = 0 AS touched FROM documents, crc)""",
        """base AS (SELECT doc_id, source, leaf, CASE WHEN touched THEN tampered ELSE leaf END AS start,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM marked)""",
        "d0 AS (SELECT source AS tree, i, leaf AS h FROM base)",
    ]

    def climb(d: str, n: int) -> None:
        for k in range(n):
            run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
            out.append(
                f"""{d}s{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
                    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {d}{k})"""
            )
            out.append(f"{d}{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {d}s{k} GROUP BY tree, i // 16)")

    climb("d", source_levels)
    out.append(f"e0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, h, tree AS source FROM d{source_levels})")
    climb("e", root_levels)
    out.append(f"p0 AS (SELECT base.*, d.h AS subroot, e0.i AS s, '' AS proof, start AS fold FROM base JOIN d{source_levels} d ON d.tree IS NOT DISTINCT FROM base.source JOIN e0 ON e0.source IS NOT DISTINCT FROM base.source)")
    last = 0
    for d, at, tree, n in (("d", "i", "source", source_levels), ("e", "s", "0", root_levels)):
        for k in range(n):
            out.append(
                f"""p{last + 1} AS (SELECT p.* REPLACE (CASE WHEN x.n = 1 THEN p.proof ELSE p.proof || x.lft || x.rgt END AS proof,
                    CASE WHEN x.n = 1 THEN p.fold ELSE sha256(x.lft || p.fold || x.rgt) END AS fold)
                    FROM p{last} p JOIN {d}s{k} x ON x.tree IS NOT DISTINCT FROM p.{tree} AND x.i = p.{at} // {16**k})""".replace("p.0", "0")
            )
            last += 1
    return (
        "WITH " + ",\n".join(crc + out)
        + f"\nSELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.h AS verified FROM p{last}, e{root_levels} AS root"
    )


ORACLE = _sql()
