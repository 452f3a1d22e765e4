"""Suffix-array dedup over bytes, by column-wise multi-document construction.

Every byte that a ``window``-byte string covers which also starts elsewhere is
removed. A window can only repeat where its anchor does (see repeats.py), so each
repeated anchor's surroundings - the windows that have this anchor - become one
short document, and the documents of one anchor form a collection. Within it,
equal windows lie at equal places relative to the anchor.

``columns`` builds the order of a collection's suffixes one column at a time,
from the right: each round puts one more symbol in front of every document's
suffix, re-sorts the suffixes stably by that symbol (the last-to-first step of
the multi-string Burrows-Wheeler transform) and updates the common prefix of
each suffix with its neighbour from those of the round before. A neighbour with
a common prefix of ``window`` symbols is a repeat. All collections of a block
advance together, so a round is a few array operations. Collections come to the
task in order, from Spark's sorted shuffle files, and are read once: a task
holds one block of them.

Collections of more than ``LIMIT`` documents take another exact way: their
windows' fingerprints are counted by Spark, combined before the shuffle.

A text that several rows have is removed whole where it has ``window`` bytes;
other rows are judged by their text alone, so null and repeated ids do no harm.
Null texts are empty. Long texts are slices of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import Scratch, slices, utf8
from quarrylens.llm.kernels import BYTE, run_hash, winnow
from quarrylens.llm.repeats import NO_ID, anchors, keyed, merge, repeated, text_classes

WINDOW, GRAM = 400, 32
#: Documents of a collection beyond which its windows are counted instead, and documents of a block.
LIMIT, BLOCK = 32_768, 12_000


def columns(group: np.ndarray, flat: np.ndarray, base: np.ndarray, size: np.ndarray, lead: np.ndarray, window: int) -> np.ndarray:
    """marks[i, s]: the window that starts at byte s of document i also starts in another document of its group, at the same column.

    Document i is flat[base[i]:base[i] + size[i]]; its byte lead[i] is in column 0.
    """
    m = len(size)
    marks = np.zeros((m, max(1, int((size - window).max()) + 1)), bool)
    right, left = size - lead - 1, -lead
    entering = np.argsort(-right, kind="stable")
    at_entry = 0
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int32)
    group = group.astype(np.int64) << 8
    for column in range(int(right.max()), int(left.min()) - 1, -1):
        done = left[order] > column
        if done.any():
            # a suffix that leaves hands the smaller common prefix on to its successor
            stay = np.flatnonzero(~done)
            if len(stay):
                common = np.minimum.reduceat(common[: stay[-1] + 1], np.append(0, stay[:-1] + 1))
            else:
                common = common[:0]
            order = order[stay]
        first = at_entry
        while at_entry < m and right[entering[at_entry]] == column:
            at_entry += 1
        if at_entry > first:
            order = np.concatenate([entering[first:at_entry], order])
            common = np.concatenate([np.zeros(at_entry - first, np.int32), common])
        if not len(order):
            continue
        key = group[order] + flat[base[order] + lead[order] + column]
        move = np.argsort(key, kind="stable")
        key, order = key[move], order[move]
        new = np.zeros(len(order), np.int32)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(same):
            pairs = np.stack([move[same - 1] + 1, move[same] + 1], 1).ravel()
            new[same] = np.minimum.reduceat(np.append(common, np.int32(0)), pairs)[::2] + 1
            hit = np.flatnonzero(new >= window)
            if len(hit):
                for x in (order[hit], order[hit - 1]):
                    marks[x, column + lead[x]] = True
        common = new
    return marks


def windows_of(raw: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text of each byte, start of each window, its anchor's start, fingerprint by byte."""
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    h = run_hash(BYTE[raw], gram)
    # runs over the end of a text are in no window: the window test is on the bytes' texts
    n = len(h)
    if len(raw) < window:
        return text, np.zeros(0, np.int64), np.zeros(0, np.int64), h
    start, chosen = winnow(h, text[:n], window - gram + 1)
    inside = text[start] == text[start + window - 1]
    return text, start[inside], chosen[inside], h


def spans(scratch: Scratch, docs: DataFrame, classes: DataFrame, window: int, gram: int, limit: int) -> DataFrame:
    """t1, t2, runs: array of (start, end) byte runs to remove, of texts that one row has."""

    def choose(raw: np.ndarray, offs: np.ndarray):
        text, _, anchor, h = windows_of(raw, offs, window, gram)
        at = np.unique(anchor)
        return text[at], at - offs[text[at]], h[at]

    places = scratch.stage(repeated(scratch, anchors(docs, choose)), "places")
    once = places.join(classes.select("t1", "t2", "rep"), ["t1", "t2"])
    chosen = docs.join(once, ["t1", "t2"]).where(F.coalesce("doc_id", F.lit(NO_ID)) == F.coalesce("rep", F.lit(NO_ID))).select("text", "t1", "t2", "at")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(0))
            keys = [np.asarray(b.column(k)) for k in (1, 2)]
            lists = b.column(3)
            inner = lists.flatten()
            cut = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            pos, times = np.asarray(inner.field(0)).astype(np.int64), np.asarray(inner.field(1))
            for i, j in slices(offs):
                part, own = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                text, start, anchor, h = windows_of(part, own, window, gram)
                n = np.zeros(len(part) + 1, np.int64)
                n[np.repeat(own[:-1], np.diff(cut[i : j + 1])) + pos[cut[i] : cut[j]]] = times[cut[i] : cut[j]]
                keep = n[anchor] > 1
                start, anchor = start[keep], anchor[keep]
                if not len(start):
                    continue
                first = np.ones(len(start), bool)
                first[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
                edge = np.append(np.flatnonzero(first), len(start))
                a, s, e = anchor[edge[:-1]], start[edge[:-1]], start[edge[1:] - 1] + window
                hot = n[a] > limit
                body = part.tobytes()
                nodes = run_hash(BYTE[part], window) if hot.any() else None
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[a].view(np.int64)),
                        pa.array(n[a]),
                        pa.array(keys[0][i + text[a]]),
                        pa.array(keys[1][i + text[a]]),
                        pa.array((s - own[text[a]]).astype(np.int32)),
                        pa.array((a - s).astype(np.int32)),
                        pa.array([None if x else body[p:q] for p, q, x in zip(s.tolist(), e.tolist(), hot.tolist(), strict=True)], pa.binary()),
                        pa.array([nodes[p : q - window + 1].view(np.int64) if x else None for p, q, x in zip(s.tolist(), e.tolist(), hot.tolist(), strict=True)], pa.list_(pa.int64())),
                    ],
                    ["anchor", "n", "t1", "t2", "start", "lead", "body", "nodes"],
                )

    rows = scratch.stage(chosen.mapInArrow(collect, "anchor long, n long, t1 long, t2 long, start int, lead int, body binary, nodes array<long>"), "collections")
    scratch.drop(places)
    scratch.sweep()

    def solve(t: pa.Table) -> pa.RecordBatch:
        col = lambda k: np.asarray(t.column(k).combine_chunks())
        flat, offs = utf8(t.column("body"))
        anchor = col("anchor")
        ids = np.cumsum(np.append(0, anchor[1:] != anchor[:-1]))
        marks = columns(ids, flat, offs[:-1], np.diff(offs), col("lead").astype(np.int64), window)
        edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, at = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        start = col("start")[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(col("t1")[row]), pa.array(col("t2")[row]), pa.array((start + at).astype(np.int32)), pa.array((start + end - 1 + window).astype(np.int32))],
            ["t1", "t2", "from", "to"],
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for b in batches:  # sorted by anchor
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                keys = np.asarray(part.column(0))
                if count >= BLOCK:
                    cut = int(np.searchsorted(keys != last, True)) if keys[0] == last else 0
                    if cut < len(part):
                        if cut:
                            held.append(part.slice(0, cut))
                        yield solve(pa.Table.from_batches(held))
                        held, count = [], 0
                        part = part.slice(cut)
                held.append(part)
                count += len(part)
                last = keys[-1]
        if held:
            yield solve(pa.Table.from_batches(held))

    grouped = rows.where(F.col("n") <= limit).select("anchor", "t1", "t2", "start", "lead", "body").repartition("anchor").sortWithinPartitions("anchor")
    cold = grouped.mapInArrow(blocks, "t1 long, t2 long, from int, to int")
    single = rows.where(F.col("n") > limit).select("anchor", "t1", "t2", "start", F.posexplode("nodes").alias("i", "node"))
    # a table of its own, so that the join shuffles both sides and Spark can split a window that very many documents hold
    often = scratch.stage(single.groupBy("anchor", "node").agg(F.count("*").alias("k")).where("k > 1").drop("k"), "often")
    hot = single.join(often, ["anchor", "node"]).select("t1", "t2", (F.col("start") + F.col("i")).alias("from"), (F.col("start") + F.col("i") + window).alias("to"))
    out = scratch.stage(cold.union(hot).groupBy("t1", "t2").agg(F.collect_list(F.struct("from", "to")).alias("runs")), "runs")
    scratch.drop(rows, often)
    scratch.sweep()
    return out


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text: the kept bytes as well."""
    scratch = Scratch(docs.sparkSession, "suffix-array")
    base = keyed(docs)
    classes = scratch.stage(text_classes(base), "classes")
    runs = spans(scratch, base, classes, window, gram, limit)
    verdict = classes.where("copies > 1").select("t1", "t2", "copies").join(runs, ["t1", "t2"], "full")
    joined = base.join(verdict, ["t1", "t2"], "left").select("doc_id", "text", F.coalesce(F.col("copies") > 1, F.lit(False)).alias("copy"), "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(1))
            out = []
            for k, (copy, runs) in enumerate(zip(b.column(2).to_pylist(), b.column(3), strict=True)):
                body = raw[offs[k] : offs[k + 1]].tobytes()
                n, removed, count, kept = len(body), 0, 0, body
                if copy and n >= window:
                    removed, count, kept = n, 1, b""
                elif not copy and runs.is_valid:
                    r = np.array([(x["from"], x["to"]) for x in runs.as_py()], np.int64).reshape(-1, 2)
                    s, e = merge(r[:, 0], r[:, 1])
                    removed, count = int((e - s).sum()), len(s)
                    edges = [0, *np.stack([s, e], 1).ravel().tolist(), n]
                    kept = b"".join(body[edges[x] : edges[x + 1]] for x in range(0, len(edges), 2))
                out.append((n, removed, count, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
            arrays = [b.column(0), *(pa.array(cols[x], pa.int64()) for x in range(3)), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("kept_bytes")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
