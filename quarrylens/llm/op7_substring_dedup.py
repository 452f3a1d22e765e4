"""Substring dedup over words: prefix-partitioned suffix trees.

Every word position with ``window`` words to come starts a suffix. Its prefix is
of variable length: it reaches from the suffix's first word to the end of the
first-ranked run of ``PREFIX`` words among its first ``window`` ones (see
repeats.py), so it has ``PREFIX`` to ``window`` words, and suffixes that agree on
``window`` words have the same prefix. Prefixes with the same end make one group;
neighbouring suffixes of a document mostly share that end, so a group's suffixes
travel as a few passages of text and not one by one. Suffixes whose prefix ends in
a run that occurs once are leaves right below the root and are never shuffled.

A task builds the subtrees of its groups in memory (``subtrees``): suffixes are
sorted under their prefixes, and the common prefix of neighbours in that order,
measured on the texts, gives the internal nodes. A node ``window`` words down or
deeper is a maximal repeat of its suffixes within the passages: it has its depth
and its smallest document, and removes that depth's words from the others.

A group of more than ``LIMIT`` passages would not be even work or memory. Equal
passages become one of the smallest document first (the others go whole), which is
a minimum that Spark combines before the shuffle. Where even the different ones
are too many, their prefixes are lengthened to ``window`` words: each such prefix
is a group of its own, whose tree has a single node, of which again only the
smallest document is needed.

Equal texts are one text with the smallest of their ids; the others are removed
whole where they have ``window`` words. Rows with a null id are never removed
and never a source. Null texts have no words. Rows that repeat an id are judged
by text, and do not remove each other. Very long texts are slices of their own,
read whole. Of equal passages the one in the smallest id stays. An empty table
gives no rows. Extra columns are ignored unless they are carried, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import Scratch, slices, utf8
from quarrylens.llm.kernels import Words, range_hash, winnow
from quarrylens.llm.repeats import anchors, keyed, merge, repeated, text_classes

WINDOW, PREFIX = 50, 10
#: Passages (of some 430 bytes) of a group beyond which its prefixes are lengthened, and passages that a task holds before it solves them.
LIMIT, HELD, PART = 32_768, 2_000, 500


def windows_of(raw: np.ndarray, offs: np.ndarray, window: int, prefix: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, start word of each window, start word of each one's anchor, anchor fingerprints by word."""
    w = Words(raw, offs)
    at, doc, h = w.grams(prefix)
    start, chosen = winnow(h, doc, window - prefix + 1)
    by_word = np.zeros(len(w.starts), np.uint64)
    by_word[at] = h
    return w, at[start], at[chosen], by_word


def subtrees(flat: np.ndarray, offs: np.ndarray, lead: np.ndarray, doc: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, first word, end word) of the repeats to remove from passages flat[offs[i]:offs[i + 1]] of documents doc[i].

    Passage i's prefixes end ``prefix`` words after word lead[i].
    """
    # words are found slice by slice, so that arrays as long as the text stay small
    parts = [Words(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs)]
    word = np.concatenate([np.zeros(0, np.uint64), *(w.hash for w in parts)])
    counts = np.concatenate([np.zeros(0, np.int64), *(w.counts for w in parts)])
    begin = np.append(0, np.cumsum(counts))
    starts = counts - window + 1
    row = np.repeat(np.arange(len(starts)), starts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    suffix = begin[row] + at
    path = range_hash(word, suffix, begin[row] + lead[row] + prefix)
    down = range_hash(word, suffix, suffix + window)
    order = np.lexsort((down, path))
    path, down, sorted_suffix, sorted_row = path[order], down[order], suffix[order], row[order]
    shared = np.append(False, (path[1:] == path[:-1]) & (down[1:] == down[:-1]))
    # common prefixes of neighbours below the window's depth, by bisection
    here = np.flatnonzero(shared)
    x, y = sorted_suffix[here - 1], sorted_suffix[here]
    low = np.full(len(here), window)
    high = np.minimum(begin[sorted_row[here - 1] + 1] - x, begin[sorted_row[here] + 1] - y)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = range_hash(word, x, x + middle) == range_hash(word, y, y + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    common = np.full(len(order), np.iinfo(np.int64).max)
    common[here] = low
    node_at = np.flatnonzero(~shared)
    node = np.cumsum(~shared) - 1
    if not len(node_at):
        return row, at, at
    depth = np.minimum.reduceat(common, node_at)
    smallest = np.minimum.reduceat(doc[sorted_row], node_at)
    gone, reach = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    gone[order] = doc[sorted_row] > smallest[node]
    reach[order] = np.where(gone[order], depth[node], 0)
    first = gone.copy()
    first[1:] &= ~(gone[:-1] & (row[1:] == row[:-1]))
    if not first.any():
        return row[:0], at[:0], at[:0]
    end = np.maximum.reduceat(np.where(gone, at + reach, 0), np.flatnonzero(first))
    return row[first], at[first], end


def spans(scratch: Scratch, docs: DataFrame, classes: DataFrame, window: int, prefix: int, limit: int) -> DataFrame:
    """t1, t2, runs: array of (start, end) word runs, covered by windows that also start in a smaller document."""

    def choose(raw: np.ndarray, offs: np.ndarray):
        w, _, anchor, h = windows_of(raw, offs, window, prefix)
        at = np.unique(anchor)
        text = w.doc()[at]
        return text, at - w.offs[text], h[at]

    places = scratch.stage(repeated(scratch, anchors(docs, choose)), "places")
    # each repeated text once: the row that has the smallest id
    chosen = docs.join(places.join(classes, ["t1", "t2"]), ["t1", "t2"]).where("doc_id = rep").select("text", "t1", "t2", "doc_id", "at")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(0))
            keys = [np.asarray(b.column(k)) for k in (1, 2, 3)]
            lists = b.column(4)
            inner = lists.flatten()
            cut = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            pos, times = np.asarray(inner.field(0)).astype(np.int64), np.asarray(inner.field(1))
            for i, j in slices(offs):
                w, start, anchor, h = windows_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window, prefix)
                n = np.zeros(len(w.starts) + 1, np.int64)
                n[np.repeat(w.offs[:-1], np.diff(cut[i : j + 1])) + pos[cut[i] : cut[j]]] = times[cut[i] : cut[j]]
                keep = n[anchor] > 1
                start, anchor = start[keep], anchor[keep]
                if not len(start):
                    continue
                first = np.ones(len(start), bool)
                first[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
                edge = np.append(np.flatnonzero(first), len(start))
                a, s, e = anchor[edge[:-1]], start[edge[:-1]], start[edge[1:] - 1]
                text = w.doc()[a]
                body = raw[offs[i] : offs[j]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[a].view(np.int64)),
                        pa.array(n[a]),
                        pa.array(keys[2][i + text]),
                        pa.array(keys[0][i + text]),
                        pa.array(keys[1][i + text]),
                        pa.array((s - w.offs[text]).astype(np.int32)),
                        pa.array((a - s).astype(np.int32)),
                        pa.array((e - s + window).astype(np.int32)),
                        pa.array([body[p:q] for p, q in zip(w.starts[s].tolist(), w.ends[e + window - 1].tolist(), strict=True)], pa.binary()),
                    ],
                    ["prefix", "n", "doc_id", "t1", "t2", "start", "lead", "words", "body"],
                )

    rows = scratch.stage(chosen.mapInArrow(suffixes, "prefix long, n long, doc_id long, t1 long, t2 long, start int, lead int, words int, body binary"), "passages")
    scratch.drop(places)
    scratch.sweep()

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def solve(t: pa.Table) -> pa.RecordBatch:
            col = lambda k: np.asarray(t.column(k).combine_chunks())
            row, first, end = subtrees(*utf8(t.column("body")), col("lead").astype(np.int64), col("doc_id"), window, prefix)
            start = col("start")[row]
            return pa.RecordBatch.from_arrays(
                [pa.array(col("t1")[row]), pa.array(col("t2")[row]), pa.array((start + first).astype(np.int32)), pa.array((start + end).astype(np.int32))],
                ["t1", "t2", "from", "to"],
            )

        last_prefix = None
        for b in batches:  # sorted by prefix: whole groups are solved as soon as enough passages are held
            for at in range(0, len(b), PART):
                part = b.slice(at, PART)
                keys = np.asarray(part.column(0))
                if count >= HELD:
                    # the held passages end with the group that this part may go on with
                    cut = int(np.searchsorted(keys != last_prefix, True)) if keys[0] == last_prefix else 0
                    if cut < len(part):
                        if cut:
                            held.append(part.slice(0, cut))
                        yield solve(pa.Table.from_batches(held))
                        held, count = [], 0
                        part = part.slice(cut)
                held.append(part)
                count += len(part)
                last_prefix = keys[-1]
        if held:
            yield solve(pa.Table.from_batches(held))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The suffixes of passages (columns as grouped has them), by their first ``window`` words."""
        for b in batches:
            raw, offs = utf8(b.column(6))
            for i, j in slices(offs):
                w = Words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                starts = w.counts - window + 1
                row = np.repeat(np.arange(j - i), starts)
                at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
                suffix = w.offs[row] + at
                take = pa.array(i + row)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(take) for k in range(4)), pa.array((np.asarray(b.column(4))[i + row] + at).astype(np.int32)), pa.array(range_hash(w.hash, suffix, suffix + window).view(np.int64))],
                    ["prefix", "doc_id", "t1", "t2", "start", "node"],
                )

    keys = ["prefix", "h1", "h2"]
    hot = rows.where(F.col("n") > limit).withColumn("h1", F.xxhash64("lead", "body")).withColumn("h2", F.xxhash64("body", F.lit(1)))
    least = scratch.stage(hot.groupBy(*keys).agg(F.min("doc_id").alias("smallest")), "least")
    # a copy of a passage that a smaller document has goes whole; the smallest document's stands for all
    copies = hot.select(*keys, "doc_id", "t1", "t2", "start", "words").join(least, keys).where("doc_id > smallest").select("t1", "t2", F.col("start").alias("from"), (F.col("start") + F.col("words")).alias("to"))
    single = scratch.stage(hot.join(least, keys).where("doc_id = smallest").drop("n", "h1", "h2", "smallest", "words"), "single")
    sizes = scratch.stage(single.groupBy("prefix").agg(F.count("*").alias("n")), "sizes")
    parted = single.join(sizes, "prefix")
    columns = ["prefix", "doc_id", "t1", "t2", "start", "lead", "body"]
    small = rows.where(F.col("n") <= limit).select(*columns).union(parted.where(F.col("n") <= limit).select(*columns))
    found = [small.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(trees, "t1 long, t2 long, from int, to int"), copies]
    if sizes.where(F.col("n") > limit).head(1):  # even its different passages are too many: prefixes of ``window`` words
        long = scratch.stage(parted.where(F.col("n") > limit).select(*columns).mapInArrow(nodes, "prefix long, doc_id long, t1 long, t2 long, start int, node long"), "nodes")
        # a table of its own, so that the join shuffles both sides and Spark can split a node that very many documents hold
        first = scratch.stage(long.groupBy("prefix", "node").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest")).where("smallest < largest").drop("largest"), "first")
        found.append(long.join(first, ["prefix", "node"]).where("doc_id > smallest").select("t1", "t2", F.col("start").alias("from"), (F.col("start") + window).alias("to")))
    every = reduce(DataFrame.union, found)
    out = scratch.stage(every.groupBy("t1", "t2").agg(F.collect_list(F.struct("from", "to")).alias("runs")), "runs")
    scratch.drop(rows, least, single)
    scratch.sweep()
    return out


def dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, limit: int = LIMIT, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with_text: the kept text (words joined by one space) as well.

    A text of which nothing is removed is given back unchanged. ``carry`` names
    further columns of docs to return, in a struct ``carried``.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    base = keyed(docs, carry=carry)
    kind = dict(base.dtypes).get("carried")
    classes = scratch.stage(text_classes(base.where("doc_id IS NOT NULL")), "classes")
    runs = spans(scratch, base.where("doc_id IS NOT NULL"), classes, window, prefix, limit)
    verdict = classes.where("copies > 1").select("t1", "t2", "rep").join(runs, ["t1", "t2"], "full")
    joined = base.join(verdict, ["t1", "t2"], "left").select("doc_id", "text", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)).alias("copy"), "runs", *(["carried"] if carry else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, copy, runs in zip(b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                raw = text.as_py()
                words = raw.encode("utf-8", "surrogatepass").split()
                n, removed, kept = len(words), 0, words
                if copy and n >= window:
                    removed, kept = n, []
                elif not copy and runs.is_valid:
                    r = np.array([(x["from"], x["to"]) for x in runs.as_py()], np.int64).reshape(-1, 2)
                    s, e = merge(r[:, 0], r[:, 1])
                    removed = int((e - s).sum())
                    edges = [0, *np.stack([s, e], 1).ravel().tolist(), n]
                    kept = [x for k in range(0, len(edges), 2) for x in words[edges[k] : edges[k + 1]]]
                joined = b" ".join(kept)
                out.append((n, removed, hashlib.sha256(joined).hexdigest(), (joined.decode("utf-8", "surrogatepass") if removed else raw) if with_text else None))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            arrays = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(cols[3], pa.string()))
                names.append("kept_text")
            if carry:
                arrays.append(b.column(4))
                names.append("carried")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text + (f", carried {kind}" if carry else ""))


def op7_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50),
f AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM s),
least_doc AS (SELECT h, min(doc_id) AS m FROM f GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k
  FROM f JOIN least_doc USING (h) WHERE doc_id > m),
words AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS k, unnest(words) AS word FROM w),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.k) AS t, count(*) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k
  WHERE gone.k IS NULL GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
