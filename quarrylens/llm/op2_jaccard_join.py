"""N-gram Jaccard join by PartEnum signatures (exact for J >= 0.75 on word 5-shingle sets).

Sets are put into bands of sizes [l, 4l/3). Two sets with J >= 3/4, the smaller
one in band b with largest size r, differ in at most k = r/3 features, whatever
their sizes. For band b the feature domain (the 64-bit fingerprint space) is cut
into n1 = ceil((k+1)/2) parts and each part into three; so some part holds at
most one difference, and two of its three sub-parts hold none. Each set
therefore emits, for its own band and the one below that it can reach into, a
signature of every two-of-three subset of every part: similar sets share one.
(Where k = 0 the signature is the whole set.)

A subset that is empty in a set gives no signature. For sets of more than
``SMALL`` features a pair at the threshold could only be lost if all its agreeing
subsets were empty, which we estimate below 1e-8. Smaller sets make up for it: one
in which some part has an empty subset also emits its n - ceil(3n/4) + 1 smallest
features as signatures, of which two similar sets share one; a pair can only be
lost to empty subsets if both its sets emit these.

Signatures travel as packed blocks - one row for each slice of the signature
space and batch of documents, 8 bytes a signature - and are sorted in numpy.
Sets under one signature yield a star of candidate pairs (the smallest with each
other one), so a group of g near copies gives g - 1 pairs. Candidates that
bitmaps of the sets don't rule out are verified on whole sets. Where a star's
leaf fails against its centre, it is compared with the star's other leaves of
other components; every pair that shares a signature is so either compared or
known to be in one component. In stars of more than ``LARGE_STAR`` leaves - those
of a shingle that very many texts share - leaves first meet again on the rarest
quarter of their features, counted within the star, so that what all of them
share brings none of them together.

Equal texts are one set from the start. Nulls and texts without words have an
empty set and link with nothing. Rows with a null id link with nothing. Rows
that repeat an id count as one document: their links are united. Very long texts
are slices of their own, read whole. Pairs at exactly 0.75 link; of equals the
smallest id names the component. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.common import Scratch, components, slices, units, utf8
from quarrylens.llm.kernels import Words, mix, shingle_sets
from quarrylens.llm.repeats import keyed, text_classes

SHINGLE, SMALL = 5, 64
#: Text bytes for each slice of the signature space, and slices at least.
SLICE_TEXT, MIN_SLICES = 16 << 20, 48
#: Leaves of a star that one block holds, and leaves beyond which they meet on rare features first.
STAR_BLOCK, LARGE_STAR = 256, 4096
#: Text bytes whose signatures form one packed block.
BLOCK_TEXT = 6 << 20
_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_SUBSETS = ((0, 1), (0, 2), (1, 2))


def bands(largest: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of the smaller set of a pair, for each band that sets of up to ``largest`` features reach."""
    out, low = [], 1
    while low <= largest:
        high = -(-low * 4 // 3) - 1
        out.append((low, high))
        low = high + 1
    return out


def signatures(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets; h holds each set's sorted features, offs their n + 1 offsets."""
    size = np.diff(offs)
    owners, sigs = [], []

    def elements(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Indices of the first count[i] features of sets[i]."""
        total = np.cumsum(count)
        return np.arange(int(total[-1])) - np.repeat(total - count, count) + np.repeat(offs[sets], count)

    lacking = np.zeros(len(size), bool)
    for b, (low, high) in enumerate(bands(int(size.max(initial=0)))):
        sets = np.flatnonzero((size >= low) & (size <= high * 4 // 3))
        if not len(sets):
            continue
        differences = high // 3
        parts = (differences + 2) // 2
        cells = 3 * parts
        at = elements(sets, size[sets])
        x = h[at]
        cell = (((x >> _U(32)) * _U(cells)) >> _U(32)).astype(np.int64) + np.repeat(np.arange(len(sets)) * cells, size[sets])
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        total, some = np.zeros(len(sets) * cells, _U), np.zeros(len(sets) * cells, bool)
        total[cell[first]] = np.add.reduceat(x, first)
        some[cell[first]] = True
        total, some = total.reshape(-1, 3), some.reshape(-1, 3)
        if low <= SMALL and differences:
            lacking[sets] |= (some.sum(axis=1) <= 1).reshape(len(sets), parts).any(axis=1)
        place = (np.arange(len(sets) * parts) % parts).astype(_U) * _U(3)
        for s, chosen in enumerate(_SUBSETS if differences else ((0, 1, 2),)):
            keep = np.flatnonzero(some[:, chosen].any(axis=1))
            owners.append(sets[keep // parts])
            sigs.append(mix(total[np.ix_(keep, chosen)].sum(axis=1, dtype=_U) + (place[keep] + _U(s + 1) + _U((b + 1) << 40)) * _K))
    rest = np.flatnonzero(lacking)
    if len(rest):
        n = size[rest]
        count = n - -(-3 * n // 4) + 1
        owners.append(np.repeat(rest, count))
        sigs.append(mix(h[elements(rest, count)] ^ _K))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(owners), np.concatenate(sigs)


def sets_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(Words(raw, offs, fold=True), SHINGLE)


def packed(docs: DataFrame, cuts: int) -> DataFrame:
    """part, nodes, sigs: signatures of a batch in slice ``part``; the low 16 bits of a signature index nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(0))
            t1 = np.asarray(b.column(1))
            for i, j in slices(offs, BLOCK_TEXT):
                nodes, first = np.unique(t1[i:j], return_index=True)
                owner, sig = [], []
                rank = np.full(j - i, -1, np.int64)
                rank[first] = np.arange(len(nodes))
                for p, q in slices(offs[i : j + 1]):
                    h, cut = sets_of(raw[offs[i + p] : offs[i + q]], offs[i + p : i + q + 1] - offs[i + p])
                    own = rank[p:q]
                    o, s = signatures(h, cut)
                    keep = own[o] >= 0
                    owner.append(own[o][keep])
                    sig.append(s[keep])
                o, s = np.concatenate(owner), np.concatenate(sig)
                part = (((s >> _U(32)) * _U(cuts)) >> _U(32)).astype(np.int32)
                rows = []
                for at in range(0, len(nodes), 1 << 16):  # as many nodes as 16 bits can tell apart
                    mine = np.flatnonzero((o >= at) & (o < at + (1 << 16))) if len(nodes) > 1 << 16 else np.arange(len(o))
                    order = mine[np.argsort(part[mine], kind="stable")]
                    edge = np.searchsorted(part[order], np.arange(cuts + 1))
                    for c in np.flatnonzero(np.diff(edge)):
                        sel = order[edge[c] : edge[c + 1]]
                        used, index = np.unique(o[sel], return_inverse=True)
                        value = (s[sel] & ~_U(0xFFFF)) | index.astype(_U)
                        rows.append((int(c), nodes[used].tobytes(), value.tobytes()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "nodes", "sigs"])

    return docs.select("text", "t1").mapInArrow(run, "part int, nodes binary, sigs binary")


def stars(blocks: DataFrame) -> DataFrame:
    """Distinct candidate pairs a < b (texts' hashes): under each signature the smallest with each other.

    Sizes are not looked at here: a leaf that is too large or small for its
    centre still has to be compared with the star's other leaves.
    """

    def solve(part: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        nodes = np.concatenate([np.frombuffer(x[0], np.int64) for x in part])
        shift = np.cumsum([0, *(len(x[0]) // 8 for x in part[:-1])])
        value = np.concatenate([np.frombuffer(x[1], _U) for x in part])
        index = (value & _U(0xFFFF)).astype(np.int64) + np.repeat(shift, [len(x[1]) // 8 for x in part])
        value = value >> _U(16)
        order = np.argsort(value, kind="stable")
        value = value[order]
        same = value[1:] == value[:-1]
        in_run = np.append(same, False) | np.append(False, same)
        order, value = order[in_run], value[in_run]
        if not len(order):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        index = index[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        run = np.cumsum(np.append(1, value[1:] != value[:-1])) - 1
        node = nodes[index]
        best = np.lexsort((node, run))  # the runs stay in place, their smallest node comes first
        centre = node[best[first]][run]
        ok = node != centre
        pairs = np.unique(np.stack([centre[ok], node[ok]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:  # sorted by part
            for part, nodes, sigs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if part != last and held:
                    yield solve(held)
                    held = []
                last = part
                held.append((nodes, sigs))
        if held:
            yield solve(held)

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long").distinct()


def bitmap(h: np.ndarray) -> bytes:
    """A bit for each feature, by its low bits; 8 to 16 bits a feature."""
    m = max(256, 1 << int(8 * len(h) - 1).bit_length())
    bits = np.zeros(m, np.uint8)
    bits[(h & _U(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the longer one folded: a lower bound of the features in which their sets differ."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that bitmaps don't rule out. J >= 3/4 means at most a seventh of both sizes in differences, so none is lost."""
    half = sets.select("t1", "n", "bits")
    left, right = (half.select(F.col("t1").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = zip(np.asarray(b.column(2)).tolist(), np.asarray(b.column(3)).tolist(), strict=True)
            keep = [4 * min(p, q) >= 3 * max(p, q) and 7 * differing(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)) <= p + q for x, y, (p, q) in zip(b.column(4), b.column(5), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_())], ["a", "b", "maybe"])

    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "na", "nb", "xa", "xb")
    return both.mapInArrow(run, "a long, b long, maybe boolean")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with linked: whether 100 * |intersection| >= 75 * |union|."""
    left, right = sets.select(F.col("t1").alias("a"), F.col("set").alias("x")), sets.select(F.col("t1").alias("b"), F.col("set").alias("y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, key, x = [], None, None
            for a, xs, ys in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if a != key:
                    key, x = a, np.frombuffer(xs.as_buffer(), np.int64)
                y = np.frombuffer(ys.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                shared = int((x[at] == y).sum())
                out.append(100 * shared >= 75 * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def close_bitmaps(size: np.ndarray, bits: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs (x[i], y[i]) of rows the bitmaps don't rule out."""
    keep = np.zeros(len(x), bool)
    width = np.array([len(b) for b in bits])
    for w in np.unique(np.minimum(width[x], width[y])):
        rows = np.flatnonzero((width == w) | (width == 2 * w))  # sizes of 3 : 4 at most are one fold apart
        at = np.full(len(bits), -1, np.int64)
        at[rows] = np.arange(len(rows))
        table = np.stack([bits[r] if width[r] == w else bits[r][:w] | bits[r][w:] for r in rows])
        mine = np.flatnonzero((np.minimum(width[x], width[y]) == w) & (at[x] >= 0) & (at[y] >= 0))
        for s in range(0, len(mine), 16384):
            m = mine[s : s + 16384]
            apart = np.bitwise_count(table[at[x[m]]] ^ table[at[y[m]]]).sum(axis=1, dtype=np.int64)
            keep[m] = 7 * apart <= size[x[m]] + size[y[m]]
    return keep


def rare_meetings(scratch: Scratch, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """a, f, b: the leaves b of star a that have feature f among the rarest quarter of theirs, rarity counted within the star.

    Two similar leaves share one of their n - ceil(3n/4) + 1 first features in any common order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(3)]
            size = np.array([len(x) for x in each], np.int64)
            keys = [np.repeat(np.asarray(b.column(k)), size) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(np.repeat(size, size)), pa.array(np.concatenate([np.zeros(0, np.int64), *each]))], ["a", "b", "n", "f"])

    features = rows.select("a", "b").join(sets.select(F.col("t1").alias("b"), "n", "set"), "b").select("a", "b", "n", "set").mapInArrow(run, "a long, b long, n long, f long")
    # a table of its own, so that the join shuffles both sides and Spark can split a feature that very many leaves have
    often = scratch.stage(features.groupBy("a", "f").agg(F.count("*").alias("times")), "features")
    order = Window.partitionBy("a", "b").orderBy("times", "f")
    first = features.join(often, ["a", "f"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1)
    return first.where("times > 1").select("a", "f", "b")


def unlinked_leaves(scratch: Scratch, leaves: DataFrame, sets: DataFrame, block: int = STAR_BLOCK, large: int = LARGE_STAR) -> DataFrame:
    """Pairs (a, b) of leaves of one star and different components, one of them not linked to the centre, that bitmaps don't rule out.

    leaves: a (centre), b, linked, c (component). Stars of more than ``block``
    leaves are dealt into blocks, and each pair of blocks is a unit, in which all
    is compared in place: only the pairs that remain are emitted.
    """
    stars_left = leaves.groupBy("a").agg(F.count("*").alias("k"), F.sum(F.when(F.col("linked"), 0).otherwise(1)).alias("bad")).where("bad > 0 AND k > 1")
    found = scratch.stage(leaves.join(stars_left.select("a", "k"), "a"), "leaves")
    few = found.where(F.col("k") <= large).select("a", F.lit(0).cast("long").alias("f"), "k", "b", "linked", "c")
    many = found.where(F.col("k") > large)
    if many.head(1):
        met = scratch.stage(rare_meetings(scratch, many, sets), "met")
        groups = scratch.stage(met.groupBy("a", "f").agg(F.count("*").alias("k")).where("k > 1"), "groups")
        few = few.union(met.join(groups, ["a", "f"]).join(many.select("a", "b", "linked", "c"), ["a", "b"]).select("a", "f", "k", "b", "linked", "c"))
    rows = few.withColumn("blocks", F.ceil(F.col("k") / block).cast("int")).join(sets.select(F.col("t1").alias("b"), "n", "bits"), "b")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "a", "f", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "b", "linked", "c", "n", "bits"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, lo, hi), t in units(batches, 4):
            col = lambda k: np.asarray(t.column(k).combine_chunks())  # noqa: B023, E731
            own, node, comp, n = col("own"), col("b"), col("c"), col("n")
            linked = t.column("linked").combine_chunks().to_numpy(zero_copy_only=False)
            ok = (comp[:, None] != comp[None, :]) & ~(linked[:, None] & linked[None, :]) & (node[:, None] < node[None, :])
            ok &= 4 * np.minimum(n[:, None], n[None, :]) >= 3 * np.maximum(n[:, None], n[None, :])
            if lo != hi:
                ok &= own[:, None] != own[None, :]
            x, y = np.nonzero(ok)
            if not len(x):
                continue
            bits = [np.frombuffer(v.as_buffer(), _U) for v in t.column("bits").combine_chunks()]
            keep = close_bitmaps(n, bits, x, y)
            yield pa.RecordBatch.from_arrays([pa.array(node[x[keep]]), pa.array(node[y[keep]])], ["a", "b"])

    unit = ["a", "f", "lo", "hi"]
    return dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "a long, b long")


def tested(scratch: Scratch, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """pairs with linked, staged: by bitmaps, then by whole sets."""
    screened = scratch.stage(possible(pairs, sets), f"{name}-screened")
    checked = verified(screened.where("maybe"), sets)
    return scratch.stage(checked.union(screened.where("NOT maybe").select("a", "b", F.lit(False).alias("linked"))), name)


def sets_table(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """t1, n, bits, set (sorted int64 fingerprints) of each node (t1, rep), from the row that has the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(0))
            for i, j in slices(offs):
                h, cut = sets_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                each = [h[p:q] for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(1).slice(i, j - i),
                        pa.array(np.diff(cut)),
                        pa.array([bitmap(x) for x in each], pa.binary()),
                        pa.array([np.sort(x.view(np.int64)).tobytes() for x in each], pa.binary()),
                    ],
                    ["t1", "n", "bits", "set"],
                )

    return docs.join(nodes, "t1").where("doc_id = rep").select("text", "t1").mapInArrow(run, "t1 long, n long, bits binary, set binary")


def shared_ids(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the texts of ids that have several: id and smallest id of the text."""
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "t1")
    several = worded.groupBy("doc_id").agg(F.min("t1").alias("x"), F.max("t1").alias("y")).where("x <> y")
    texts = several.select("doc_id", F.col("x").alias("t1")).union(several.select("doc_id", F.col("y").alias("t1"))).union(worded.join(several.select("doc_id"), "doc_id").distinct()).distinct()
    return texts.join(classes.select("t1", "rep"), "t1").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def link_components(scratch: Scratch, docs: DataFrame, classes: DataFrame, total_bytes: int) -> DataFrame:
    """node (smallest id of a text), component (smallest id reachable), for the texts that link with another."""
    same_id = scratch.stage(shared_ids(docs, classes), "ids")
    pairs = scratch.stage(stars(packed(docs, max(MIN_SLICES, total_bytes // SLICE_TEXT))), "pairs")
    scratch.sweep()
    if not pairs.head(1):
        return components(scratch, same_id) if same_id.head(1) else docs.sparkSession.createDataFrame([], "node long, component long")
    near = pairs.select(F.col("a").alias("t1")).union(pairs.select(F.col("b").alias("t1"))).distinct().join(classes.select("t1", "rep"), "t1")
    sets = scratch.stage(sets_table(docs, near), "sets")
    scratch.sweep()
    first_round = tested(scratch, pairs, sets, "tested")
    scratch.drop(pairs)
    scratch.sweep()

    def edges(t: DataFrame) -> DataFrame:
        ids = classes.select("t1", "rep")
        return t.where("linked").join(ids.select(F.col("t1").alias("a"), F.col("rep").alias("ra")), "a").join(ids.select(F.col("t1").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))

    joined = scratch.stage(components(scratch, edges(first_round).union(same_id)), "components")
    # leaves that failed, against the other leaves of their star, unless in one component by now
    by_text = joined.join(classes.select("t1", F.col("rep").alias("node")), "node").select(F.col("t1").alias("b"), "component")
    leaves = first_round.join(by_text, "b", "left").select("a", "b", "linked", F.coalesce("component", F.col("b")).alias("c"))
    rest = unlinked_leaves(scratch, leaves, sets).distinct()
    rest = scratch.stage(rest.join(first_round.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    again = tested(scratch, rest, sets, "again").where("linked") if rest.head(1) else rest
    scratch.drop(first_round, sets)
    if not again.head(1):
        return joined
    return components(scratch, joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(edges(again)))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    base = keyed(docs)
    known = base.where("doc_id IS NOT NULL")
    classes = scratch.stage(text_classes(known), "classes")
    total = classes.agg(F.sum("size")).first()[0] or 0
    none = docs.sparkSession.createDataFrame([], "node long, component long")
    found = link_components(scratch, known, classes, int(total)) if total else none

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(0))
            n = np.zeros(len(b), np.int64)
            for i, j in slices(offs):
                n[i:j] = np.diff(sets_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[1])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(n)], ["doc_id", "t1", "t2", "n_shingles"])

    sized = base.select("text", "doc_id", "t1", "t2").mapInArrow(count, "doc_id long, t1 long, t2 long, n_shingles long")
    labelled = classes.join(found, classes["rep"] == found["node"], "left").select("t1", "t2", F.coalesce("component", "rep").alias("component"))
    return sized.join(labelled, ["t1", "t2"], "left").select(
        "doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op2_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(CASE WHEN len(words) < 5 THEN [1] ELSE range(1, len(words) - 3) END) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 75 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) c ON c.a = d.doc_id
"""
