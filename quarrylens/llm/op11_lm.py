"""Whole-document log-likelihood under a gated recurrent language model learned from the corpus.

Counts of all training tokens are a table that grows with the corpus. From it
come the unigram base, the model's head words and the estimates of what was never
seen. The network (see ``gru``) predicts a token's class and, for the head words,
the word; classes of the other words are their shapes (the last two bytes,
hashed). A word's part of its shape is its count less a discount, and the
discounts are the unknown words' part, so each step's probabilities add up to 1
over the known words and one unknown word a shape.

Training covers all training documents once, in two rounds: in each, every task
trains from the same network on its own documents, and the networks are averaged
by tokens, 16 at a time. The first round takes an eighth of the documents of each
slice, the second the others.

Codes of the tokens are staged once, with postings of the words that are not
among the ``COUNT_HEAD`` most frequent; these words' counts meet the postings
part by part (see ``tallies``). Words are told apart by 64 bits of a fingerprint.

Null and empty texts are the end token alone. Rows with a null id are scored and
neither held out nor learned from; rows that repeat an id are documents of their
own. A text of any length is scored whole, with the state carried on. Without
training rows nothing is known and every token is unknown. An empty table has no
rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import gru, tallies
from quarrylens.llm.common import Scratch, crc_mod, slices, utf8
from quarrylens.llm.kernels import Words, mix

#: Fingerprint of the token that ends each document.
END = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])
#: Words whose counts are broadcast (a megabyte).
COUNT_HEAD = 1 << 16
#: Tokens of a slice, and tokens that are counted before a task emits what it has.
SLICE_TOKENS = 1 << 21
#: Networks that are averaged in one task.
FAN_IN = 16
ROUND = 8
CODED = "slice long, part int, ids array<long>, held array<boolean>, train array<boolean>, sizes binary, codes binary, sums binary, docs binary, keys binary, times binary, tags binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SMALL = 0.1


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first and last row, fingerprints, shapes, words of each row) of parts of a text column."""
    raw, offs = utf8(column)
    for i, j in slices(offs):
        part = raw[offs[i] : offs[j]]
        w = Words(part, offs[i : j + 1] - offs[i], fold=True)
        low = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint64)
        last = low[w.ends - 1]
        other = np.where(w.ends - w.starts > 1, low[np.maximum(w.ends - 2, 0)], np.uint64(0))
        shape = (mix(last * np.uint64(257) + other) % np.uint64(gru.SHAPES)).astype(np.uint8)
        yield i, j, w.hash.view(np.int64), shape, w.counts


def counted(train: DataFrame) -> DataFrame:
    """word, shape, n over all training texts; the end token has shape -1."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = ends = 0

        def out() -> pa.RecordBatch:
            words, shapes = (np.concatenate(x) for x in zip(*held, strict=True))
            found = pa.table({"word": words, "shape": shapes}).group_by("word", use_threads=False).aggregate([("shape", "min"), ("word", "count")])
            return batch(*(found.column(c).to_numpy() for c in ("word", "shape_min", "word_count")))

        def batch(word: np.ndarray, shape: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(shape.astype(np.int8)), pa.array(n, pa.int64())], ["word", "shape", "n"])

        for b in batches:
            ends += len(b)
            for _, _, words, shapes, _ in tokens(b.column(0)):
                held.append((words, shapes))
                size += len(words)
                if size >= SLICE_TOKENS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()
        if ends:
            yield batch(np.array([END]), np.array([-1]), np.array([ends]))

    return train.select("text").mapInArrow(add, "word long, shape byte, n long").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


class Statistics:
    """What the counts say, in bounded size: totals, the head, estimates for each shape."""

    def __init__(self, counts: DataFrame):
        words = F.col("shape") >= 0
        row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(~words, F.col("n"))), F.lit(0)).alias("ends")).first()
        self.tokens, self.types = int(row["n"]), int(row["v"])
        top = counts.where(words).orderBy(F.desc("n"), "word").limit(COUNT_HEAD).toArrow()
        word, n, shape = (top.column(c).to_numpy() for c in ("word", "n", "shape"))
        head = min(gru.HEAD_WORDS - 1, len(word))
        self.head_counts = np.zeros(gru.HEAD_WORDS)
        self.head_counts[0], self.head_counts[1 : head + 1] = row["ends"], n[:head]
        by_shape = {r["shape"]: r for r in counts.where(words).groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2")).collect()}

        def rest(name: str, own: np.ndarray) -> np.ndarray:
            whole = np.array([by_shape[k][name] if k in by_shape else 0 for k in range(gru.SHAPES)], float)
            return whole - np.bincount(shape[:head], own, gru.SHAPES)

        self.shape_tokens = rest("n", n[:head].astype(float))
        types, one, two = rest("v", np.ones(head)), rest("n1", (n[:head] == 1).astype(float)), rest("n2", (n[:head] == 2).astype(float))
        self.discount = np.clip(one / np.maximum(one + 2 * two, 1), 0.1, 0.9)
        self.unknown = (self.discount * types + 1) / (self.shape_tokens + 1)
        # the head by fingerprint: word, count, code (0: not a head word)
        order = np.argsort(word)
        self.words, self.counts = word[order], n[order]
        self.codes = np.where(np.arange(len(word)) < head, np.arange(1, len(word) + 1), 0)[order]

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the most frequent words, whether it is the word)."""
        if not len(self.words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = pc.index_in(pa.array(words), value_set=pa.array(self.words))
        return at.fill_null(0).to_numpy(), at.is_valid().to_numpy(zero_copy_only=False)

    def terms(self, known: np.ndarray, n: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Whether known, log10 of the base's numerator, log10 of the word's part of its shape."""
        n = np.where(known, n, 0).astype(float)
        part = np.where(known, np.maximum(n - self.discount[shape], 1e-9) / (self.shape_tokens[shape] + 1), self.unknown[shape])
        return np.stack([known.astype(float), np.log10(n + SMALL), np.log10(part)], 1)


def coded(docs: DataFrame, stats: Statistics, parts: int) -> DataFrame:
    """CODED rows: of each slice of documents one with codes and what the frequent words give (part -1), and its postings."""
    share = docs.sparkSession.sparkContext.broadcast(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = share.value
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal held, number
            words, shapes, counts = (np.concatenate(x) for x in zip(*got, strict=True))
            n = len(rows)
            doc = np.repeat(np.arange(n), counts)
            at, hit = s.find(words)
            code = np.where(hit, s.codes[at] if len(s.codes) else 0, 0)
            tail = code == 0
            code = np.where(tail, gru.HEAD_WORDS + shapes.astype(np.int64), code).astype("<i2")
            sizes = counts + 1
            codes = np.zeros(int(sizes.sum()), "<i2")  # the end's code is 0
            codes[np.arange(len(words)) + doc] = code
            value = s.terms(hit, s.counts[at] if len(s.codes) else np.zeros(len(words)), shapes)
            value[~tail, 2] = 0
            sums = tallies.totals(hit.astype(float), doc, value, n)
            ends = s.head_counts[0]
            sums += [float(ends > 0), np.log10(ends + SMALL), 0.0]
            ids, held_out, train = zip(*rows, strict=True)
            rest = ~hit
            out = [(number, -1, ids, held_out, train, sizes.astype("<i8").tobytes(), codes.tobytes(), np.ascontiguousarray(sums, "<f8").tobytes(), None, None, None, None)]
            for sid, p, d, k, t, g in tallies.postings(number, doc[rest], words[rest], np.ones(int(rest.sum()), np.uint32), shapes[rest], parts):
                out.append((sid, p, None, None, None, None, None, None, d, k, t, g))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), *[pa.binary()] * 7]
            rows.clear()
            got.clear()
            held, number = 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in CODED.split(", ")])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            for i, j, words, shapes, counts in tokens(b.column(3)):
                rows += keys[i:j]
                got.append((words, shapes, counts))
                held += len(words) + j - i
                if held >= SLICE_TOKENS:
                    yield block()
        if rows:
            yield block()

    held = crc_mod("doc_id", 10) == 0
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(held, F.lit(False)), F.coalesce(~held, F.lit(False)), F.col("text").cast("string")).mapInArrow(run, CODED)


def selected(codes: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes[np.repeat(pick, sizes)], sizes[pick]


def averaged(networks: DataFrame, tasks: int) -> np.ndarray | None:
    """Mean of networks (bucket, tokens, net) by tokens: in groups of FAN_IN, again and again."""

    def mean(t: pa.Table) -> pa.Table:
        n = t.column("tokens").to_numpy()
        total = sum(np.frombuffer(x, "<f4").astype(float) * k for x, k in zip(t.column("net").to_pylist(), n.tolist(), strict=True))
        return pa.table({"bucket": [t.column("bucket")[0].as_py()], "tokens": [int(n.sum())], "net": [(total / n.sum()).astype("<f4").tobytes()]})

    while tasks > FAN_IN:
        networks = networks.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).groupBy("bucket").applyInArrow(mean, "bucket long, tokens long, net binary")
        tasks = -(-tasks // FAN_IN)
    rows = networks.collect()
    return sum(np.frombuffer(r["net"], "<f4").astype(float) * r["tokens"] for r in rows) / sum(r["tokens"] for r in rows) if rows else None


def trained(slices_: DataFrame, stats: Statistics) -> np.ndarray:
    """The network after both rounds over ``slices_`` (train, sizes, codes)."""
    net = gru.pack(gru.initial(stats.head_counts, stats.shape_tokens))
    for second in (False, True):
        share = slices_.sparkSession.sparkContext.broadcast(net)

        def learn(batches: Iterator[pa.RecordBatch], share=share, second=second) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(gru.unpack(share.value))
            for b in batches:
                for train, sizes, codes in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    pick = np.array(train, bool) & ((np.arange(len(train)) % ROUND == 0) != second)
                    if pick.any():
                        trainer.learn(*selected(np.frombuffer(codes, "<i2").astype(np.int64), np.frombuffer(sizes, "<i8"), pick))
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([trainer.tokens]), pa.array([gru.pack(trainer.p).astype("<f4").tobytes()], pa.binary())], ["bucket", "tokens", "net"])

        mean = averaged(slices_.mapInArrow(learn, "bucket long, tokens long, net binary"), slices_.rdd.getNumPartitions())
        net = net if mean is None else mean.astype(np.float32)
        share.unpersist()
    return net


def scored(slices_: DataFrame, net: np.ndarray) -> DataFrame:
    """Slices with the network's part of each document's score, in log10."""
    share = slices_.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gru.unpack(share.value)
        for b in batches:
            out = []
            for sizes, codes in zip(b.column("sizes").to_pylist(), b.column("codes").to_pylist(), strict=True):
                sizes = np.frombuffer(sizes, "<i8")
                logp = gru.log_probabilities(p, np.frombuffer(codes, "<i2").astype(np.int64), sizes)
                out.append((np.add.reduceat(logp, np.cumsum(sizes) - sizes) / np.log(10)).astype("<f8").tobytes())
            cols = [b.column(c) for c in ("slice", "ids", "held", "sizes", "sums")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], ["slice", "ids", "held", "sizes", "sums", "net"])

    return slices_.mapInArrow(run, "slice long, ids array<long>, held array<boolean>, sizes binary, sums binary, net binary")


def score(docs: DataFrame) -> DataFrame:
    """RESULT: one row per row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    counts = scratch.stage(counted(docs.where(crc_mod("doc_id", 10) != 0)), "counts")
    stats = Statistics(counts)
    parts = tallies.parts_for(stats.types, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = scratch.stage(coded(docs, stats, parts), "coded")
    own = table.where("part < 0")
    net = trained(own.select("train", "sizes", "codes"), stats)
    small = spark.sparkContext.broadcast((stats.discount, stats.shape_tokens, stats.unknown))

    def terms(found: np.ndarray, got: list[np.ndarray], keys: np.ndarray, tags: np.ndarray) -> np.ndarray:
        s = Statistics.__new__(Statistics)
        s.discount, s.shape_tokens, s.unknown = small.value
        return s.terms(found, got[0], tags)

    posted = table.where("part >= 0").select("slice", "part", "docs", "keys", "times", "tags")
    values = counts.where("shape >= 0").select(F.col("word").alias("key"), "n").withColumn("part", tallies.part_column("key", parts))
    sums = tallies.resolve(posted, values, ["n"], terms)
    total, floor = stats.tokens, float(np.log10(stats.tokens + SMALL * (stats.types + 1)))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in RESULT.split(", ")]
        for b in left.to_pylist():
            n, net_part = np.frombuffer(b["sizes"], "<i8"), np.frombuffer(b["net"], "<f8")
            s = np.frombuffer(b["sums"], "<f8").reshape(len(n), 3) + tallies.read_sums(right, len(n), 3)
            known = np.rint(s[:, 0]).astype(np.int64)
            for c, v in zip(cols, (b["ids"], b["held"], n.tolist(), known.tolist(), [total] * len(n), (s[:, 1] - n * floor).tolist(), (net_part + s[:, 2]).tolist()), strict=True):
                c.extend(v)
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    left = scored(own.select("slice", "ids", "held", "sizes", "codes", "sums"), net)
    return left.groupBy("slice").cogroup(sums.groupBy("slice")).applyInArrow(finish, RESULT)


def op11_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
