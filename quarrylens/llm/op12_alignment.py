"""Alignment of two tokenizers over whole documents, and how often their tokens meet in the corpus.

Both tokenizers cut the same bytes (a space and the text). For a slice of
documents the ends of all tokens are running sums of their byte lengths; cuts
are the ends that both have (``intersect1d``); a token's group is the place of
its end among the cuts (``searchsorted``). Each A token is repeated for every B
token that its bytes overlap, which gives the links.

Links are counted by id pair in two stages: tasks emit what they have added up
under a salt, sums by (pair, salt) come first, then sums by pair. A B id's best
count is its largest. Counts of the ``HEAD`` most frequent pairs are broadcast;
the others meet the documents' pairs part by part (see ``tallies``), so that no
row is made for a link.

Documents that are null or empty, or whose tokens don't spell a space and the
text (B writes U+2581 for a space, so texts that hold U+2581 are among them),
have no tokens: zeros and an empty digest. Rows that repeat an id, or have none,
are documents of their own. A text of any length is encoded whole; one that is
longer than a slice is a slice of its own. An empty table has no rows. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import tallies
from quarrylens.llm.common import SLICE_BYTES, Scratch

#: Pairs whose counts are broadcast (24 bytes each).
HEAD = 1 << 16
#: Salts of the first stage.
SALTS = 16
#: Words whose pieces a worker remembers, and pairs that it adds up before it emits them.
WORDS, HELD_PAIRS = 1 << 18, 1 << 21
#: B ids take so many bits of a pair.
B_BITS = 20
ENCODED = "slice long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, docs binary, keys binary, times binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def tokenizer_paths() -> tuple[str, str]:
    """The ranks of byte_bpe_50k.json's vocabulary, and piece_bpe_32k.model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class ByteBpe:
    """A: ids of a space and the text; special tokens' strings are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self._enc = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and n + 1 offsets."""
        ids = [self._enc.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)).astype(np.int64), np.cumsum([0, *map(len, ids)])


class Pieces:
    """B: ids of a text, word by word: no piece holds a space after another character, so merges never cross words.

    (The constructor makes sure of that; otherwise whole texts are encoded.)
    Pieces of the words of earlier slices are remembered.
    """

    def __init__(self, path: str, limit: int = WORDS):
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._sp.id_to_piece(i) for i in range(self._sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self._sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in names)
        self._limit, self._at, self._ids, self._from = limit, {}, np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self._at]
        if len(self._at) + len(new) > self._limit:
            self._at, self._ids, self._from = {}, np.zeros(0, np.int64), np.zeros(1, np.int64)
            new = list(dict.fromkeys(words))
        if new:
            got = self._sp.encode(new, num_threads=1)
            self._at |= {w: len(self._at) + k for k, w in enumerate(new)}
            self._ids = np.concatenate([self._ids, np.fromiter((i for x in got for i in x), np.int64)])
            self._from = np.append(self._from, self._from[-1] + np.cumsum([len(x) for x in got]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            got = self._sp.encode(texts, num_threads=1)
            return np.fromiter((i for x in got for i in x), np.int64), np.cumsum([0, *map(len, got)])
        words, counts = [], []
        for t in texts:
            own = split(t)
            words += own
            counts.append(len(own))
        self._learn(words)
        at = np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))
        n = self._from[at + 1] - self._from[at]
        ends = np.cumsum(n)
        ids = self._ids[np.repeat(self._from[at] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.append(0, ends)[np.cumsum([0, *counts])]


def split(text: str) -> list[str]:
    """Words with the spaces that stand before them but one, the last with those after it; joined by a space they are the text."""
    own = text.split(" ")
    if "" not in own:
        return own
    out, spaces = [], 0
    for w in own[:-1]:
        if w:
            out.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    if own[-1]:
        out.append(" " * spaces + own[-1])
    elif out:
        out[-1] += " " * (spaces + 1)
    else:
        return [text]
    return out


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), Pieces(b_path)
        self._len_a, self._len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # an id and the sign after it: within a side, or at its end
        signs = ((self.a.bytes, b",", b"|"), (self.b.bytes, b",", b";"))
        self._spelt = [b"%d" % i + s for table, *two in signs for s in two for i in range(len(table))]

    def spells(self, table: list[bytes], ids: np.ndarray, offs: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether the tokens of each text are a space and the text."""
        return np.array([b"".join(map(table.__getitem__, ids[offs[k] : offs[k + 1]].tolist())) == b" " + t.encode() for k, t in enumerate(texts)], bool)

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list[str]]:
        """For each text counts of tokens, groups and links and the groups' digest; for each (text, pair) the links."""
        a, off_a = self.a.encode(texts)
        b, off_b = self.b.encode(texts)
        n = len(texts)
        ok = self.spells(self.a.bytes, a, off_a, texts) & self.spells(self.b.bytes, b, off_b, texts)
        doc_a, doc_b = (np.repeat(np.arange(n), np.diff(o)) for o in (off_a, off_b))
        a, doc_a = a[ok[doc_a]], doc_a[ok[doc_a]]
        b, doc_b = b[ok[doc_b]], doc_b[ok[doc_b]]
        end_a, end_b = np.cumsum(self._len_a[a]), np.cumsum(self._len_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        # the B tokens that each A token's bytes overlap
        first = np.searchsorted(end_b, end_a - self._len_a[a], side="right")
        many = np.searchsorted(end_b, end_a, side="left") - first + 1
        upto = np.cumsum(many)
        left = np.repeat(np.arange(len(a)), many)
        right = np.repeat(first - upto + many, many) + np.arange(len(left))
        pair = (doc_a[left] << 40) | (a[left] << B_BITS) | b[right]
        pair, times = np.unique(pair, return_counts=True)
        cut_doc = doc_a[np.searchsorted(end_a, cuts)]
        counts = {k: np.bincount(x, minlength=n) for k, x in (("n_a", doc_a), ("n_b", doc_b), ("n_groups", cut_doc), ("n_links", doc_a[left]))}
        return counts | {"sha": self._digests(a, b, group_a, group_b, cuts, counts), "docs": pair >> 40, "keys": pair & ((1 << 40) - 1), "times": times}

    def _digests(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, cuts: np.ndarray, counts: dict[str, np.ndarray]) -> list[str]:
        per_a, per_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        code = np.empty(len(a) + len(b), np.int64)
        # a group's A tokens, then its B tokens
        ends_a, ends_b = np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        code[np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]] = a + ends_a * len(self.a.bytes)
        code[np.arange(len(b)) + np.cumsum(per_a)[group_b]] = 2 * len(self.a.bytes) + b + ends_b * len(self.b.bytes)
        spelt = list(map(self._spelt.__getitem__, code.tolist()))
        edge = np.append(0, np.cumsum(counts["n_a"] + counts["n_b"])).tolist()
        return [sha256(b"".join(spelt[s:e])[:-1]).hexdigest() if e > s else "" for s, e in zip(edge[:-1], edge[1:], strict=True)]


def encode(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """ENCODED rows, one a slice of documents."""
    paths = paths or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[str] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal number, held
            got = aligner.align(texts)
            row = [[number], [list(ids)], *([got[k].tolist()] for k in ("n_a", "n_b", "n_groups", "n_links")), [got["sha"]]]
            row += [[got[k].astype(t).tobytes()] for k, t in (("docs", "<i4"), ("keys", "<i8"), ("times", "<u4"))]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.binary()] * 3]
            ids.clear()
            texts.clear()
            number, held = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], [x.split()[0] for x in ENCODED.split(", ")])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py() or ""
                ids.append(key)
                texts.append(t)
                held += len(t) + 64
                if held >= SLICE_BYTES:
                    yield block()
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def counted(encoded: DataFrame) -> DataFrame:
    """pair (A id << B_BITS | B id), n: links of the whole corpus, in two stages under a salt."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        held = 0
        salt = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            pair, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(times)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.full(len(pair), salt % SALTS, np.int32)), pa.array(n)], ["pair", "salt", "n"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(np.frombuffer(k, "<i8"))
                times.append(np.frombuffer(t, "<u4"))
                held += len(keys[-1])
                if held >= HELD_PAIRS:
                    yield out()
                    keys, times, held = [], [], 0
        if held:
            yield out()

    rows = encoded.select("keys", "times").mapInArrow(add, "pair long, salt int, n long")
    return rows.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(documents as in RESULT, pairs: a_id, b_id, n, best) of a corpus."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    encoded = scratch.stage(encode(docs, paths), "encoded")
    plain = scratch.stage(counted(encoded), "counts")
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    # one row for each B id: as many as the vocabulary has
    most = plain.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    pairs = scratch.stage(plain.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select(F.col("pair").alias("key"), "n", (F.col("n") == F.col("most")).cast("int").alias("best")), "pairs")
    scratch.drop(plain)
    top = pairs.orderBy(F.desc("n"), "key").limit(head).toArrow()
    order = np.argsort(top.column("key").to_numpy())
    known = [top.column(c).to_numpy()[order].astype(np.int64) for c in ("key", "n", "best")]
    parts = tallies.parts_for(pairs.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = spark.sparkContext.broadcast(known)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the broadcast pairs give, as SUMS in the columns docs and keys under the part -1; postings of the others."""
        key, n, best = share.value
        for b in batches:
            for sid, docs, pair, times in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                docs, pair, times = np.frombuffer(docs, "<i4"), np.frombuffer(pair, "<i8"), np.frombuffer(times, "<u4")
                if not len(pair):
                    continue
                at = np.minimum(np.searchsorted(key, pair), len(key) - 1)
                hit = key[at] == pair
                own, doc_at = np.unique(docs[hit], return_inverse=True)
                sums = tallies.totals(times[hit], doc_at, np.stack([best[at[hit]], n[at[hit]]], 1).astype(float), len(own))
                _, d, s = tallies.sums_batch(sid, own, sums)
                rest = ~hit
                rows = tallies.postings(sid, docs[rest], pair[rest], times[rest], np.zeros(int(rest.sum()), np.uint8), parts)
                yield tallies.posting_batch([(sid, -1, d, s, b"", b""), *rows])

    posted = scratch.stage(encoded.select("slice", "docs", "keys", "times").mapInArrow(route, tallies.POSTINGS), "posted")
    # best and n of each posting; all pairs are in the table
    more = tallies.resolve(posted.where("part >= 0"), pairs.withColumn("part", tallies.part_column("key", parts)), ["best", "n"], lambda found, got, keys, tags: np.stack(got, 1).astype(float))
    sums = posted.where("part < 0").select("slice", "docs", F.col("keys").alias("sums")).union(more)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in RESULT.split(", ")]
        for b in left.to_pylist():
            s = np.rint(tallies.read_sums(right, len(b["ids"]), 2)).astype(np.int64)
            for c, v in zip(cols, (b["ids"], b["n_a"], b["n_b"], b["n_groups"], b["n_links"], s[:, 0].tolist(), s[:, 1].tolist(), b["sha"]), strict=True):
                c.extend(v)
        return pa.table([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(cols)], names=[x.split()[0] for x in RESULT.split(", ")])

    own = encoded.drop("docs", "keys", "times")
    out = own.groupBy("slice").cogroup(sums.groupBy("slice")).applyInArrow(finish, RESULT)
    return out, pairs.select(F.shiftright("key", B_BITS).alias("a_id"), F.col("key").bitwiseAND((1 << B_BITS) - 1).alias("b_id"), "n", (F.col("best") == 1).alias("best"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
