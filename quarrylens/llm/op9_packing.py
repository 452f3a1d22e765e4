"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Documents become token ids with a separator after each; ids are cut into pieces
of at most ``seq_len``; full pieces are sequences of their own. The other pieces
are sorted by length, descending, and each goes to the sequence with the lowest
estimated attention cost (linear plus quadratic in each piece's length, as
pieces attend within themselves) that still has room for it. When none has
room, the piece is cut and fills the roomiest ones, so that only the last
sequence of a block can end up short of ``seq_len``.

Packing is done in blocks of about ``block_tokens`` tokens inside the tasks that
tokenise: nothing is shuffled, a block bounds the memory, and the padding is
below one sequence per block. Sequence ids hold the partition and a running
number, so they are unique without coordination, and a task that runs again
gives the same ids for the same rows.

Nulls and empty texts are documents of the separator alone. Rows that repeat a
doc_id, and rows with a null one, are packed as documents of their own. A very
long text is a block of its own, whole. Pieces of equal length are placed in the
order of their rows; of sequences of equal cost the first takes the piece. An
empty table gives no pieces. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQ_LEN = 1024
SEPARATOR = 0
SPECIAL = "<|endoftext|>"
#: Tokens of a block; the tail of a block is the only padding.
BLOCK_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(json_path: str, ranks_path: str):
    """text -> uint32 ids, as the tokenizers library gives them for ``json_path`` without special tokens added.

    The ranks of the same vocabulary are read by tiktoken, which takes a third of
    the time or less; a text that spells the special token is left to the
    tokenizers library itself. Equality is tested on whole tables.
    """
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(ranks_path, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except UnicodeEncodeError:
            return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def balance(lengths: np.ndarray, seq_len: int, linear: float = 1.0, quadratic: float = 1.0 / SEQ_LEN) -> list[tuple[int, int, int, int]]:
    """Places of pieces shorter than ``seq_len``: (piece, start within it, length, sequence).

    Descending pieces; lowest-cost sequence with room; cut where none has room.
    """
    order = np.argsort(-lengths, kind="stable")
    count = int(-(-int(lengths.sum()) // seq_len))
    room = np.full(count, seq_len, np.int64)
    cost = np.zeros(count)
    placed = []
    for i in order:
        at, left = 0, int(lengths[i])
        while left:
            fits = room >= left
            if fits.any():
                s = int(np.argmin(np.where(fits, cost, np.inf)))
                take = left
            else:
                s = int(np.argmax(room))
                take = int(room[s])
            placed.append((int(i), at, take, s))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            at += take
            left -= take
    return placed


def pack_block(ids: list[np.ndarray], seq_len: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a block of documents."""
    out, seq, tails = [], 0, []
    for d, x in enumerate(ids):
        for at in range(0, len(x) - seq_len + 1, seq_len):
            out.append((d, at, seq_len, seq, 0))
            seq += 1
        if rest := len(x) % seq_len:
            tails.append((d, len(x) - rest, rest))
    if tails:
        fill: dict[int, int] = {}
        for i, at, take, s in balance(np.array([t[2] for t in tails], np.int64), seq_len):
            d, start, _ = tails[i]
            out.append((d, start + at, take, seq + s, fill.get(s, 0)))
            fill[s] = fill.get(s, 0) + take
    return out


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    paths = paths or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        part = TaskContext.get().partitionId() << 32
        sequences = 0
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0
        end = np.array([SEPARATOR], np.uint32)

        def block() -> pa.RecordBatch:
            nonlocal sequences, held
            pieces = pack_block(ids, seq_len)
            cols = list(zip(*pieces, strict=True))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[d] for d in cols[0]], pa.int64()),
                    pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.int64()),
                    pa.array([len(ids[d]) for d in cols[0]], pa.int64()),
                    pa.array([part + sequences + s for s in cols[3]], pa.int64()),
                    pa.array(cols[4], pa.int64()),
                    pa.array([ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces], pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            sequences += max(cols[3]) + 1
            keys.clear()
            ids.clear()
            held = 0
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py()
                x = np.concatenate([encode(t), end]) if t else end
                keys.append(key)
                ids.append(x)
                held += len(x)
                if held >= block_tokens:
                    yield block()
        if ids:
            yield block()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op9_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digest(pieces)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
