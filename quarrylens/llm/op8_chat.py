"""Chat formatting with cumulative-snapshot collapse.

A logged conversation whose turns are the first turns of a longer one is a
snapshot of it. Each turn is hashed with its place, and the running exclusive-or
of these hashes (two independent 64-bit ones) is the fingerprint of the prefix
that ends there. Conversations are grouped by (turns, fingerprint), the smallest
id of each group staying; an anti-join with the fingerprints of proper prefixes
leaves the maximal ones, which are rendered.

Only ids and hashes are shuffled for the search; texts are shuffled once, for
the conversations that stay. Conversations of more than ``LONG_TURNS`` turns or
``ROW_BYTES`` bytes are dealt into ranges of turns instead, texts included:
places, bytes and fingerprints run within a range, and the totals of the
earlier ranges are added. So no task holds a conversation that grows with the
input. A chat of more than ``ROW_BYTES`` comes in several rows, numbered by
chunk.

Turns are ordered by turn, then role and text, so turns that tie have a defined
order. A null conv_id names no conversation: each such row is one of a single
turn. Null roles render as ``unknown``, null texts as nothing. Exactly repeated
turn rows count as turns. In roles and texts a backslash is doubled and ``<|``
becomes ``<\\|``, so that no text can forge a turn. Of equal conversations the
smallest id stays. An empty table gives no chats. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.common import Scratch

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
#: A conversation of more turns is dealt into ranges of about RANGE_TURNS turns or RANGE_BYTES bytes.
LONG_TURNS, RANGE_TURNS, RANGE_BYTES = 100_000, 200_000, 32 << 20
#: Bytes of chat at which a further row begins.
ROW_BYTES = 64 << 20


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def hashes() -> tuple[Column, Column]:
    return F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b")


def in_place(pos: Column) -> tuple[Column, Column]:
    """The hashes a, b of a turn with its place (long)."""
    return F.xxhash64(pos, "a", "b").alias("a"), F.xxhash64(pos, "b", F.lit(11), "a").alias("b")


def escaped(column: str) -> Column:
    """The column with its delimiters escaped, so that no text can pass for a turn; reversible."""
    return F.replace(F.replace(F.col(column), F.lit("\\"), F.lit("\\\\")), F.lit(OPEN), F.lit("<\\|"))


def piece() -> Column:
    return F.concat(F.lit(OPEN), escaped("role"), F.lit(MIDDLE), escaped("text"), F.lit("\n" + CLOSE)).alias("t")


def long_conversations(turns: DataFrame, long_turns: int, row_bytes: int) -> DataFrame:
    """conv_id, n (turns), size (bytes of chat) of the conversations that are dealt into ranges."""
    size = F.octet_length(escaped("role")) + F.octet_length(escaped("text")) + len(OPEN + MIDDLE + "\n" + CLOSE)
    known = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("size"))
    return known.where((F.col("n") > long_turns) | (F.col("size") > row_bytes))


def ranged(turns: DataFrame, long: DataFrame, parts: int) -> DataFrame:
    """The turns of long conversations with their range: part. To be staged, as the ranges are sampled."""
    salted = turns.join(long.select("conv_id", "n"), "conv_id").select("conv_id", "n", "turn", *hashes(), piece(), F.monotonically_increasing_id().alias("salt"))
    order = ["conv_id", "turn", "a", "b", "salt"]  # equal turns differ by salt, so that they can be parted
    return salted.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def in_ranges(dealt: DataFrame) -> DataFrame:
    """dealt with pos (from 1), off (bytes of chat before the turn), and a, b with the place."""
    size = F.octet_length("t").cast("long")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("k"), F.sum(size).alias("s"))
    before = totals.select("conv_id", "part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in "ks"))
    here = Window.partitionBy("conv_id", "part").orderBy("turn", "a", "b", "salt")
    own = dealt.withColumn("pos", F.row_number().over(here).cast("long")).withColumn("off", F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, 0)) - size)
    moved = own.join(before, ["conv_id", "part"]).withColumn("pos", F.col("pos") + F.col("k")).withColumn("off", F.col("off") + F.col("s"))
    return moved.select("conv_id", "n", "part", "pos", "off", *in_place(F.col("pos")), "t")


def range_prefixes(placed: DataFrame) -> DataFrame:
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("conv_id", "part").agg(F.expr("bit_xor(a)").alias("x"), F.expr("bit_xor(b)").alias("y"))
    before = totals.select("conv_id", "part", *(F.coalesce(F.expr(f"bit_xor({c})").over(earlier), F.lit(0)).alias(c) for c in "xy"))
    here = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.select("conv_id", "part", "pos", "n", F.expr("bit_xor(a)").over(here).alias("a"), F.expr("bit_xor(b)").over(here).alias("b"))
    return own.join(before, ["conv_id", "part"]).select("conv_id", "pos", F.col("a").bitwiseXOR(F.col("x")).alias("h1"), F.col("b").bitwiseXOR(F.col("y")).alias("h2"), "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1, h2: the fingerprint of the first pos turns, n (turns of the conversation)."""
    hashed = turns.select("conv_id", "turn", *hashes())
    order = Window.partitionBy("conv_id").orderBy("turn", "a", "b")
    placed = hashed.withColumn("pos", F.row_number().over(order).cast("long"))
    placed = placed.select("conv_id", "pos", *in_place(F.col("pos")))
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(
        "conv_id", "pos", F.expr("bit_xor(a)").over(so_far).alias("h1"), F.expr("bit_xor(b)").over(so_far).alias("h2"),
        F.count("*").over(Window.partitionBy("conv_id")).alias("n"),
    )


def single_turns(turns: DataFrame) -> DataFrame:
    """h1, h2, t of each row without conv_id, as a conversation of one turn."""
    a, b = in_place(F.lit(1).cast("long"))
    return turns.where("conv_id IS NULL").select("conv_id", *hashes(), piece()).select("conv_id", a.alias("h1"), b.alias("h2"), "t")


def maximal(p: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations of exactly these turns), h1, h2 of the conversations to keep."""
    longer = p.where("pos < n").select("pos", "h1", "h2").distinct()
    whole = p.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    kept = whole.join(longer, (whole["n"] == longer["pos"]) & (whole["h1"] == longer["h1"]) & (whole["h2"] == longer["h2"]), "left_anti")
    return kept.select("conv_id", F.col("n").alias("n_turns"), "n_copies", "h1", "h2")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    own = turns.join(kept.select("conv_id", "n_turns", "n_copies"), "conv_id")
    row = F.struct("turn", *hashes(), piece())
    return own.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["t"]), "").alias("chat")).withColumn("chunk", F.lit(0).cast("long"))


def render_single(turns: DataFrame, kept: DataFrame) -> DataFrame:
    own = single_turns(turns).drop("conv_id").join(kept.where("conv_id IS NULL"), ["h1", "h2"])
    return own.groupBy("conv_id", "n_turns", "n_copies", "h1", "h2").agg(F.first("t").alias("chat")).select("conv_id", "n_turns", "n_copies", "chat", F.lit(0).cast("long").alias("chunk"))


def render_ranges(placed: DataFrame, kept: DataFrame, row_bytes: int) -> DataFrame:
    own = placed.join(kept.select("conv_id", "n_turns", "n_copies"), "conv_id").withColumn("chunk", F.floor(F.col("off") / row_bytes))
    row = F.struct("pos", "t")
    chat = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["t"]), "").alias("chat")
    return own.groupBy("conv_id", "n_turns", "n_copies", "chunk").agg(chat).select("conv_id", "n_turns", "n_copies", "chat", "chunk")


def collapse_and_render(conversations: DataFrame, long_turns: int = LONG_TURNS, row_bytes: int = ROW_BYTES, range_turns: int = RANGE_TURNS) -> DataFrame:
    """conv_id, n_turns, n_copies, chat, chunk (from 0; above 0 only in chats of more than row_bytes)."""
    turns = turns_of(conversations)
    scratch = Scratch(conversations.sparkSession, "chat")
    long = scratch.stage(long_conversations(turns, long_turns, row_bytes), "long")
    known, total = turns.where("conv_id IS NOT NULL"), long.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    single = single_turns(turns).select("conv_id", F.lit(1).cast("long").alias("pos"), "h1", "h2", F.lit(1).cast("long").alias("n"))
    if not total["n"]:
        kept = maximal(prefixes(known).union(single))
        return render(known, kept).union(render_single(turns, kept))
    parts = 1 + max(total["n"] // range_turns, total["size"] // RANGE_BYTES)
    placed = in_ranges(scratch.stage(ranged(known, long, parts), "ranged"))
    known = known.join(long, "conv_id", "left_anti")
    kept = scratch.stage(maximal(reduce(DataFrame.union, [prefixes(known), single, range_prefixes(placed)])), "kept")
    few = kept.join(long.select("conv_id"), "conv_id", "left_semi")
    return reduce(DataFrame.union, [render(known, kept), render_single(turns, kept), render_ranges(placed, few, row_bytes)])


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), "chat", "chunk"
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
p AS (
  SELECT conv_id, pos, n,
         string_agg(md5(role || chr(31) || text), ',') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t),
whole AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY 1, 2),
kept AS (
  SELECT * FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.prefix = w.prefix))
SELECT k.conv_id, k.n::BIGINT AS n_turns, k.n_copies::BIGINT AS n_copies,
       string_agg('<|' || replace(replace(role, '\\', '\\\\'), '<|', '<\\|') || '|>' || chr(10) || replace(replace(text, '\\', '\\\\'), '<|', '<\\|') || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.pos) AS chat,
       0::BIGINT AS chunk
FROM kept k JOIN t ON t.conv_id = k.conv_id
GROUP BY 1, 2, 3
"""
