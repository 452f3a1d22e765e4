"""From raw documents to packed sequences, in five stages over the operators of quarrylens.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage judges all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import op1_language_id, op2_jaccard_join, op4_decontamination, op7_substring_dedup, op9_packing
from quarrylens.llm.common import Scratch

#: Ids that are broadcast at most.
BROADCAST_IDS = 2_000_000
#: Posterior below which a predicted language is not trusted.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no letter, null, or a posterior below MIN_SCORE.

    Rows are judged by their text alone: null and repeated ids, repeated rows and
    long texts are no matter. Without any labelled row all go, as nothing is
    recognised. Extra columns are kept.
    """
    model = op1_language_id.fit(op1_language_id.train_rows(docs))
    seen = op1_language_id.with_language(docs, model)
    found = F.col(seen.columns[-1])
    return seen.where((found["lang"] != "und") & (found["score"] >= MIN_SCORE)).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates stays.

    Rows with a null id or without words stay; rows that repeat an id stay or go
    together. Long texts are read whole, extra columns kept, and an empty table
    stays empty.
    """
    gone = Scratch(spark, "jaccard-gone").stage(op2_jaccard_join.join(docs).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    # texts need not be shuffled where the ids to remove are few enough to broadcast (16 MB)
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(few, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 50-word passages are cut; a document of which nothing is left goes. n_chars follows the text.

    Rows with a null id are left alone, null texts become empty ones, rows that
    repeat an id don't cut each other, long texts are read whole, and the passage
    in the smallest id stays. Extra columns are kept; an empty table stays empty.
    """
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = op7_substring_dedup.dedup(docs, with_text=True, carry=carry)
    kept = cut.where("n_removed = 0 OR n_removed < n_words")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*(columns[c].alias(c) if c in columns else F.col("carried")[c].alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Each row is judged by its own text, so null and repeated ids are no matter.

    Null and empty texts stay, long ones are searched whole, extra columns are
    kept, and an empty table, or an empty benchmark, removes nothing.
    """
    return op4_decontamination.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids (little-endian uint32).

    Each row is packed, whatever its id, repeated rows too; null and empty texts
    are the separator alone, long texts are cut freely, extra columns are left.
    """
    pieces = op9_packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Language ID and tokenisation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        staged = scratch.stage(out, name)
        scratch.drop(docs)
        docs = staged
    return docs
