"""Adapters: the driver's tables in the roles of files, findings, dependencies, history and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer splits than that (a small table of one row group); otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as path, source, text."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "source", "text")


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as target, seq, rule (status and month), severity, confidence, file, line."""
    o = table(spark, sf_dir, "orders")
    priority = F.substring("o_orderpriority", 1, 1)
    severity = F.when(priority == "1", "critical").when(priority == "2", "high").when(priority == "3", "medium").when(priority == "4", "low").otherwise("info")
    return o.select(
        F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("seq"),
        F.concat(F.col("o_orderstatus"), F.lit("-"), F.date_format("o_orderdate", "MM")).alias("rule"), severity.alias("severity"),
        ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"), F.concat(F.lit("f"), (F.col("o_orderkey") % 97).cast("string")).alias("file"),
        (F.col("o_orderkey") % 31).alias("line"), "o_orderdate", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"),
    )


# Folders that a scan does not enter.
EXCLUDED = ("node_modules", ".git", "__pycache__", ".venv", "venv", ".claude")


def tree(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, max_depth: int = 20) -> DataFrame:
    """Files below a folder as path, rel (below the root), size, content, depth; folders that are excluded or too deep are not entered.

    Only what lies below the root counts: the root itself may have any name.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = raw.withColumn("rel", F.regexp_extract("path", r"\Q" + root.rstrip("/").removeprefix("file:") + r"\E/+(.*)$", 1))
    folders = F.slice(F.split("rel", "/"), 1, F.greatest(F.size(F.split("rel", "/")) - 1, F.lit(0)))
    inside = named.where(~F.arrays_overlap(folders, F.array(*map(F.lit, excluded)))).withColumn("depth", F.size(folders))
    return inside.where(F.col("depth") <= max_depth).select("path", "rel", F.col("length").alias("size"), "content", "depth")
