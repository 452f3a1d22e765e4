"""Iterated joins: closures and reachability to the point where nothing is new, over cycles and paths of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.streaming.monitor import shared_folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame) -> DataFrame:
    """a, b, depth: every b that a reaches over edges(a, b), with the length of the shortest path.

    Paths are joined with paths, so the rounds grow with the logarithm of the
    longest shortest path; a cycle adds nothing after it is known. Edges with a null
    end count for nothing.
    """
    known = staged(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct().withColumn("depth", F.lit(1)), "closure")
    before = None
    while True:
        size = known.agg(F.count("*").alias("n"), F.sum("depth").alias("d")).first()
        if size == before:
            return known
        before = size
        longer = known.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b", (F.col("x.depth") + F.col("y.depth")).alias("depth"))
        known = staged(known.union(longer).groupBy("a", "b").agg(F.min("depth").alias("depth")), "closure")


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """key, origin: every node that a seed (key) reaches over edges (source, target), seeds included; origin is the smallest such seed.

    In each round edges also jump over nodes that have one way in and are no seeds,
    so a chain takes as many rounds as the logarithm of its length.
    """
    seen = staged(seeds.groupBy("key").agg(F.min("key").alias("origin")), "reached")
    starts, before = seen.select(F.col("key").alias("over")), None
    while True:
        step = seen.join(edges, seen["key"] == edges["source"]).select(F.col("target").alias("key"), "origin")
        seen = staged(seen.union(step).groupBy("key").agg(F.min("origin").alias("origin")), "reached")
        size = seen.agg(F.count("*").alias("n"), F.sum(F.xxhash64("key", "origin").cast("decimal(38,0)")).alias("h")).first()
        if size == before:
            return seen
        before = size
        ways = edges.groupBy(F.col("target").alias("over")).agg(F.count("*").alias("n"), F.min("source").alias("back")).where("n = 1").select("over", "back").join(starts, "over", "left_anti")
        edges = staged(edges.join(ways, edges["source"] == ways["over"], "left").select(F.coalesce("back", "source").alias("source"), "target").distinct(), "reached-edges")
