"""What a scan did not see, beside its findings: files that are missing, oversized, unreadable or read in part.

Coverage rows are path, state, detail. They don't pass through policies, so nothing
that silences findings can hide that a file was not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.sources import formats

#: Fixed value: bytes of text that a scan reads of one file.
LIMIT = 5 << 20
STATES = ("missing", "oversized", "unreadable", "partial")


def _rows(df: DataFrame, state: str | Column, detail: Column) -> DataFrame:
    return df.select("path", (F.lit(state) if isinstance(state, str) else state).alias("state"), detail.alias("detail"))


def missing(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected paths without a file."""
    return _rows(expected.select("path").distinct().join(files.select("path"), "path", "left_anti"), "missing", F.lit(None).cast("string"))


def bounded(files: DataFrame, limit: int = LIMIT, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(files of at most ``limit`` bytes, coverage rows of the others and of those without content)."""
    size = F.octet_length(column)
    gone = files.where(F.col(column).isNull() | (size > limit))
    state = F.when(F.col(column).isNull(), "unreadable").otherwise("oversized")
    return files.where(size <= limit), _rows(gone, state, F.concat(size.cast("string"), F.lit(" bytes")))


def problems(files: DataFrame, readers: dict[str, str]) -> DataFrame:
    """Coverage rows of readers (name -> pattern of the paths that it reads): unreadable files, and files with odd entries as partial.

    A reader that runs Python tells itself what it could not read. Files of the
    others count as unreadable where they have no text.
    """
    out = []
    for name, pattern in readers.items():
        own = files.where(F.col("path").rlike(pattern))
        if name not in formats.WITH_PROBLEMS:
            out.append(_rows(own.where("text IS NULL"), "unreadable", F.lit(name)))
            continue
        told = formats.WITH_PROBLEMS[name](own).where("problem IS NOT NULL")
        state = F.when(F.col("problem").startswith("odd entry"), "partial").otherwise("unreadable")
        out.append(_rows(told, state, F.concat(F.lit(f"{name}: "), "problem")))
    return reduce(DataFrame.union, out)


def of_archives(members: DataFrame) -> DataFrame:
    """Coverage rows of ``formats.members``: members that were not read are partial, archives unreadable."""
    bad = members.where("problem IS NOT NULL")
    return _rows(bad, F.when(F.col("member").isNull(), "unreadable").otherwise("partial"), F.concat_ws(": ", "member", "problem"))


def per_file(coverage: DataFrame) -> DataFrame:
    """One row for each file: the worst state, and how many rows it had."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    worst = coverage.groupBy("path").agg(F.min(rank).alias("k"), F.count("*").alias("n"))
    return worst.select("path", F.element_at(F.array(*map(F.lit, STATES)), F.col("k").cast("int")).alias("state"), "n")


def as_findings(coverage: DataFrame) -> DataFrame:
    """path, rule (SCAN_MISSING and so on), severity info: to be united with findings after the policy."""
    return per_file(coverage).select("path", F.concat(F.lit("SCAN_"), F.upper("state")).alias("rule"), F.lit("info").alias("severity"))


def partial(targets: DataFrame, coverage: DataFrame, target: Column) -> DataFrame:
    """targets(target, partial) with partial also true where the coverage has a row of the target."""
    seen = coverage.select(target.alias("target")).distinct().withColumn("_seen", F.lit(True))
    return targets.join(seen, "target", "full").select("target", F.coalesce("partial", F.lit(False)).alias("was"), F.coalesce("_seen", F.lit(False)).alias("_seen")).select("target", (F.col("was") | F.col("_seen")).alias("partial"))
