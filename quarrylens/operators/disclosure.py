"""Internal names and addresses in files that go public: rules by shape, told apart by their lexical context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import assess, contexts, families, rules

# Paths of documents, where only some rules count, and of examples, where none does.
PROSE, EXAMPLE = r"(?i)(^|/)(docs?/|readme|changelog)|\.(md|mdx|rst|txt)$", r"(?i)(^|/)(examples?|samples?|vendor|third[_-]party)/"
#: Contexts in which a rule counts; rules that aren't named count everywhere.
COUNTS = {
    "INTERNAL_HOSTNAME": ("quoted", "comment", "plain"), "INTERNAL_PRIVATE_IP": ("quoted", "comment", "plain"), "INTERNAL_SINGLE_LABEL_URL": ("quoted", "comment"),
    "INTERNAL_DEV_PATH": ("quoted", "comment", "plain"),
}
#: Rules that count in prose; there, plain text is what readers see, code is an example.
IN_PROSE = ("INTERNAL_PRIVATE_IP", "INTERNAL_HOSTNAME", "INTERNAL_GIT_REMOTE")


#: What a finding says more than another one on the same place.
RANK = {"INTERNAL_SINGLE_LABEL_URL": 3, "INTERNAL_GIT_REMOTE": 2}


def found(files: DataFrame, of: tuple[rules.Rule, ...] = families.INTERNAL) -> DataFrame:
    """path, line, rule, severity, start, match, context of the hits that count in their context, before caps.

    In a code file a single-label address counts inside strings and comments only (code
    has member accesses that look alike), in Markdown what stands in code is left out.
    """
    path = F.col("path")
    able = files.where(~path.rlike(EXAMPLE)).where(F.exists(F.array(*(F.coalesce(r.possible("text"), F.lit(False)) for r in of)), lambda x: x))
    each = contexts.lines(able)
    hits = []
    for r in of:
        match = r.value("content")
        row = F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.instr("content", match).alias("start"), match.alias("match"))
        hits.append(F.when(r.hits("content") & F.expr(rules.guard(r)), row))
    # hits first, as contexts are dearer than patterns
    hit = each.select("*", F.explode_outer(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).where("h IS NOT NULL")
    placed = hit.select("path", "line", "kind", "h.*", contexts.context(F.col("content"), F.col("h.start"), F.col("kind"), F.col("entry")).alias("context"))
    rule, where = F.col("rule"), F.col("context")
    counts = F.lit(True)
    for name, allowed in COUNTS.items():
        counts = counts & ((rule != name) | where.isin(*allowed))
    counts = F.col("kind").isin("markdown", "plain") | counts
    return placed.where(counts & (where != "markdown_code") & (rule.isin(*IN_PROSE) | ~path.rlike(PROSE))).drop("kind")


def scan(files: DataFrame, of: tuple[rules.Rule, ...] = families.INTERNAL, per_rule: int = 25, per_file: int = 100) -> DataFrame:
    """The findings that are reported: without those inside a longer one on their line, capped by rule and file."""
    rank = F.lit(1)
    for rule, k in RANK.items():
        rank = F.when(F.col("rule") == rule, k).otherwise(rank)
    spans = found(files, of).withColumnRenamed("path", "file").withColumn("stop", F.col("start") + F.length("match")).withColumn("rank", rank)
    return rules.capped(assess.without_overlaps(spans).withColumnRenamed("file", "path"), per_rule, per_file)
