"""What follows from findings: attack graph, remediations, triage states, volatility of a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions.scalars import severity_rank


def graph_nodes(hits: DataFrame) -> DataFrame:
    """id, type, n of the repositories (source), files (path) and rules of hits."""
    kinds = {"repository": "source", "file": "path", "rule": "rule"}
    each = hits.select(F.explode(F.array(*(F.struct(F.lit(k).alias("type"), F.col(c).alias("id")) for k, c in kinds.items()))).alias("node"))
    return each.groupBy("node.type", "node.id").agg(F.count("*").alias("n"))


def graph_edges(hits: DataFrame) -> DataFrame:
    """src, dst, type, risk: repositories contain files, files trigger rules; risk is the highest severity rank."""
    edge = lambda a, b, kind: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type"))
    each = hits.select(F.explode(F.array(edge("source", "path", "contains"), edge("path", "rule", "triggers"))).alias("e"), severity_rank(F.col("severity")).alias("rank"))
    return each.groupBy("e.src", "e.dst", "e.type").agg(F.max("rank").alias("risk"))


def remediations(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """rule, priority, action, first_seq, n: templates(rule, priority, action) of the rules that were found."""
    found = findings.groupBy("rule").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    return found.join(templates, "rule").select("rule", "priority", "action", "first_seq", "n")


def triage_state(status: Column, decided: Column, due: Column, now: str, stale_days: int = 30) -> Column:
    """expired (accepted and past due), stale (new for more than stale_days), else ok."""
    at = F.lit(now).cast("timestamp")
    old = F.unix_timestamp(at) - F.unix_timestamp(decided) > stale_days * 86400
    return F.when((status == "accepted") & (due < at), "expired").when((status == "new") & old, "stale").otherwise("ok")


def volatility(history: DataFrame, key: str, order: str, value: str, tail: int = 10) -> DataFrame:
    """key, deviation (population deviation of residuals around the trend line), reversals (turns of direction; zero steps are ignored), volatile."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = history.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= tail)
    w = Window.partitionBy(key).orderBy(order)
    step = F.signum(F.col(value) - F.lag(value).over(w))
    signed = last.withColumn("_sign", F.when(step != 0, step))
    turned = signed.withColumn("_prev", F.last("_sign", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    y, x = F.col(value).cast("double"), (-F.col("_back")).cast("double")
    left = F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)
    out = turned.groupBy(key).agg(
        F.sqrt(F.greatest(F.coalesce(left, F.lit(0.0)), F.lit(0.0)) / F.count("*")).alias("deviation"), F.count_if(F.col("_sign") != F.col("_prev")).alias("reversals")
    )
    return out.withColumn("volatile", (F.col("deviation") > 10) & (F.col("reversals") >= 2))


def gitlab_ids(findings: DataFrame) -> DataFrame:
    """target, seq, id, severity of a dependency report: ids number the findings of a target in order."""
    at = F.row_number().over(Window.partitionBy("target").orderBy("seq")) - 1
    return findings.select("target", "seq", F.concat_ws("-", "rule", at.cast("string")).alias("id"), F.initcap("severity").alias("severity"))


def suite_rows(findings: DataFrame) -> DataFrame:
    """target, tests, failures: each rule of a target is a test, which fails on a critical or high finding."""
    worst = findings.groupBy("target", "rule").agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    return worst.groupBy("target").agg(F.count("*").alias("tests"), F.count_if(F.col("worst") >= 3).alias("failures"))
