"""From findings to risk: scores, levels, dimensions, trust, incidents, posture, metrics.

findings: target, seq, rule, severity, and optionally confidence, file, line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions.scalars import dimension_weight, risk_level, round_half_up, score_weight, severity_rank


def severity_summary(findings: DataFrame, *by: str) -> DataFrame:
    count = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    return findings.groupBy(*by).agg(F.count("*").alias("total"), *count)


def score_by_target(findings: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """target, score, level: heaviest severity of each rule, added up, 100 at most. Two aggregations, both combined map-side."""
    rules = findings.where(~F.col("rule").isin(*excluded)) if excluded else findings
    per_rule = rules.groupBy("target", "rule").agg(F.max(score_weight(F.col("severity"))).alias("w"))
    scored = per_rule.groupBy("target").agg(F.least(F.lit(100), F.sum("w")).cast("long").alias("score"))
    return scored.withColumn("level", risk_level(F.col("score")))


def summary_by_target(findings: DataFrame) -> DataFrame:
    """target, score as in ``score_by_target``, n_findings, worst severity, in one pass over the findings."""
    severity = F.col("severity")
    per_rule = findings.groupBy("target", "rule").agg(F.max(score_weight(severity)).alias("w"), F.count("*").alias("n"), F.max_by("severity", severity_rank(severity)).alias("severity"))
    return per_rule.groupBy("target").agg(F.least(F.lit(100), F.sum("w")).cast("long").alias("score"), F.sum("n").alias("n_findings"), F.max_by("severity", severity_rank(severity)).alias("worst"))


def plain_score(findings: DataFrame) -> DataFrame:
    """target, score: every finding counts, 100 at most (registry scans)."""
    return findings.groupBy("target").agg(F.least(F.lit(100), F.sum(score_weight(F.col("severity")))).cast("long").alias("score"))


def dimensions(findings: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """target, one weighted and capped sum for each dimension (regex on the rule), overall (.35 .30 .20 .15)."""
    weight = dimension_weight(F.col("severity")) * F.coalesce("confidence", F.lit(1.0))
    sums = [F.least(F.lit(100), round_half_up(F.round(F.sum(F.when(F.col("rule").rlike(p), weight).otherwise(0.0)), 6))).cast("long").alias(name) for name, p in prefixes.items()]
    out = findings.groupBy("target").agg(*sums)
    overall = sum((F.col(name) * w for name, w in zip(prefixes, (0.35, 0.30, 0.20, 0.15), strict=False)), F.lit(0.0))
    return out.withColumn("overall", round_half_up(F.round(overall, 6)).cast("long"))


def trust(findings: DataFrame, code: str, dependency: str, release: str) -> DataFrame:
    """target, code, dependency, release sub-scores: 100 less capped penalties, 0 at least."""
    count = lambda p, s: F.count_if(F.col("rule").rlike(p) & (F.col("severity") == s))
    floor0 = lambda x: F.greatest(F.lit(0), x).cast("long")
    return findings.groupBy("target").agg(
        floor0(100 - F.least(F.lit(60), 20 * count(code, "critical")) - F.least(F.lit(30), 10 * count(code, "high"))).alias("code"),
        floor0(100 - F.least(F.lit(30), 10 * F.count_if(F.col("rule").rlike(dependency)))).alias("dependency"),
        floor0(100 - F.least(F.lit(50), 15 * F.count_if(F.col("rule").rlike(release)))).alias("release"),
    )


def incidents(findings: DataFrame, clusters: DataFrame) -> DataFrame:
    """target, cluster, n_rules, confidence: clusters of which enough distinct rules, and one of the required ones, were found.

    clusters: cluster, rule, required (boolean), min_match. It is a dimension of
    a few dozen rows; Spark broadcasts it by its size.
    """
    met = findings.join(clusters, "rule").groupBy("target", "cluster").agg(
        F.countDistinct("rule").alias("n_rules"), F.bool_or("required").alias("has_required"), F.max("min_match").alias("min_match"),
        F.bool_or("needs_any").alias("needs_any"), F.avg(F.coalesce("confidence", F.lit(0.8))).alias("confidence"),
    )
    return met.where((F.col("n_rules") >= F.col("min_match")) & (F.col("has_required") | ~F.col("needs_any"))).select("target", "cluster", "n_rules", "confidence")


def correlated(findings: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with boosted confidence and the cluster that came last, incidents with the confidence that their findings had by then).

    clusters: seq, cluster, rule, required, needs_any, min_match, boost. The clusters
    that a target meets are gone through by seq; each adds its boost to the confidence
    (0.8 where unknown, 1 at most) of its findings, so a finding in two of them is
    boosted twice, and the later average sees the earlier boost. findings: target,
    seq (unique in the target), rule, confidence.
    """
    met = incidents(findings, clusters).select("target", "cluster", "n_rules")
    base = findings.select("target", F.col("seq").alias("finding"), "rule", F.coalesce("confidence", F.lit(0.8)).alias("base"))
    of_cluster = clusters.select("seq", "cluster", "rule", "boost").distinct()
    pairs = base.join(of_cluster, "rule").join(met, ["target", "cluster"])
    order = Window.partitionBy("target", "finding").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # boosts are positive, so the capped running sum is the running sum, capped
    stepped = pairs.withColumn("now", F.least(F.lit(1.0), F.col("base") + F.sum("boost").over(order)))
    found = stepped.groupBy("target", "seq", "cluster", "n_rules").agg(F.avg("now").alias("confidence"), F.count("*").alias("n_findings"))
    last = stepped.groupBy("target", "finding").agg(F.max_by("now", "seq").alias("now"), F.max_by("cluster", "seq").alias("correlation"))
    out = findings.join(last.withColumnRenamed("finding", "seq"), ["target", "seq"], "left").withColumn("confidence", F.coalesce("now", "confidence")).drop("now")
    return out, found.withColumn("confidence", F.least(F.lit(1.0), "confidence"))


def shared_rules(findings: DataFrame, least_targets: int = 3) -> DataFrame:
    """rule, n_targets, confidence of rules found in several targets."""
    out = findings.groupBy("rule").agg(F.countDistinct("target").alias("n_targets")).where(F.col("n_targets") >= least_targets)
    return out.withColumn("confidence", F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * F.col("n_targets")))


def systemic_rules(findings: DataFrame) -> DataFrame:
    """rule, n_targets of rules found in half of all targets, and in three at least."""
    total = findings.agg(F.countDistinct("target").alias("all_targets"))
    per = findings.groupBy("rule").agg(F.countDistinct("target").alias("n_targets"))
    # total is one row
    return per.join(F.broadcast(total)).where("n_targets >= 3 AND 2 * n_targets >= all_targets").select("rule", "n_targets", "all_targets")


def top_rules(findings: DataFrame, k: int = 5) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(k)


def top_targets(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("score"), "target").limit(k)


def metrics(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """open_critical, open_high, resolution_rate; a resolved decision closes its rule everywhere."""
    closed = decisions.where("status = 'resolved'").select("rule").distinct()
    open_ = findings.join(closed, "rule", "left_anti")
    counts = open_.agg(F.count_if(F.col("severity") == "critical").alias("open_critical"), F.count_if(F.col("severity") == "high").alias("open_high"))
    done, judged = F.count_if(F.col("status").isin("resolved", "false-positive")), F.count_if(F.col("status") != "new")
    rate = decisions.agg(F.when(judged == 0, 100).otherwise(F.floor(100 * done / F.greatest(judged, F.lit(1)) + 0.5)).cast("long").alias("resolution_rate"))
    # one row each
    return counts.join(F.broadcast(rate))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule, description of its first finding, level, index by first appearance."""
    first = findings.groupBy("rule").agg(F.min("seq").alias("first_seq"), F.min_by("description", "seq").alias("description"), F.max(severity_rank(F.col("severity"))).alias("rank"))
    return first.select("rule", "description", "first_seq", F.when(F.col("rank") >= 3, "error").when(F.col("rank") == 2, "warning").otherwise("note").alias("level"))


def verdict(findings: DataFrame) -> DataFrame:
    """exit_code of each target: 2 with a critical finding, 1 with a high one, else 0."""
    worst = F.max(severity_rank(F.col("severity")))
    return findings.groupBy("target").agg(F.when(worst == 4, 2).when(worst == 3, 1).otherwise(0).alias("exit_code"))
