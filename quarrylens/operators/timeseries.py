"""History and versions: publishing anomalies, trends, forecasts, SLA and triage ages. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def version_gaps(versions: DataFrame, key: str, at: str, tie: str, days: int = 730) -> DataFrame:
    """Versions that follow their predecessor after more than ``days`` days."""
    w = Window.partitionBy(key).orderBy(at, tie)
    gap = (F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(w))) / 86400.0
    return versions.withColumn("gap_days", gap).where(F.col("gap_days") > days)


def trend(history: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per row: spike (2 x and > 30), increasing (last 5 against the 5 before, 1.3 x and > 20), stagnation (last 5 all > 50), direction over 3 rows."""
    w = Window.partitionBy(key).orderBy(order)
    v = F.col(value)
    prev = F.lag(v).over(w)
    recent, before = w.rowsBetween(-4, 0), w.rowsBetween(-9, -5)
    n = F.row_number().over(w)
    back = v - F.lag(v, 2).over(w)
    return history.select(
        key, order, value,
        F.coalesce((v > 2 * prev) & (v > 30), F.lit(False)).alias("spike"),
        F.coalesce((n >= 10) & (F.avg(v).over(recent) > 1.3 * F.avg(v).over(before)) & (F.avg(v).over(recent) > 20), F.lit(False)).alias("increasing"),
        ((n >= 5) & (F.min(v).over(recent) > 50)).alias("stagnation"),
        F.when(back > 5, "increasing").when(back < -5, "decreasing").otherwise("stable").alias("direction"),
    )


def forecast(history: DataFrame, key: str, order: str, value: str, tail: int = 10, horizon: int = 5) -> DataFrame:
    """key, n, current, slope of the last rows and the value it leads to.

    The slope is that of REGR_SLOPE. Both it and ``ahead`` are one quotient of sums over differences from the newest
    value: for whole numbers the sums are exact, so what lies on a limit stays there in whatever order rows come.
    """
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    y = F.col(value).cast("double")
    rows = history.withColumn("_back", F.row_number().over(newest)).withColumn("_rise", y - F.first(y, ignorenulls=True).over(newest))
    r = F.col("_rise")
    x = F.when(r.isNotNull(), (-F.col("_back")).cast("double"))
    out = rows.where(F.col("_back") <= tail).groupBy(key).agg(
        F.count("*").alias("n"), F.max_by(value, order).cast("double").alias("current"),
        (F.count(r) * F.sum(x * r) - F.sum(x) * F.sum(r)).alias("_up"), (F.count(r) * F.sum(x * x) - F.sum(x) * F.sum(x)).alias("_run"),
    )
    slope, ahead = F.try_divide("_up", "_run"), F.col("current") + F.try_divide(horizon * F.col("_up"), F.col("_run"))
    return out.select(key, "n", "current", slope.alias("slope"), ahead.alias("ahead"))


# The score from which a risk is critical, and the slope of a steep rise.
CRITICAL, STEEP = 60, 5


def forecast_warnings(history: DataFrame, key: str, order: str, value: str, least: int = 3) -> DataFrame:
    """key, warning (crosses or rises), ahead: keys whose value goes over CRITICAL within the horizon, or else rises by more than STEEP a step."""
    out = forecast(history, key, order, value).where(F.col("n") >= least)
    ahead = F.floor(F.col("ahead") + 0.5)
    warning = F.when((ahead > CRITICAL) & (F.col("current") <= CRITICAL), "crosses").when(F.col("slope") > STEEP, "rises")
    return out.select(key, warning.alias("warning"), ahead.cast("long").alias("ahead")).where("warning IS NOT NULL")


def capped_history(history: DataFrame, key: str, order: str, rows: int = 100) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return history.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= rows).drop("_rn")


def sla_state(opened: Column, now: str, limit_hours: Column) -> Column:
    """breached beyond the limit, at-risk beyond 80 percent of it, else ok."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(opened)) / 3600.0
    return F.when(age > limit_hours, "breached").when(age > 0.8 * limit_hours, "at-risk").otherwise("ok")


def sessions(events: DataFrame, key: str, at: str, tie: str, gap_seconds: int) -> DataFrame:
    """key, session (from 1), n, started, ended: runs of events without a gap of more than gap_seconds."""
    w = Window.partitionBy(key).orderBy(at, tie)
    new = F.when(F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(w)) > gap_seconds, 1).otherwise(0)
    marked = events.withColumn("_new", new).withColumn("session", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long"))
    return marked.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(at).alias("started"), F.max(at).alias("ended"))
