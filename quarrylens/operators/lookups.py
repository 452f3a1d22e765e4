"""Joins against dimensions: indicators, known-bad versions, digests, look-alike names, baselines, policies, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions.scalars import osa_at_most_one


def first_indicator(deps: DataFrame, feed: DataFrame, key: list[str]) -> DataFrame:
    """Each dependency with the first feed row (by pos) of its name whose version is its own or unpinned (null)."""
    hits = deps.join(feed.withColumnRenamed("version", "ioc_version"), "name").where(F.col("ioc_version").isNull() | (F.col("ioc_version") == F.col("version")))
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).where("rn = 1").drop("rn")


def bad_versions(deps: DataFrame, bad: DataFrame) -> DataFrame:
    return deps.join(bad, ["name", "version"])


def digest_groups(files: DataFrame) -> DataFrame:
    """digest, n, first_path of contents that several files have."""
    return files.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def digest_matches(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose sha256 (64 hex) or md5 (32 hex) is in known(digest); other lengths never match."""
    body = F.col("text").cast("binary")
    each = files.select("path", F.explode(F.array(F.sha2(body, 256), F.md5(body))).alias("digest"))
    return each.join(known.where(F.length("digest").isin(64, 32)), "digest")


# Fixed value: what counts as a token of a deny list.
DENY_TOKEN = r"[A-Za-z0-9][A-Za-z0-9._-]*"
#: Terms that are broadcast at most: 64 hex digits each.
BROADCAST_TERMS = 200_000


def deny_tokens(lines: DataFrame) -> DataFrame:
    """path, line, token: lower-cased tokens without . _ - at their end, those without .git, and pairs a/b of neighbours; some repeat."""
    trim = lambda t: F.regexp_replace(t, r"[._-]+$", "")
    single = lines.select("path", "line", F.explode(F.regexp_extract_all("content", F.lit(DENY_TOKEN), F.lit(0))).alias("token"))
    # only lines with a slash can hold a pair
    parts = F.split("content", "/")
    last, first = (lambda x: F.regexp_extract(x, f"{DENY_TOKEN}$", 0)), (lambda x: F.regexp_extract(x, f"^{DENY_TOKEN}", 0))
    ends = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts)), lambda x, y: F.when((last(x) != "") & (first(y) != ""), F.concat(last(x), F.lit("/"), first(y))))
    pairs = lines.where(F.col("content").contains("/")).select("path", "line", F.explode(ends).alias("token")).where("token IS NOT NULL")
    trimmed = single.union(pairs).select("path", "line", F.lower(F.when(F.col("token").rlike("[._-]$"), trim(F.col("token"))).otherwise(F.col("token"))).alias("token"))
    git = trimmed.where(F.col("token").endswith(".git")).select("path", "line", F.regexp_replace("token", r"\.git$", "").alias("token"))
    return trimmed.union(git).where(F.length("token").between(2, 200))


def deny_terms(lines: DataFrame, terms: DataFrame, salt: str = "") -> DataFrame:
    """path, line, digest of tokens whose salted hash is a deny term's; the term itself is never shown.

    Hashes meet the terms where they are made; only hits are shuffled. Terms are a
    list of an organisation's names: it is broadcast if its count is small.
    """
    wanted = terms.select("digest").distinct()
    if wanted.count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    hashed = deny_tokens(lines).select("path", "line", F.sha2(F.concat(F.lit(salt + "\n"), "token"), 256).alias("digest"))
    return hashed.join(wanted, "digest").distinct()


def similar_names(names: DataFrame, popular: list[str], allowed: tuple[str, ...] = ()) -> DataFrame:
    """name, target: names within one edit of a popular name, first target wins. popular is a literal list."""
    known = [p for p in popular if len(p) >= 5]
    first = F.coalesce(*(F.when(osa_at_most_one(F.col("name"), F.lit(p)), F.lit(p)) for p in known))
    free = ~F.col("name").isin(*popular, *allowed) & (F.length("name") >= 4) & ~F.col("name").startswith("@")
    return names.where(free).select("name", first.alias("target")).where("target IS NOT NULL")


def deletion_keys(name: Column) -> Column:
    """The name and each of its one-character deletions: names within one edit or swap share a key."""
    cut = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), cut))


def similar_pairs(names: DataFrame) -> DataFrame:
    """a < b: distinct names within one edit or swap of neighbours, by an equi-join on deletion keys instead of all pairs."""
    keys = names.select("name").distinct().where(F.length("name") > 0).select("name", F.explode(deletion_keys(F.col("name"))).alias("key"))
    a, b = keys.withColumnRenamed("name", "a"), keys.withColumnRenamed("name", "b")
    return a.join(b, "key").where("a < b").select("a", "b").distinct().where(osa_at_most_one(F.col("a"), F.col("b")))


# Fixed value: shorter names are one edit from almost any other.
SIMILAR_LEAST = 4


def similar_dependencies(deps: DataFrame, known: DataFrame) -> DataFrame:
    """target, name, other: dependencies (target, pos, name) of one target within one edit of each other; known(name) can't be the odd one.

    A name is paired with the first such other by pos, and a pair is told once, by
    the name that comes first. Scoped names and short ones are left out.
    """
    able = deps.where((F.length("name") >= SIMILAR_LEAST) & ~F.col("name").startswith("@")).groupBy("target", "name").agg(F.min("pos").alias("pos"))
    keyed = able.select("target", "name", "pos", F.explode(deletion_keys(F.col("name"))).alias("key"))
    other = keyed.select("target", "key", F.col("name").alias("other"), F.col("pos").alias("other_pos"))
    close = keyed.join(known.select("name").distinct(), "name", "left_anti").join(other, ["target", "key"]).where((F.col("name") != F.col("other")) & osa_at_most_one(F.col("name"), F.col("other")))
    first = close.groupBy("target", "name", "pos").agg(F.min(F.struct("other_pos", "other")).alias("o"))
    pair = F.struct(F.least("name", "o.other").alias("a"), F.greatest("name", "o.other").alias("b"))
    return first.withColumn("pair", pair).groupBy("target", "pair").agg(F.min(F.struct("pos", "name", "o.other")).alias("x")).select("target", "x.name", "x.other")


def minus_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings without a baseline row of the same rule, file and line (nulls count as empty)."""
    same = F.col("f.rule").eqNullSafe(F.col("b.rule")) & F.col("f.file").eqNullSafe(F.col("b.file")) & F.col("f.line").eqNullSafe(F.col("b.line"))
    return findings.alias("f").join(baseline.alias("b"), same, "left_anti")


def apply_policy(findings: DataFrame, disabled: list[str], overrides: dict[str, str]) -> DataFrame:
    """Disabled rules go, then severities are overridden."""
    kept = findings.where(~F.col("rule").isin(*disabled)) if disabled else findings
    severity = F.col("severity")
    for rule, new in overrides.items():
        severity = F.when(F.col("rule") == rule, new).otherwise(severity)
    return kept.withColumn("severity", severity)


def unowned_critical(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Critical findings without a decision on their target; nothing while there is no decision at all."""
    any_decision = decisions.select(F.lit(1).alias("_one")).limit(1)
    return findings.where("severity = 'critical'").join(decisions.select("target").distinct(), "target", "left_anti").join(any_decision, how="left_semi")


def orphans(locked: DataFrame, declared: DataFrame) -> DataFrame:
    return locked.join(declared.select("name").distinct(), "name", "left_anti")


def changed_only(findings: DataFrame, changed: DataFrame) -> DataFrame:
    return findings.join(changed, "file", "left_semi")


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """a, b, depth: every b that a needs over edges(a, b), with the length of the shortest path; cycles end, long chains work."""
    from quarrylens.operators import fixpoint

    return fixpoint.closure(edges)
