"""Manifest and lockfile readers: (path, text) rows to dependency rows, with built-in functions.

All give path, ecosystem, name, version, resolved, integrity; unparsable files give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Hash prefixes that an integrity value may have, and registries that are trusted.
INTEGRITY = r"^(sha512|sha256|sha1)-"
TRUSTED = r"^https://(registry\.npmjs\.org|registry\.yarnpkg\.com)/"


def package_json(files: DataFrame) -> DataFrame:
    """Declared dependencies of npm manifests: name, version (range), kind."""
    kinds = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
    parsed = files.select("path", F.from_json("text", ", ".join(f"{k} map<string,string>" for k in kinds)).alias("m"))
    each = [parsed.select("path", F.lit(k).alias("kind"), F.explode(F.col(f"m.{k}")).alias("name", "version")) for k in kinds]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.withColumn("ecosystem", F.lit("npm"))


def npm_lock(files: DataFrame) -> DataFrame:
    """package-lock.json of version 2 and later: the ``packages`` map."""
    entry = "struct<version:string,resolved:string,integrity:string,dev:boolean,optional:boolean>"
    parsed = files.select("path", F.from_json("text", f"lockfileVersion int, packages map<string,{entry}>").alias("m"))
    each = parsed.select("path", F.col("m.lockfileVersion").alias("lockfile_version"), F.explode("m.packages").alias("at", "p")).where("at <> ''")
    return each.select(
        "path", F.lit("npm").alias("ecosystem"), F.regexp_extract("at", r"(?:^|.*/)node_modules/((?:@[^/]+/)?[^/]+)$", 1).alias("name"), "p.version", "p.resolved", "p.integrity", "lockfile_version",
        F.when(F.col("p.dev"), "excluded").when(F.col("p.optional"), "optional").otherwise("required").alias("scope"),
    )


def _blocks(files: DataFrame, header: str, fields: dict[str, str], ecosystem: str) -> DataFrame:
    """Line formats whose blocks start with a header: the header is carried forward, then each block is one row."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("i", "content"))
    w = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("block", F.sum(F.when(F.col("content").rlike(header), 1).otherwise(0)).over(w)).where("block > 0")
    value = lambda p: F.first(F.when(F.col("content").rlike(p), F.regexp_extract("content", p, 1)), ignorenulls=True)
    out = marked.groupBy("path", "block").agg(*(value(p).alias(k) for k, p in fields.items()))
    return out.withColumn("ecosystem", F.lit(ecosystem)).where("name IS NOT NULL")


def cargo_lock(files: DataFrame) -> DataFrame:
    return _blocks(files, r"^\[\[package\]\]", {"name": r'^name = "([^"]*)"', "version": r'^version = "([^"]*)"', "resolved": r'^source = "([^"]*)"', "integrity": r'^checksum = "([^"]*)"'}, "cargo")


def poetry_lock(files: DataFrame) -> DataFrame:
    return _blocks(files, r"^\[\[package\]\]", {"name": r'^name = "([^"]*)"', "version": r'^version = "([^"]*)"'}, "pypi")


def yarn_lock(files: DataFrame) -> DataFrame:
    """Classic format: a header of ranges, then indented version, resolved and integrity."""
    return _blocks(files, r'^"?(@?[^@"\s#][^@"]*)@', {"name": r'^"?(@?[^@"\s#][^@"]*)@', "version": r'^  version "([^"]*)"', "resolved": r'^  resolved "([^"]*)"', "integrity": r"^  integrity (\S+)"}, "npm")


def go_sum(files: DataFrame) -> DataFrame:
    line = F.explode(F.split("text", "\r?\n")).alias("content")
    part = r"^(\S+) (v[^\s/]+)(?:/go\.mod)? (h1:\S+)$"
    each = files.select("path", line).where(F.col("content").rlike(part))
    return each.select("path", F.lit("go").alias("ecosystem"), F.regexp_extract("content", part, 1).alias("name"), F.regexp_extract("content", part, 2).alias("version")).distinct()


def requirements(files: DataFrame) -> DataFrame:
    """requirements.txt: names with their version specifiers; options and comments are left out, continuations joined."""
    joined = F.regexp_replace("text", r"\\\r?\n", " ")
    each = files.select("path", F.explode(F.split(joined, "\r?\n")).alias("content")).select("path", F.trim(F.regexp_replace("content", r"(^|\s)#.*", "")).alias("content"))
    part = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;]*)"
    return each.where(F.col("content").rlike(r"^[A-Za-z0-9]")).select(
        "path", F.lit("pypi").alias("ecosystem"), F.regexp_extract("content", part, 1).alias("name"), F.trim(F.regexp_extract("content", part, 2)).alias("version")
    )


def lockfile_findings(deps: DataFrame) -> DataFrame:
    """rule rows for missing or malformed integrity and for the ladder of resolved URLs."""
    hash_part = F.regexp_replace("integrity", INTEGRITY, "")
    rule = (
        F.when(F.col("resolved").isNotNull() & F.col("integrity").isNull(), F.struct(F.lit("LOCKFILE_NO_INTEGRITY").alias("rule"), F.lit("medium").alias("severity")))
        .when(F.col("integrity").isNotNull() & ~F.col("integrity").rlike(INTEGRITY), F.struct(F.lit("LOCKFILE_INTEGRITY_PREFIX").alias("rule"), F.lit("high").alias("severity")))
        .when(F.col("integrity").isNotNull() & (F.length(hash_part) < 20), F.struct(F.lit("LOCKFILE_INTEGRITY_SHORT").alias("rule"), F.lit("high").alias("severity")))
    )
    url = F.col("resolved")
    ladder = F.when(url.isNotNull() & ~url.rlike(TRUSTED), F.when(url.rlike("github"), "medium").when(url.startswith("http://"), "high").when(~url.startswith("https://"), "medium").otherwise("low"))
    found = F.filter(F.array(rule, F.when(ladder.isNotNull(), F.struct(F.lit("LOCKFILE_UNTRUSTED_URL").alias("rule"), ladder.alias("severity")))), lambda x: x.isNotNull())
    return deps.select("path", "name", "version", F.explode(found).alias("f")).select("path", "name", "version", "f.rule", "f.severity")
