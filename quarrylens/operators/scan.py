"""All detectors over one table of files: one relation of findings, what was not read, and each target's risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import analytics, disclosure, families, flow, rules, structural
from quarrylens.operators.ordered import quoted
from quarrylens.sources import coverage, formats, locks, manifests, workflows

FAMILY_OF = {r.id: name for name, own in families.FAMILIES.items() for r in own}
#: Families that have a scan of their own, by region or context.
APART = ("workflow", "internal")
#: Files of each reader of resolved or declared dependencies, and the ecosystem.
DEPENDENCIES = {
    "package_json": (manifests.package_json, r"(^|/)package\.json$", "npm"), "npm_lock": (manifests.npm_lock, r"(^|/)package-lock\.json$", "npm"), "npm_lock_v1": (formats.npm_lock_v1, r"(^|/)package-lock\.json$", "npm"),
    "yarn_lock": (manifests.yarn_lock, r"(^|/)yarn\.lock$", "npm"), "pnpm_lock": (locks.pnpm_lock, r"(^|/)pnpm-lock\.yaml$", "npm"), "bun_lock": (formats.bun_lock, r"(^|/)bun\.lock$", "npm"),
    "cargo_lock": (manifests.cargo_lock, r"(^|/)Cargo\.lock$", "cargo"), "pyproject": (formats.pyproject, r"(^|/)pyproject\.toml$", "pypi"), "poetry_lock": (manifests.poetry_lock, r"(^|/)poetry\.lock$", "pypi"),
    "requirements": (manifests.requirements, r"(^|/)requirements[^/]*\.txt$", "pypi"), "go_sum": (manifests.go_sum, r"(^|/)go\.sum$", "go"), "gemfile_lock": (locks.gemfile_lock, r"(^|/)Gemfile\.lock$", "ruby"),
}
# Extensions of source code.
CODE = r"(?i)\.(js|jsx|mjs|cjs|ts|tsx|mts|cts|py|rb|php|sh|ps1|go|rs|java|lua|pl)$"
#: Files that a family speaks of, where its rules don't say it themselves.
PLACES = {
    "file": CODE, "scripts": r"(^|/)package\.json$", "binary_download": r"(^|/)package\.json$|(?i)\.(sh|ps1|bat|cmd)$", "pypi": r"(?i)\.py$|(^|/)(requirements[^/]*\.txt|pyproject\.toml)$", "pypi_hook": r"(^|/)setup\.py$",
    "beacon_miner": CODE + r"|(?i)\.json$", "obfuscation": CODE + r"|(?i)\.(svg|html?)$", "infostealer": CODE, "c2": CODE, "prompt_injection": r"(?i)\.(md|mdx|mdc|txt)$|(^|/)\.cursorrules$", "provenance": r"(?i)lock[^/]*\.json$",
}


def _rows(df: DataFrame, detector: str, rule: Column | None = None, severity: Column | None = None, line: Column | None = None) -> DataFrame:
    return df.select("path", (F.col("line") if line is None else line).cast("int").alias("line"), (F.col("rule") if rule is None else rule).alias("rule"), (F.col("severity") if severity is None else severity).alias("severity"), F.lit(detector).alias("detector"))


def dependencies(files: DataFrame) -> DataFrame:
    """path, ecosystem, name, version of all dependency files, each by the reader of its name."""
    each = [read(files.where(F.col("path").rlike(p))).select("path", F.lit(eco).alias("ecosystem"), "name", "version") for read, p, eco in DEPENDENCIES.values()]
    return reduce(DataFrame.union, each).distinct()


def _place(rule: rules.Rule) -> str:
    place = PLACES.get(FAMILY_OF[rule.id])
    return f"path RLIKE {quoted(place)}" if place else "true"


def text_findings(files: DataFrame) -> DataFrame:
    """The rules of all families in one pass over the files, but those that have a scan of their own."""
    return _rows(rules.line_hits(files, tuple(r for r in families.EVERY if FAMILY_OF[r.id] not in APART), scope=_place), "text")


def findings(files: DataFrame, bad: DataFrame) -> DataFrame:
    """path, line, rule, severity, detector of every detector over files(path, text); bad: ecosystem, name, version."""
    def known(severity: str, rule: str) -> dict[str, Column]:
        return {"rule": F.lit(rule), "severity": F.lit(severity)}

    flows = files.where(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))
    own = dependencies(files)
    out = [
        text_findings(files),
        _rows(workflows.rule_hits(flows), "workflow"),
        _rows(workflows.structure_findings(workflows.steps(flows)), "workflow", severity=F.lit("high"), line=F.lit(None)),
        _rows(disclosure.scan(files), "disclosure"),
        _rows(structural.write_then_run(files), "flow", **known("critical", "DROPPER_TEMP_EXEC")),
        _rows(flow.credential_flow(files), "flow", **known("critical", "CREDENTIAL_SENT")),
        _rows(flow.decode_then_exec(files), "flow", **known("critical", "DECODED_EXEC")),
        _rows(flow.gated_destruction(files), "flow", **known("critical", "LOCALE_GATED_DESTRUCTION")),
        _rows(own.join(bad, ["ecosystem", "name", "version"]), "dependency", line=F.lit(None), **known("critical", "KNOWN_BAD_VERSION")),
    ]
    return reduce(DataFrame.union, out)


def not_read(files: DataFrame, limit: int = coverage.LIMIT) -> DataFrame:
    """Coverage rows: files without content or over the limit, and what readers and workflows could not read."""
    kept, lost = coverage.bounded(files, limit)
    readers = {n: p for n, (_, p, _) in DEPENDENCIES.items() if n in formats.WITH_PROBLEMS}
    flows = kept.where(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))
    broken = workflows.coverage(workflows.steps(flows)).select("path", F.lit("unreadable").alias("state"), F.lit("workflow").alias("detail"))
    return lost.union(coverage.problems(kept, readers)).union(broken)


def report(found: DataFrame, seen: DataFrame, targets: DataFrame) -> DataFrame:
    """target, score, n_findings, worst, partial of each target (the first part of a path), those without findings too."""
    target = F.substring_index("path", "/", 1)
    summed = analytics.summary_by_target(found.withColumn("target", target))
    whole = coverage.partial(targets.select("target").withColumn("partial", F.lit(False)), seen, target)
    joined = whole.join(summed, "target", "left")
    return joined.select("target", F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"), F.coalesce("worst", F.lit("none")).alias("worst"), "partial")
