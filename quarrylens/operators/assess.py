"""Judgements over findings and metadata: policy, boosts, confidence, trust, names, freshness, install hooks, as-of lookups.

Every function is a plan of built-in functions; ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions.scalars import round_half_up, severity_rank
from quarrylens.operators.indicators import glob_regex


def _ids(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull())


def _finding(rule: str, severity: str | Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))


# ------------------------------------------------------------------ policy
def host_within(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return F.coalesce(out, F.lit(False))


def full_policy(findings: DataFrame, disabled=(), suppressed: dict[str, list[str]] | None = None, packages=(), pairs=(), domains=(), owners=(), overrides: dict[str, str] | None = None) -> DataFrame:
    """findings (rule, file, package, host, owner, severity) after a policy, in its order.

    Disabled rules go, then rules on suppressed globs, allowed packages, allowed
    (rule, package) pairs, allowed domains and owners; what stays gets its severity.
    """
    gone = F.col("rule").isin(*disabled) if disabled else F.lit(False)
    for rule, globs in (suppressed or {}).items():
        for g in globs:
            gone = gone | ((F.col("rule") == rule) & F.col("file").rlike(glob_regex(g)))
    if packages:
        gone = gone | F.coalesce(F.col("package").isin(*packages), F.lit(False))
    for rule, package in pairs:
        gone = gone | F.coalesce((F.col("rule") == rule) & (F.col("package") == package), F.lit(False))
    gone = gone | host_within(F.col("host"), list(domains))
    if owners:
        gone = gone | F.coalesce(F.col("owner").isin(*owners), F.lit(False))
    severity = F.col("severity")
    for rule, new in (overrides or {}).items():
        severity = F.when(F.col("rule") == rule, new).otherwise(severity)
    return findings.where(~gone).withColumn("severity", severity)


# ------------------------------------------------------------------ scores
def boosted(scores: DataFrame, incidents: DataFrame) -> DataFrame:
    """target, score, boost, final: incidents (target, boost 0.15 to 0.30) add round(30 x boost) each, 30 at most; 100 in all."""
    add = incidents.groupBy("target").agg(F.least(F.lit(30), F.sum(round_half_up(F.round(F.col("boost") * 30, 6)))).cast("long").alias("boost"))
    out = scores.join(add, "target", "left").withColumn("boost", F.coalesce("boost", F.lit(0)))
    return out.select("target", "score", "boost", F.least(F.lit(100), F.col("score") + F.col("boost")).cast("long").alias("final"))


def ladder(findings: DataFrame, correlated: Column, intel: Column) -> DataFrame:
    """target, confidence of a target's dimensions: 0.5, with non-info findings 0.5 + 0.05 each, 0.1 more if any is correlated, 0.15 if any is known."""
    n = F.count_if(F.col("severity") != "info")
    base = F.when(n > 0, F.least(F.lit(1.0), 0.5 + 0.05 * n)).otherwise(0.5)
    more = F.when(F.bool_or(correlated), 0.1).otherwise(0.0) + F.when(F.bool_or(intel), 0.15).otherwise(0.0)
    return findings.groupBy("target").agg(F.round(F.least(F.lit(1.0), base + more), 2).alias("confidence"))


def trust_total(sub: DataFrame) -> DataFrame:
    """target, total of the sub-scores publisher, code, dependency and release (.4 .3 .2 .1)."""
    total = 0.4 * F.col("publisher") + 0.3 * F.col("code") + 0.2 * F.col("dependency") + 0.1 * F.col("release")
    return sub.select("target", round_half_up(F.round(total, 6)).cast("long").alias("total"))


def cluster_anomaly(findings: DataFrame) -> DataFrame:
    """targets, critical_targets where there are more than 10 targets and over half of them have a critical finding."""
    per = findings.groupBy("target").agg(F.bool_or(F.col("severity") == "critical").alias("critical"))
    return per.agg(F.count("*").alias("targets"), F.count_if("critical").alias("critical_targets")).where("targets > 10 AND 2 * critical_targets > targets")


def recurring(findings: DataFrame, column: str) -> DataFrame:
    """Values of a column that are found in two targets at least."""
    return findings.where(F.col(column).isNotNull()).groupBy(column).agg(F.countDistinct("target").alias("n_targets")).where("n_targets >= 2")


def posture(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k riskiest targets, partially scanned ones first, with the average over the complete ones. scores: target, score, partial."""
    mean = scores.where("NOT partial").agg(F.round(F.avg("score"), 2).alias("average"))
    # one row
    return scores.orderBy(F.desc("partial"), F.desc("score"), "target").limit(k).join(F.broadcast(mean))


def partial_targets(findings: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """target, partial: whether any finding says that the scan was not complete; to be taken before a policy hides it."""
    return findings.groupBy("target").agg(F.bool_or(F.col("rule").isin(*rules)).alias("partial"))


def ranked_incidents(incidents: DataFrame) -> DataFrame:
    """Incidents of each target by confidence, with their place; ties in the order of the clusters."""
    w = Window.partitionBy("target").orderBy(F.desc("confidence"), "cluster")
    return incidents.withColumn("place", F.row_number().over(w))


def compact(findings: DataFrame, k: int = 20) -> DataFrame:
    """The k most severe findings of each target, in order of severity and position."""
    w = Window.partitionBy("target").orderBy(severity_rank(F.col("severity")).desc(), "seq")
    return findings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def validated_confidence(findings: DataFrame) -> DataFrame:
    """confidence and tier: raised by 0.1 where the rule is found in several files of its target, lowered by 0.2 in tests."""
    # counted before rows meet, so that no task holds all files of a rule
    spread = findings.groupBy("target", "rule").agg((F.min("file") != F.max("file")).alias("_several"))
    test = F.col("file").rlike(r"(?i)(^|/)(tests?|fixtures?)/")
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.8)) + F.when(F.col("_several"), 0.1).otherwise(0.0) - F.when(test, 0.2).otherwise(0.0)))
    out = findings.join(spread, ["target", "rule"], "left").withColumn("confidence", F.round(value, 4)).select(*findings.columns)
    return out.withColumn("tier", F.when(F.col("confidence") >= 0.8, "confirmed").when(F.col("confidence") >= 0.5, "likely").otherwise("possible"))


def named_paths(findings: DataFrame, paths: dict[str, tuple[str, ...]]) -> DataFrame:
    """target, path: named attack paths all of whose rule patterns are found in the target."""
    hit = [F.array(*(F.bool_or(F.col("rule").rlike(p)) for p in patterns)).alias(name) for name, patterns in paths.items()]
    wide = findings.groupBy("target").agg(*hit)
    return wide.select("target", F.explode(_ids({name: F.forall(name, lambda x: x) for name in paths})).alias("path"))


def playbooks(incidents: DataFrame, templates: DataFrame) -> DataFrame:
    """Incidents with the steps of the template (cluster, step, action) of their name, in order."""
    return incidents.join(templates, "cluster").select("target", "cluster", "step", "action")


def without_overlaps(findings: DataFrame) -> DataFrame:
    """Findings of a line but those that lie within a more specific one's span. findings: file, line, start, stop, rule, rank (specificity)."""
    every = F.collect_list(F.struct("start", "stop", "rank", "rule")).over(Window.partitionBy("file", "line"))
    held = F.exists("every", lambda o: (o["start"] <= F.col("start")) & (o["stop"] >= F.col("stop")) & ((o["rank"] > F.col("rank")) | ((o["rank"] == F.col("rank")) & ((o["stop"] - o["start"]) > (F.col("stop") - F.col("start"))))))
    return findings.withColumn("every", every).where(~held).drop("every")


# ------------------------------------------------------------------ as-of and intervals
def as_of(probes: DataFrame, points: DataFrame, key: str, at: str, value: str, span: float | None = None) -> DataFrame:
    """probes with ``value`` of the last point (key, at, value) at or before each, by windows over both; null if there is none.

    Both sides are sorted once by key and place; no pair of a probe and a point is
    made. With ``span`` (a length on a numeric ``at``), a window is such a stretch
    of a key and takes over the last value before it, so a hot key is the work of
    many tasks. Points without a key, a place or a value count for nothing.
    """
    points = points.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    a = probes.select("*", F.lit(None).cast(dict(points.dtypes)[value]).alias(value), F.lit(1).alias("is_probe"))
    b = points.select(*(F.col(c) if c in (key, at, value) else F.lit(None).cast(t).alias(c) for c, t in a.drop("is_probe").dtypes), F.lit(0).alias("is_probe"))
    both = a.unionByName(b)
    last = F.last(value, ignorenulls=True)
    if span is None:
        w = Window.partitionBy(key).orderBy(at, "is_probe").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(value, last.over(w)).where("is_probe = 1").drop("is_probe")
    both = both.withColumn("_stretch", F.floor(F.col(at) / span))
    w = Window.partitionBy(key, "_stretch").orderBy(at, "is_probe").rowsBetween(Window.unboundedPreceding, 0)
    # one row per stretch; rows without an order are no candidates of max_by
    ends = both.groupBy(key, "_stretch").agg(F.max_by(value, F.when(F.col("is_probe") == 0, F.col(at))).alias("_before"))
    earlier = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.last("_before", ignorenulls=True).over(earlier))
    found = both.withColumn(value, last.over(w)).where("is_probe = 1").join(carried, [key, "_stretch"], "left")
    return found.withColumn(value, F.coalesce(value, "_before")).select(*a.drop("is_probe").columns)


def within(events: DataFrame, ranges: DataFrame, key: str, at: str, span: float | None = None) -> DataFrame:
    """Events that lie in a range (key, start, stop) of their key, ends included, with the ``range`` of those around them that ends last.

    Ranges may overlap: as of each start the one that ends last so far is kept, and
    no later end is needed to tell whether an event lies in any. Ranges that end
    before they start hold nothing.
    """
    whole = ranges.where("stop >= start")
    so_far = Window.partitionBy(key).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    longest = F.max(F.struct("stop", "start")).over(so_far)
    starts = whole.select(key, F.col("start").alias(at), longest.alias("x")).distinct().select(key, at, F.struct(F.col("x.start").alias("start"), F.col("x.stop").alias("stop")).alias("range"))
    return as_of(events, starts, key, at, "range", span).where(F.col("range.stop") >= F.col(at))


def near(lines: DataFrame, first: str, second: str, reach: int = 15) -> DataFrame:
    """path, line of the lines that match ``second`` with a match of ``first`` at most ``reach`` lines above; one a file."""
    w = Window.partitionBy("path").orderBy("line").rangeBetween(-reach, 0)
    seen = lines.withColumn("near", F.max(F.col("content").rlike(first)).over(w)).where(F.col("near") & F.col("content").rlike(second))
    return seen.groupBy("path").agg(F.min("line").alias("line"))


# ------------------------------------------------------------------ packages and releases
def semver(version: Column) -> Column:
    """major, minor, patch of a version, null where it is none."""
    p = r"^[v=]?(\d+)\.(\d+)\.(\d+)(?:[-+].*)?$"
    part = lambda k: F.when(version.rlike(p), F.regexp_extract(version, p, k).cast("int"))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def publishing_anomalies(versions: DataFrame, days: int = 730, jump: int = 3) -> DataFrame:
    """package, version, rule of versions (package, version, at, maintainers, scripts) against their predecessor."""
    w = Window.partitionBy("package").orderBy("at", "version")
    before = versions.withColumn("p", F.lag(F.struct("version", "at", "maintainers", "scripts")).over(w)).where("p IS NOT NULL")
    rules = {
        "MAINTAINER_ADDED": F.size(F.array_except("maintainers", "p.maintainers")) > 0,
        "PUBLISHED_AFTER_GAP": (F.unix_timestamp("at") - F.unix_timestamp("p.at")) > days * 86400,
        "INSTALL_SCRIPT_ADDED": F.col("scripts") & ~F.col("p.scripts"),
        "MAJOR_JUMP": semver(F.col("version"))["major"] - semver(F.col("p.version"))["major"] > jump,
    }
    return before.select("package", "version", F.explode(_ids(rules)).alias("rule"))


def freshness(published: Column, now: str) -> Column:
    """hot (a day), cooldown (a week), recent (30 days), young (90 days) or settled."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(published)) / 3600.0
    return F.when(age < 24, "hot").when(age < 168, "cooldown").when(age < 720, "recent").when(age < 2160, "young").otherwise("settled")


def confusion(packages: DataFrame, internal: str, hallucinated: tuple[str, ...], now: str) -> DataFrame:
    """package, rule, severity of declared packages (package, exists, published, downloads, scripts): names that an outsider could or did take."""
    own, made_up = F.col("package").rlike(internal), F.col("package").isin(*hallucinated)
    # what isn't known counts neither for a package nor against it
    fresh = F.col("published").isNotNull() & freshness(F.col("published"), now).isin("hot", "cooldown")
    flags = fresh.cast("int") + F.coalesce((F.col("downloads") < 100).cast("int"), F.lit(0)) + F.coalesce(F.col("scripts").cast("int"), F.lit(0))
    rule = (
        F.when(made_up, _finding("DEP_HALLUCINATED_PACKAGE", "high"))
        .when(~F.coalesce("exists", F.lit(True)), _finding("DEPCONF_NOT_ON_REGISTRY", "high"))
        .when(own, _finding("DEP_INTERNAL_NAME_PUBLIC", F.when(flags >= 2, "critical").otherwise("high")))
        .when(flags >= 2, _finding("DEP_SUSPICIOUS_METADATA", F.when(flags == 3, "high").otherwise("medium")))
    )
    return packages.select("package", rule.alias("f")).where("f IS NOT NULL").select("package", "f.rule", "f.severity")


def related_names(package: Column, repository: Column) -> Column:
    """Whether a package's name shares a telling word with its repository's."""
    common = F.array(*map(F.lit, ("js", "node", "lib", "the", "package", "npm", "core", "cli")))
    words = lambda c: F.array_except(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3), common)
    return F.arrays_overlap(words(package), words(repository))


def first_pattern(name: Column, patterns: tuple[str, ...]) -> Column:
    """The first of the patterns that matches the name, else null."""
    return F.coalesce(*(F.when(name.rlike(p), F.lit(p)) for p in patterns))


def untrusted_sources(deps: DataFrame, trusted: tuple[str, ...]) -> DataFrame:
    """Dependencies that are resolved elsewhere than below the trusted addresses."""
    good = F.lit(False)
    for t in trusted:
        good = good | F.col("resolved").startswith(t)
    return deps.where(F.col("resolved").isNotNull() & ~good)


# Fixed value: scripts that a package manager runs by itself.
AUTO_RUN_HOOKS = ("preinstall", "install", "postinstall", "prepublish", "preprepare", "prepare", "postprepare", "preuninstall", "postuninstall")


def install_hooks(files: DataFrame) -> DataFrame:
    """path, hook, rule of the scripts that npm manifests run by themselves."""
    scripts = files.select("path", F.explode(F.from_json("text", "scripts map<string,string>")["scripts"]).alias("hook", "c")).where(F.col("hook").isin(*AUTO_RUN_HOOKS))
    has = lambda p: F.col("c").rlike(p)
    net = has(r"(?i)\b(?:curl|wget|fetch|https?://)")
    rules = {
        "INSTALL_HOOK_NETWORK": net,
        "INSTALL_HOOK_DOWNLOAD_EXEC": net & has(r"\|\s*(?:ba|z)?sh\b|&&\s*(?:\./|node |python|(?:ba)?sh )"),
        "INSTALL_HOOK_PERSISTENCE_WRITE": has(r"crontab|\.bashrc|\.zshrc|LaunchAgents|systemctl|\.config/autostart"),
        "INSTALL_HOOK_HOST_RUNTIME_PATCH": has(r"(?:>|cp|mv|sed -i)[^;&|]*node_modules/"),
        "INSTALL_HOOK_ENV_HARVEST": has(r"\bprintenv\b|process\.env\b|(?:^|[;&|]\s*)env\b"),
        "INSTALL_HOOK_NPMRC_READ": has(r"\.npmrc\b"),
        "INSTALL_HOOK_DOTENV_READ": has(r"(?:^|[\s/'\"])\.env\b"),
        "INSTALL_HOOK_OBFUSCATED": has(r"base64|\\x[0-9a-f]{2}|\batob\b|eval\b"),
        "INSTALL_HOOK_LONG_ONELINER": F.length("c") > 300,
        "INSTALL_HOOK_BINARY_BLOB": has(r"\.(?:exe|dll|so|dylib|bin)\b"),
    }
    return scripts.select("path", "hook", F.explode(_ids(rules)).alias("rule"))


def file_name_findings(paths: DataFrame) -> DataFrame:
    """path, rule, severity by the name of a file alone; native code is expected below known folders."""
    base = F.element_at(F.split("path", "/"), -1)
    native = base.rlike(r"(?i)\.(exe|dll|so|dylib|node|bin)$")
    expected = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ("prebuilds", "build", "bin"))))
    f = (
        F.when(base == "i.js", _finding("SUSPICIOUS_I_JS", "high"))
        .when(base == "init.json", _finding("SUSPICIOUS_INIT_JSON", "high"))
        .when(native, _finding("BINARY_FILE", F.when(expected, "info").otherwise("high")))
    )
    return paths.select("path", f.alias("f")).where("f IS NOT NULL").select("path", "f.rule", "f.severity")


# Extensions of files that are read.
SCANNABLE = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".py", ".sh", ".bash", ".json", ".yml", ".yaml", ".toml", ".rs", ".go", ".tf", ".hcl", ".svg", ".md")


def scannable(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*SCANNABLE)


def release_findings(assets: DataFrame) -> DataFrame:
    """release, asset, rule of release assets (release, asset, size, tagged, published)."""
    days = F.abs(F.unix_timestamp("published") - F.unix_timestamp("tagged")) / 86400
    rules = {"RELEASE_EXE_ARTIFACT": F.col("asset").rlike(r"(?i)\.(exe|msi|scr)$"), "RELEASE_7Z_ARCHIVE": F.col("asset").rlike(r"(?i)\.(7z|rar)$"), "RELEASE_SIZE_ANOMALY": F.col("size") > 100 * (1 << 20), "RELEASE_DATE_MISMATCH": days > 7}
    return assets.select("release", "asset", F.explode(_ids(rules)).alias("rule"))


def repository_trust(repos: DataFrame, now: str) -> DataFrame:
    """repo, rule of repositories (repo, account_at, created_at, stars, forks, contributors, commits)."""
    age = lambda c: (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(c)) / 86400
    rules = {
        "REPO_NEW_ACCOUNT": age("account_at") < 90,
        "REPO_RECENT_CREATION": (age("created_at") < 30) & (F.col("stars") > 50),
        "REPO_STAR_FORK_RATIO": (F.col("stars") > 100) & (F.col("forks") * 50 < F.col("stars")),
        "REPO_FEW_CONTRIBUTORS": (F.col("contributors") < 2) & (F.col("stars") > 50),
        "REPO_SINGLE_COMMIT": F.col("commits") == 1,
    }
    return repos.select("repo", F.explode(_ids(rules)).alias("rule"))


def provenance_level(workflows: DataFrame) -> DataFrame:
    """repo, level 0 to 3 from the texts (repo, text) of a repository's workflows: built there, signed, by an isolated builder."""
    has = lambda p: F.bool_or(F.col("text").rlike(p))
    built, signed, isolated = has(r"\bruns-on:"), has(r"attest-build-provenance|cosign sign|--provenance"), has(r"slsa-github-generator")
    return workflows.groupBy("repo").agg(F.when(isolated, 3).when(built & signed, 2).when(built, 1).otherwise(0).alias("level"))


def trust_signals(paths: DataFrame, signals: dict[str, str]) -> DataFrame:
    """repo, signal: what a repository's file list (repo, path) shows to be in place."""
    wide = paths.groupBy("repo").agg(*(F.bool_or(F.col("path").rlike(p)).alias(s) for s, p in signals.items()))
    return wide.select("repo", F.explode(_ids({s: F.col(s) for s in signals})).alias("signal"))


def setup_context(files: DataFrame) -> DataFrame:
    """path of setup files that both override an install command and run or fetch something."""
    has = lambda p: F.col("text").rlike(p)
    return files.where(has(r"cmdclass\s*=") & has(r"\b(?:os\.system|subprocess|urlopen|requests\.)")).select("path")


# Options of package tools whose value is the next word.
VALUED = "--prefix|--registry|--cwd|--dir|--workspace|--filter|--cache|--tag|--index-url|--extra-index-url|--find-links|--requirement|--constraint|--target|--python|-C|-w|-r|-c|-t|-f"
_BEFORE = r"^\s*(?:(?:sudo|env|command|time|nice|exec)\s+(?:-\S+\s+)*|\w+=\S*\s+)*(?:python[\d.]*\s+-m\s+)?"
_INSTALL = r"^(?:npm (?:i|in|install|add)|yarn (?:global )?add|pnpm (?:i|install|add)|bun (?:i|install|add)|pip[\d.]* install)(?=\s|$)"


def install_specs(command: Column) -> Column:
    """name and version of each package that install commands name; other commands, options and their values give none.

    Commands follow one another by &&, || and ;. What runs another command (sudo,
    env, settings of variables) is passed over.
    """
    one = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), _BEFORE, ""), rf"\s(?:{VALUED})(?:=|\s+)\S+|\s-i\s+https?:\S+", " "), r"\s--?[\w-]+(?:=\S*)?(?=\s|$)", " ")
    plain = lambda c: F.regexp_replace(one(c), r"\s+", " ")
    installs = F.filter(F.transform(F.split(command, r"&&|\|\|?|;"), plain), lambda c: c.rlike(_INSTALL))
    words = F.flatten(F.transform(installs, lambda c: F.split(F.trim(F.regexp_replace(c, _INSTALL, "")), " ")))
    specs = F.filter(words, lambda w: (w != "") & ~w.startswith("-") & ~w.rlike(r"^(?:\.|/|https?:|git\+)"))
    at = lambda w: F.regexp_extract(w, r"^(@?[^@=<>~]+)(?:@|==)?(.*)$", 1)
    version = lambda w: F.regexp_extract(w, r"^@?[^@=<>~]+(?:@|==)(.*)$", 1)
    return F.transform(specs, lambda w: F.struct(at(w).alias("name"), version(w).alias("version")))


def guard(commands: DataFrame, bad: DataFrame) -> DataFrame:
    """id, name, blocked of each package that install commands (id, command) name, against bad (name, version; null: any)."""
    named = commands.select("id", F.explode(install_specs(F.col("command"))).alias("s")).select("id", "s.name", "s.version")
    hit = named.join(bad.select("name", F.col("version").alias("bad_version")), "name", "left").where("bad_version IS NULL OR bad_version = version OR version = ''")
    found = named.join(bad.select("name").distinct().withColumn("known", F.lit(True)), "name", "left").where("known").select("id", "name").join(hit.select("id", "name").distinct().withColumn("blocked", F.lit(True)), ["id", "name"], "left")
    rest = named.join(found.select("id", "name"), ["id", "name"], "left_anti").select("id", "name", F.lit(False).alias("blocked"))
    return found.select("id", "name", F.coalesce("blocked", F.lit(False)).alias("blocked")).union(rest).distinct()


def fix_suggestions(deps: DataFrame, fixed: DataFrame) -> DataFrame:
    """name, version, suggestion: the first fixed version (name, version) that is newer in major, minor and patch."""
    key = lambda c: F.struct(semver(c)["major"], semver(c)["minor"], semver(c)["patch"])
    newer = deps.join(fixed.select("name", F.col("version").alias("to")), "name").where(key(F.col("to")) > key(F.col("version")))
    return newer.groupBy("name", "version").agg(F.min_by("to", key(F.col("to"))).alias("suggestion"))


# ------------------------------------------------------------------ text
def shown(match: Column, width: int = 120) -> Column:
    """A match as it is displayed: invisible characters by their names, ``width`` characters at most."""
    out = match
    for c in (0x200B, 0x200C, 0x200D, 0x2060, 0x202E):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"<U+{c:04X}>"))
    return F.when(F.length(out) > width, F.concat(F.substring(out, 1, width), F.lit("..."))).otherwise(out)


def public_path(path: Column) -> Column:
    """A path without what tells where it lay: home folders become ~, backslashes slashes, leading ./ goes."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    return F.regexp_replace(plain, r"^(?:/home/[^/]+|/Users/[^/]+|[A-Za-z]:/Users/[^/]+)", "~")


def csv_cell(value: Column) -> Column:
    """Quoted, quotes doubled; what a spreadsheet would run is led by an apostrophe."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def xml_text(value: Column) -> Column:
    out = value
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def markdown_cell(value: Column) -> Column:
    return F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"


def masked_comments(text: Column) -> Column:
    """The text with // and /* */ comments blanked; strings in single, double or back quotes are left alone."""
    return F.regexp_replace(text, rf"(?s)({STRINGS})|//[^\n]*|/\*.*?\*/", "$1")


def with_context(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """hits (path, line, start from 1) with the context of their start: comment, quoted, markdown_code or plain.

    Lines (path, line, content) are those of the files. A Markdown line is code
    between fences or back quotes; elsewhere what stands before the start decides,
    complete strings left out. Hits on lines that don't exist go.
    """
    markdown = F.col("path").rlike(r"(?i)\.(md|mdx|markdown)$")
    fence = F.col("content").rlike(r"^\s*(?:```|~~~)")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fenced = lines.select("path", "line", "content", (markdown & (fence | (F.sum(fence.cast("int")).over(w) % 2 == 1))).alias("_fenced"))
    before = F.substring(F.col("content"), F.lit(1), F.col("start") - 1)
    rest = F.regexp_replace(before, STRINGS, "")
    comment, quote = F.regexp_instr(rest, F.lit(r"(?<!:)//|/\*|(?:^|\s)#")), F.regexp_instr(rest, F.lit("[\"'`]"))
    code = F.col("_fenced") | (F.length(F.regexp_replace(before, "[^`]", "")) % 2 == 1)
    context = (
        F.when(markdown, F.when(code, "markdown_code").otherwise("plain"))
        .when((comment > 0) & ((quote == 0) | (comment < quote)), "comment")
        .when(quote > 0, "quoted")
        .otherwise("plain")
    )
    return hits.join(fenced, ["path", "line"]).select(*(F.col(c) for c in hits.columns), context.alias("context"))


def internet_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def retry_after(value: Column) -> Column:
    """Seconds of a Retry-After header that names a number; else null."""
    return F.when(value.rlike(r"^\s*\d+\s*$"), F.trim(value).cast("long"))


def duration_hours(value: Column) -> Column:
    """Hours of a duration such as 24h, 3d or 2w; null for others."""
    n = F.regexp_extract(value, r"^(\d+)([hdw])$", 1).try_cast("int")
    return n * F.when(value.endswith("h"), 1).when(value.endswith("d"), 24).when(value.endswith("w"), 168)
