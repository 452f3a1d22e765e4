"""More queries of the catalog: indicators, graph, triage, volatility, tokens, report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import scalars
from quarrylens.operators import indicators, rules, triage
from quarrylens.plans.catalog import DAILY, HITS, LINES, NOW, ORDERS, RANK, _daily, query
from quarrylens.sources import tables
from quarrylens.streaming import monitor

DOMAINS = ("mail2.example.com", "Mail5.example.com", "apache", "example.com")


def _located(spark, d):
    return rules.line_hits(tables.files(spark, d)).withColumn("source", F.substring_index("path", "/", 1))


@query(f"""SELECT DISTINCT path, line::INT AS line, value FROM (SELECT path, line, unnest(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9.-]*[a-z0-9]')) AS token FROM {LINES})
  JOIN (VALUES {", ".join(f"('{x.lower()}')" for x in DOMAINS)}) i(value) ON token = value OR ends_with(token, '.' || value)""")
def indicator_domains(spark, d):
    known = spark.createDataFrame([(x,) for x in DOMAINS], "value string")
    return indicators.indicator_hits(rules.lines(tables.files(spark, d)), known)


LITERALS = [("pache", False), ("EXAMPLE.com", False), ("icensed under", True), ("LICENSED UNDER", True), ("n = \"", False), ("@", True)]


@query(f"""SELECT path, line::INT AS line, CASE WHEN exact THEN value ELSE lower(value) END AS value FROM {LINES}
  JOIN (VALUES {", ".join(f"('{v}', {e})" for v, e in LITERALS)}) i(value, exact) ON CASE WHEN exact THEN contains(content, value) ELSE contains(lower(content), lower(value)) END""")
def indicator_contains(spark, d):
    return indicators.literal_hits(rules.lines(tables.files(spark, d)), spark.createDataFrame(LITERALS, "value string, exact boolean"))


GLOBS = {"CONTACT_EMAIL": (["src1*/**", "**/1?"], ["^src1[^/]*/.*$", "^(.*/)?1[^/]$"]), "ADDRESS_IPV4": (["src2/?5", "src2/**/?7"], ["^src2/[^/]5$", "^src2/(.*/)?[^/]7$"]), "LICENSE_NOTICE": (["**/*1"], ["^(.*/)?[^/]*1$"])}


@query(f"SELECT path, line::INT AS line, rule FROM {HITS} WHERE NOT ({' OR '.join(f"rule = '{r}' AND regexp_matches(path, '{p}')" for r, (_, ps) in GLOBS.items() for p in ps)})")
def policy_glob_suppression(spark, d):
    hits = rules.line_hits(tables.files(spark, d))
    return indicators.not_globbed(hits, {r: globs for r, (globs, _) in GLOBS.items()}).select("path", "line", "rule")


@query("""SELECT page_id, CASE WHEN regexp_matches(p, '/(es|it)/') THEN 'example' WHEN regexp_matches(p, '/(de|fr)/') THEN 'prose' ELSE 'source' END AS surface
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS p FROM pages)""")
def surface_classifier(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1)
    return tables.table(spark, d, "pages").select("page_id", indicators.surface(path, "/(de|fr)/", "/(es|it)/").alias("surface"))


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_manifest_explode(spark, d):
    return tables.table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")))


@query("""SELECT doc_id, token, round(-sum(p * log2(p)), 6) AS entropy FROM (
  SELECT doc_id, token, n / sum(n) OVER (PARTITION BY doc_id, token) AS p FROM (
    SELECT doc_id, token, b, count(*) AS n FROM (SELECT doc_id, token, unnest(regexp_extract_all(hex(encode(token)), '..')) AS b FROM (
      SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{40,}')) AS token FROM documents))) GROUP BY 1, 2, 3)) GROUP BY 1, 2""")
def long_token_entropy(spark, d):
    token = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/=_-]{40,}"), F.lit(0)))).alias("token")
    return tables.table(spark, d, "documents").select("doc_id", token).withColumn("entropy", F.round(scalars.byte_entropy("token"), 6))


@query("SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def digest_bridge(spark, d):
    return indicators.single_valued(tables.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query(f"""SELECT 'repository' AS type, source AS id, count(*)::BIGINT AS n FROM {HITS} GROUP BY 2 UNION ALL SELECT 'file', path, count(*)::BIGINT FROM {HITS} GROUP BY 2
  UNION ALL SELECT 'rule', rule, count(*)::BIGINT FROM {HITS} GROUP BY 2""")
def attack_graph_nodes(spark, d):
    return triage.graph_nodes(_located(spark, d))


@query(f"""SELECT source AS src, path AS dst, 'contains' AS type, max({RANK})::INT AS risk FROM {HITS} GROUP BY 1, 2
  UNION ALL SELECT path, rule, 'triggers', max({RANK})::INT FROM {HITS} GROUP BY 1, 2""")
def attack_graph_edges(spark, d):
    return triage.graph_edges(_located(spark, d))


TEMPLATES = [("O-03", 2, "pin"), ("F-12", 1, "rotate"), ("P-01", 3, "review"), ("Z-99", 1, "none")]


@query(f"""SELECT rule, priority, action, min(seq)::BIGINT AS first_seq, count(*)::BIGINT AS n
  FROM {ORDERS} JOIN (VALUES {", ".join(map(str, TEMPLATES))}) t(rule, priority, action) USING (rule) GROUP BY 1, 2, 3""")
def remediation_plan(spark, d):
    return triage.remediations(tables.order_findings(spark, d), spark.createDataFrame(TEMPLATES, "rule string, priority int, action string"))


@query(f"""SELECT doc_id, CASE WHEN quality = 1 AND decided + INTERVAL 90 DAY < TIMESTAMP '{NOW}' THEN 'expired'
    WHEN quality = 0 AND TIMESTAMP '{NOW}' - decided > INTERVAL 30 DAY THEN 'stale' ELSE 'ok' END AS state
  FROM (SELECT doc_id, quality, TIMESTAMP '1998-01-01' + to_days((doc_id % 365)::INT) AS decided FROM labels)""")
def triage_governance(spark, d):
    decided = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    rows = tables.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("new").alias("status"), decided.alias("decided"))
    due = F.date_add("decided", 90).cast("timestamp")
    return rows.select("doc_id", triage.triage_state(F.col("status"), F.col("decided").cast("timestamp"), due, NOW).alias("state"))


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS bk FROM {DAILY}),
  l AS (SELECT *, score - lag(score) OVER (PARTITION BY user_id ORDER BY day) AS step FROM t WHERE bk <= 10),
  z AS (SELECT user_id, sign(step) AS s, lag(sign(step)) OVER (PARTITION BY user_id ORDER BY day) AS p FROM l WHERE step <> 0),
  r AS (SELECT user_id, (count(*) FILTER (s <> p))::BIGINT AS reversals FROM z GROUP BY 1),
  f AS (SELECT user_id, regr_slope(score::DOUBLE, -bk::DOUBLE) AS b, regr_intercept(score::DOUBLE, -bk::DOUBLE) AS a FROM l GROUP BY 1),
  e AS (SELECT user_id, coalesce(sqrt(avg(power(score - (a - b * bk), 2))), 0) AS deviation FROM l JOIN f USING (user_id) GROUP BY 1)
  SELECT user_id, round(deviation, 4) AS deviation, coalesce(reversals, 0)::BIGINT AS reversals, deviation > 10 AND coalesce(reversals, 0) >= 2 AS volatile FROM e LEFT JOIN r USING (user_id)""")
def history_volatility(spark, d):
    return triage.volatility(_daily(spark, d), "user_id", "day", "score").withColumn("deviation", F.round("deviation", 4))


@query(f"SELECT target, seq::BIGINT AS seq, rule || '-' || (row_number() OVER (PARTITION BY target ORDER BY seq) - 1)::VARCHAR AS id, upper(severity[1]) || severity[2:] AS severity FROM {ORDERS}")
def gitlab_report_ids(spark, d):
    return triage.gitlab_ids(tables.order_findings(spark, d))


@query(f"SELECT target, count(*)::BIGINT AS tests, (count(*) FILTER (worst >= 3))::BIGINT AS failures FROM (SELECT target, rule, max({RANK}) AS worst FROM {ORDERS} GROUP BY 1, 2) GROUP BY 1")
def junit_summary(spark, d):
    return triage.suite_rows(tables.order_findings(spark, d))


@query("SELECT user_id AS key, count(*)::BIGINT AS seen, max(ts) AS newest FROM events GROUP BY 1")
def stream_last_seen(spark, d):
    schema = tables.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.newest_state(monitor.replay(spark, monitor.last_seen(events), "last-seen")).select("key", "seen", "newest")
