"""Queries over lexical contexts, internal disclosure and data flow; their files hang on the keys and sizes of parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import contexts, disclosure, flow
from quarrylens.plans.catalog import query
from quarrylens.sources import tables


def by_part(spark: SparkSession, d: str, name: str, *lines: F.Column | str) -> DataFrame:
    """path (part<key>/name), text (lines; {n} is the part's key) for each part."""
    filled = [F.replace(F.lit(x) if isinstance(x, str) else x, F.lit("{n}"), F.col("p_partkey").cast("string")) for x in lines]
    return tables.table(spark, d, "part").select(F.format_string(f"part%d/{name}", "p_partkey").alias("path"), F.concat_ws("\n", *filled).alias("text"))


def even(yes: str, no: str) -> F.Column:
    """One of two lines by the part's size."""
    return F.when(F.col("p_size") % 2 == 0, yes).otherwise(no)


def even_column(yes: F.Column, no: F.Column) -> F.Column:
    return F.when(F.col("p_size") % 2 == 0, yes).otherwise(no)


@query("""SELECT 'part' || p_partkey::VARCHAR || '/a.js' AS path, e.line::INT AS line, e.context FROM part, (VALUES
  (0, 1, 'plain'), (0, 2, 'comment'), (0, 3, 'comment'), (0, 4, 'plain'), (0, 5, 'quoted'), (0, 6, 'quoted'), (0, 7, 'plain'),
  (1, 1, 'plain'), (1, 2, 'quoted'), (1, 3, 'plain'), (1, 4, 'plain'), (1, 5, 'quoted'), (1, 6, 'quoted'), (1, 7, 'plain')) e(odd, line, context) WHERE p_size % 2 = e.odd""")
def contexts_across_lines(spark, d):
    """Line by line the context of the letter X: a block comment that half of the files open, a template over two lines."""
    files = by_part(spark, d, "a.js", even("X = 1; /* open", "X = 1; // shut /*"), "it's X", 'X " */', 'f("X*/", X)'.replace('"X*/", ', '"*/", '), "t = `a X", "b ${X} `; '`'", "X")
    at = F.instr("content", "X")
    return contexts.lines(files).select("path", "line", contexts.context(F.col("content"), at, F.col("kind"), F.col("entry")).alias("context"))


@query("""SELECT 'part' || p_partkey::VARCHAR || '/' || e.file AS path, e.line::INT AS line, e.rule, e.context FROM part, (VALUES
  (0, 'a.ts', 2, 'INTERNAL_SINGLE_LABEL_URL', 'comment'), (0, 'a.ts', 4, 'INTERNAL_PRIVATE_IP', 'quoted'), (1, 'a.ts', 4, 'INTERNAL_PRIVATE_IP', 'quoted'),
  (0, 'a.md', 1, 'INTERNAL_PRIVATE_IP', 'plain'), (1, 'a.md', 1, 'INTERNAL_PRIVATE_IP', 'plain'), (1, 'a.md', 3, 'INTERNAL_PRIVATE_IP', 'plain')) e(odd, file, line, rule, context) WHERE p_size % 2 = e.odd""")
def internal_disclosure(spark, d):
    """Addresses count by their context: code that looks like one doesn't, nor what stands in a Markdown fence."""
    ts = by_part(spark, d, "a.ts", even("/* hosts", "/* hosts */"), "see http://box{n}/ and", "*/ x.http://box{n}/", 'const h = ["8.8.8.8", "10.0.0.1"]')
    md = by_part(spark, d, "a.md", "host 10.1.2.3", even("```", ""), "ping 10.1.2.4", "`10.9.9.9`", "/home/jdoe/x")
    return disclosure.scan(ts.union(md)).select("path", "line", "rule", "context")


@query("""SELECT doc_id || '.txt' AS path, line::INT AS line FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS content, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line
    FROM (SELECT doc_id, regexp_replace(text, '[0-9]{1,3}[.]([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})', '10.\\1', 'g') AS t FROM documents))
  WHERE len(list_filter(regexp_extract_all(' ' || regexp_replace(content, '[^0-9.]', ' ', 'g') || ' ', '[0-9.]+'), lambda x: regexp_full_match(x, '([0-9]{1,3}[.]){3}[0-9]{1,3}') AND (
      split_part(x, '.', 1) = '10' OR (split_part(x, '.', 1) = '192' AND split_part(x, '.', 2) = '168') OR (split_part(x, '.', 1) = '172' AND try_cast(split_part(x, '.', 2) AS INT) BETWEEN 16 AND 31))
      AND try_cast(split_part(x, '.', 2) AS INT) < 256 AND try_cast(split_part(x, '.', 3) AS INT) < 256 AND try_cast(split_part(x, '.', 4) AS INT) < 256)) > 0""")
def internal_addresses_in_documents(spark, d):
    """Addresses of the documents, moved into a private network."""
    moved = F.regexp_replace("text", r"[0-9]{1,3}\.([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", "10.$1")
    docs = tables.files(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), moved.alias("text"))
    only = tuple(r for r in disclosure.families.INTERNAL if r.id == "INTERNAL_PRIVATE_IP")
    return disclosure.scan(docs, only).select("path", "line")


# ------------------------------------------------------------------ data flow
@query("""SELECT 'part' || p_partkey::VARCHAR || '/a.js' AS path, 2::INT AS line, (3 + p_partkey % 6)::INT AS sink_line FROM part WHERE p_size % 2 = 0""")
def credential_alias_chains(spark, d):
    """A token that goes over up to five further names; where the size is odd, the name sent is an inner one that shadows it."""
    chain = [F.when(F.col("p_partkey") % 6 >= k, F.lit(f"  const a{k} = 'x' + a{k - 1};")) for k in range(1, 6)]
    last = F.concat(F.lit("a"), (F.col("p_partkey") % 6).cast("string"))
    send = even_column(F.concat(F.lit("  fetch(u, { body: "), last, F.lit(" });")), F.concat(F.lit("  list.map(("), last, F.lit(") => { fetch(u, "), last, F.lit("); });")))
    return flow.credential_flow(by_part(spark, d, "a.js", "function run{n}(u) {", "  const a0 = process.env.NPM_TOKEN; // secret", *chain, send, "}"))


@query("""SELECT 'part' || p_partkey::VARCHAR || '/a.js' AS path, e.line::INT AS line, e.sink::INT AS sink_line FROM part JOIN (VALUES (0, 1, 2), (2, 3, 5), (4, 1, 4), (6, 1, 1)) e(k, line, sink) ON p_partkey % 8 = e.k""")
def credential_flow_cases(spark, d):
    cases = [
        "let t = read('.npmrc');\nhttp.request(t);",
        "let t = read('.npmrc');\nt = 'none';\nhttp.request(t);",
        "let t = '';\nif (a) {\n  t = process.env.NODE_AUTH_TOKEN;\n}\nfetch(t);",
        "function f() { const t = process.env.NPM_TOKEN; }\nfunction g(t) { fetch(t); }\nfetch(t);",
        "const t = process.env.NPM_TOKEN;\nfunction f() {\n  const o = { k: t };\n  axios.post(u, o);\n}",
        "// const t = process.env.NPM_TOKEN\nconst t = 'fetch(process.env.NPM_TOKEN)';\nfetch(t.length);".replace("'fetch(process.env.NPM_TOKEN)'", "`a`"),
        "fetch(u + process.env.NPM_TOKEN)",
        "const t = process.env.NPM_TOKEN;\nlog(t); fetch(u, { t: 1 });",
    ]
    return flow.credential_flow(by_part(spark, d, "a.js", F.element_at(F.array(*map(F.lit, cases)), (F.col("p_partkey") % 8 + 1).cast("int"))))


@query("""SELECT 'part' || p_partkey::VARCHAR || '/a.py' AS path, e.line::INT AS line, e.exec::INT AS exec_line FROM part JOIN (VALUES (0, 2, 3), (2, 2, 4), (3, 2, 6), (4, 1, 1), (6, 3, 4)) e(k, line, exec) ON p_partkey % 8 = e.k""")
def decode_then_exec(spark, d):
    cases = [
        "import base64\np = base64.b64decode(s)\nexec(p)",
        "import base64\np = base64.b64decode(s)\np = 'safe'\nexec(p)",
        "import base64\np = base64.b64decode(s)\nif x:\n    p = 'safe'; exec(p)",
        "import base64\np = base64.b64decode(\n  s,\n  # exec(p)\n)\nexec(p, {})",
        "exec(base64.b64decode(s))",
        "p = base64.b64decode(s)\nrunner.exec(p); execute(p)",
        'x = """\n"""\np = b64decode(s)\nq = 1; exec(p); exec(q)',
        "# p = b64decode(s)\np = 'b64decode(s)'\nexec(p)",
    ]
    return flow.decode_then_exec(by_part(spark, d, "a.py", F.element_at(F.array(*map(F.lit, cases)), (F.col("p_partkey") % 8 + 1).cast("int"))))


@query("""SELECT 'part' || p_partkey::VARCHAR || '/a.js' AS path, e.line::INT AS line, e.destroy::INT AS destroy_line FROM part JOIN (VALUES (0, 1, 3), (1, 1, 3), (5, 2, 2)) e(k, line, destroy) ON p_partkey % 7 = e.k""")
def gated_destruction(spark, d):
    cases = [
        "const l = navigator.language;\nif (l === 'xx') {\n  fs.rmSync(home); fs.unlinkSync(home);\n}",
        "const z = Intl.DateTimeFormat().resolvedOptions(); const t = z.timeZone;\nif (t.startsWith('Xx/')) { log(1); {\n  rimraf('/');\n} }",
        "const l = navigator.language;\nif (l) {\n  fs.rmSync(home);\n}",
        "const l = navigator.language;\nif (l === 'xx') { log(l); }\nfs.rmSync(home);",
        "const l = navigator.language;\nif (l === 'xx') {\n" + "\n" * 16 + "  fs.rmSync(home);\n}",
        "function f() {\n  if (new Date().getTimezoneOffset() < -100) { fs.rmSync(a); }\n}",
        "const l = navigator.language;\nif (k === 'xx') {\n  fs.rmSync(home);\n}",
    ]
    return flow.gated_destruction(by_part(spark, d, "a.js", F.element_at(F.array(*map(F.lit, cases)), (F.col("p_partkey") % 7 + 1).cast("int"))))
