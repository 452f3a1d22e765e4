"""Queries over the readers of manifests, lockfiles, workflows, archives and feeds.

Every part is a repository with a generated file of each format; the SQL states what
must be read from it. Workflows and settings are samples, as in the rule families.
"""

from __future__ import annotations

import base64
import io
import json
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.plans.catalog import ORACLES, QUERIES, query
from quarrylens.sources import coverage, formats, locks, manifests, tables, workflows

_INNER = '{"dependencies": {"a{n}": {"version": "{v}", "dependencies": {"b": {"version": "1.0.0", "dependencies": {"c": {"version": "2.0.0"}}}}}}}'
#: format -> (reader, file name, text, rows to be read); {n} is the part's key, {v} its size.
READERS: dict[str, tuple] = {
    "package_json": (manifests.package_json, "package.json", '{"name": "x", "dependencies": {"a{n}": "^{v}.0.0"}, "devDependencies": {"@s/b": "1"}}', [("a{n}", "^{v}.0.0"), ("@s/b", "1")]),
    "npm_lock": (manifests.npm_lock, "package-lock.json", '{"lockfileVersion": 3, "packages": {"": {}, "node_modules/a{n}": {"version": "{v}.0.0"}, "node_modules/x/node_modules/@s/b": {"version": "1.0.0"}}}', [("a{n}", "{v}.0.0"), ("@s/b", "1.0.0")]),
    "npm_lock_v1": (formats.npm_lock_v1, "package-lock.json", _INNER, [("a{n}", "{v}"), ("b", "1.0.0"), ("c", "2.0.0")]),
    "pnpm_lock": (locks.pnpm_lock, "pnpm-lock.yaml", "lockfileVersion: '6.0'\npackages:\n  /a{n}@{v}.0.0:\n    dev: true\n  /@s/b@1.0.0:\n    dev: false\n", [("a{n}", "{v}.0.0"), ("@s/b", "1.0.0")]),
    "yarn_classic": (manifests.yarn_lock, "yarn.lock", 'a{n}@^1.0.0:\n  version "{v}.0.0"\n  resolved "https://registry.yarnpkg.com/a"\n\n"@s/b@1":\n  version "1.0.0"\n', [("a{n}", "{v}.0.0"), ("@s/b", "1.0.0")]),
    "yarn_berry": (formats.yarn_berry, "yarn.lock", '__metadata:\n  version: 6\n\n"a{n}@npm:^1.0.0":\n  version: {v}.0.0\n  checksum: x\n\n"@s/b@npm:1":\n  version: 1.0.0\n', [("a{n}", "{v}.0.0"), ("@s/b", "1.0.0")]),
    "bun_lock": (formats.bun_lock, "bun.lock", '{\n  // comment\n  "packages": {"a": ["a{n}@{v}.0.0", "", {}], "b": ["@s/b@1.0.0", {}],},\n}', [("a{n}", "{v}.0.0"), ("@s/b", "1.0.0")]),
    "cargo_lock": (manifests.cargo_lock, "Cargo.lock", '[[package]]\nname = "a{n}"\nversion = "{v}.0.0"\n\n[[package]]\nname = "b"\nversion = "1.0.0"\n', [("a{n}", "{v}.0.0"), ("b", "1.0.0")]),
    "cargo_toml": (formats.cargo_toml, "Cargo.toml", '[package]\nname = "x"\n[dependencies]\na{n} = "{v}"\nb = { version = "1", features = [] }\n[dev-dependencies]\nc = { git = "https://x.test" }\n', [("a{n}", "{v}"), ("b", "1"), ("c", "*")]),
    "poetry_lock": (manifests.poetry_lock, "poetry.lock", '[[package]]\nname = "a{n}"\nversion = "{v}.0"\n\n[[package]]\nname = "b"\nversion = "1.0"\n', [("a{n}", "{v}.0"), ("b", "1.0")]),
    "uv_lock": (locks.uv_lock, "uv.lock", 'version = 1\n\n[[package]]\nname = "a{n}"\nversion = "{v}.0"\n', [("a{n}", "{v}.0")]),
    "pipfile_lock": (locks.pipfile_lock, "Pipfile.lock", '{"default": {"a{n}": {"version": "=={v}.0", "hashes": ["sha256:x"]}}, "develop": {"b": {"version": "==1.0", "hashes": []}}}', [("a{n}", "{v}.0"), ("b", "1.0")]),
    "pyproject": (formats.pyproject, "pyproject.toml", '[project]\ndependencies = ["a{n}>={v}", "b[x]==1; python_version > \'3\'"]\n[project.optional-dependencies]\ne = ["c"]\n[dependency-groups]\nd = ["e~=1"]\n[tool.poetry.dependencies]\npython = "^3"\nf = "^2"\n', [("a{n}", ">={v}"), ("b", "==1"), ("c", ""), ("e", "~=1"), ("f", "^2")]),
    "requirements": (manifests.requirements, "requirements.txt", "a{n}=={v}.0  # pinned\n-r other.txt\nb[x]>=1,\\\n<2\n# c==1\nd\n", [("a{n}", "=={v}.0"), ("b", ">=1, <2"), ("d", "")]),
    "setup_requires": (formats.setup_requires, "setup.py", "setup(install_requires=[\n  'a{n}>={v}',\n  \"b\",\n])", [("a{n}", ">={v}"), ("b", "")]),
    "gemfile": (formats.gemfile, "Gemfile", "source 'https://rubygems.org'\ngem 'a{n}', '~> {v}'\ngem \"b\"\n", [("a{n}", "~> {v}"), ("b", "")]),
    "gemfile_lock": (locks.gemfile_lock, "Gemfile.lock", "GEM\n  remote: https://rubygems.org/\n  specs:\n    a{n} ({v}.0)\n      b (>= 1)\n    b (1.0)\n\nPLATFORMS\n  ruby\n", [("a{n}", "{v}.0"), ("b", "1.0")]),
    "composer_json": (formats.composer_json, "composer.json", '{"require": {"php": ">=8", "v/a{n}": "^{v}"}, "require-dev": {"v/b": "1.0"}}', [("v/a{n}", "^{v}"), ("v/b", "1.0")]),
    "composer_lock": (locks.composer_lock, "composer.lock", '{"packages": [{"name": "v/a{n}", "version": "{v}.0"}], "packages-dev": [{"name": "v/b", "version": "1.0"}]}', [("v/a{n}", "{v}.0"), ("v/b", "1.0")]),
    "nuget_lock": (locks.nuget_lock, "packages.lock.json", '{"dependencies": {"net8.0": {"A{n}": {"resolved": "{v}.0.0", "contentHash": "x"}}}}', [("A{n}", "{v}.0.0")]),
    "csproj": (formats.csproj, "x.csproj", '<ItemGroup><PackageReference Include="A{n}" Version="{v}.0" />\n<PackageReference Include="B" Version="1.0"/></ItemGroup>', [("A{n}", "{v}.0"), ("B", "1.0")]),
    "nuget_config": (formats.nuget_config, "nuget.config", '<add key="f{n}" value="http://x.test/{v}" />\n<add key="other" value="local/dir" />', [("f{n}", "http://x.test/{v}")]),
    "go_mod": (locks.go_mod, "go.mod", "module m\n\ngo 1.22\n\nrequire (\n\tx.test/a{n} v1.{v}.0\n\tx.test/b v1.0.0 // indirect\n)\n\nreplace (\n\tx.test/c v1.0.0 => ../c\n)\n", [("x.test/a{n}", "v1.{v}.0"), ("x.test/b", "v1.0.0")]),
    "go_sum": (manifests.go_sum, "go.sum", "x.test/a{n} v1.{v}.0 h1:abc=\nx.test/a{n} v1.{v}.0/go.mod h1:def=\n", [("x.test/a{n}", "v1.{v}.0")]),
}


def _filled(text):
    return F.replace(F.replace(text, F.lit("{n}"), F.col("p_partkey").cast("string")), F.lit("{v}"), F.col("p_size").cast("string"))


def generated(spark: SparkSession, d: str, name: str, text: str) -> DataFrame:
    """path, text: for each part the text with its key and size."""
    filled = _filled(F.lit(text))
    return tables.table(spark, d, "part").select(F.format_string(f"r%d/{name}", "p_partkey").alias("path"), filled.alias("text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


for _name, (_reader, _file, _text, _rows) in READERS.items():

    def _run(spark, d, reader=_reader, file=_file, text=_text):
        return reader(generated(spark, d, file, text)).select("path", "name", "version")

    QUERIES[f"reader_{_name}"] = _run
    ORACLES[f"reader_{_name}"] = (
        f"SELECT 'r' || p_partkey::VARCHAR || '/{_file}' AS path, replace(e.name, '{{n}}', p_partkey::VARCHAR) AS name, replace(e.version, '{{v}}', p_size::VARCHAR) AS version "
        f"FROM part, (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in _rows)}) e(name, version)"
    )

_STEP = "jobs:\n  build:\n    steps:\n"
#: Workflow samples, as (name, text).
FLOWS = [
    ("a.yml", "name: CI\non: [push]\npermissions:\n  contents: read\n" + _STEP + "      - uses: actions/checkout@v4\n      - uses: other/act@main\n      - uses: other/act@" + "0" * 39 + "1\n      - uses: other/pin@v1.2\n      - run: make\n      - uses: actions/upload-artifact@v4\n        with:\n          name: out\n"),
    ("b.yml", "name: Target\non:\n  pull_request_target:\n    branches: [main]\npermissions: write-all\n" + _STEP + "      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.head_ref }}\n      - run: |\n          echo ${{ github.event.issue.title }}\n      - uses: actions/github-script@v7\n        with:\n          script: print(\"${{ github.event.comment.body }}\")\n"),
    ("c.yml", "name: After\non:\n  workflow_run:\n    workflows: [CI]\n" + _STEP + "      - uses: actions/download-artifact@v4\n        with:\n          name: out\n      - env:\n          T: ${{ github.event.pull_request.title }}\n          S: ${{ secrets.TOKEN }}\n        run: bash -c \"$T\" && curl https://x.test\n"),
    ("d.yml", "name: Broken\non: push\n  jobs: [\n"),
]
SHA = "0" * 39 + "1"


def _flows(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(FLOWS)], "k long, name string, text string")
    # a handful of constants
    files = tables.table(spark, d, "supplier").select("s_suppkey").join(F.broadcast(rows)).select(F.format_string("s%d/%s", "s_suppkey", "name").alias("path"), "text")
    return workflows.steps(files)


def _flow_rows(values: list[tuple], columns: str) -> str:
    names = columns.split(", ")
    cell = lambda x: "NULL" if x is None else _quoted(x) if isinstance(x, str) else str(x)
    rows = ", ".join(f"({', '.join(map(cell, v))})" for v in values)
    return f"SELECT 's' || s_suppkey::VARCHAR || '/' || e.file AS path, {', '.join(f'e.{n}' for n in names)} FROM supplier, (VALUES {rows}) e(file, {columns})"


def flow_query(name: str, columns: str, values: list[tuple]):
    def add(f):
        QUERIES[name] = f
        sql = _flow_rows(values, columns)
        ORACLES[name] = sql.replace("e.idx", "e.idx::INT AS idx")
        return f

    return add


@flow_query("workflow_steps", "job, idx, uses", [("a.yml", "build", k, u) for k, u in enumerate(["actions/checkout@v4", "other/act@main", "other/act@" + SHA, "other/pin@v1.2", None, "actions/upload-artifact@v4"])] + [("b.yml", "build", 0, "actions/checkout@v4"), ("b.yml", "build", 1, None), ("b.yml", "build", 2, "actions/github-script@v7"), ("c.yml", "build", 0, "actions/download-artifact@v4"), ("c.yml", "build", 1, None)])
def workflow_steps(spark, d):
    return _flows(spark, d).where("idx IS NOT NULL").select("path", "job", "idx", "uses")


@flow_query("workflow_unreadable", "ok", [("d.yml", 0)])
def workflow_unreadable(spark, d):
    return workflows.coverage(_flows(spark, d)).withColumn("ok", F.lit(0))


@flow_query("workflow_actions", "idx, action, rule", [("a.yml", 1, "other/act", "GHA_UNPINNED_ACTION"), ("a.yml", 1, "other/act", "GHA_THIRD_PARTY_ACTION"), ("a.yml", 2, "other/act", "GHA_KNOWN_MALICIOUS_SHA"), ("a.yml", 2, "other/act", "GHA_THIRD_PARTY_ACTION"), ("a.yml", 3, "other/pin", "GHA_TAG_NOT_SHA"), ("a.yml", 3, "other/pin", "GHA_THIRD_PARTY_ACTION")])
def workflow_actions(spark, d):
    refs = workflows.action_refs(_flows(spark, d))
    return workflows.action_findings(refs, spark.createDataFrame([(SHA,)], "ref string")).select("path", "idx", "action", "rule")


@flow_query("workflow_structure", "idx, rule", [("b.yml", -1, "GHA_PRIVILEGED_TRIGGER"), ("b.yml", -1, "GHA_PERMS_WRITE_ALL"), ("b.yml", 0, "GHA_PWN_REQUEST_CHECKOUT"), ("b.yml", 1, "GHA_SCRIPT_INJECTION"), ("b.yml", 2, "GHA_GITHUB_SCRIPT_INJECTION"), ("c.yml", -1, "GHA_PRIVILEGED_TRIGGER"), ("c.yml", -1, "GHA_PERMS_DEFAULT_BROAD")])
def workflow_structure(spark, d):
    return workflows.structure_findings(_flows(spark, d)).select("path", F.coalesce("idx", F.lit(-1)).alias("idx"), "rule")


@flow_query("workflow_taint", "idx, variable", [("c.yml", 1, "T")])
def workflow_taint(spark, d):
    return workflows.tainted_reads(_flows(spark, d)).select("path", "idx", "variable")


@flow_query("workflow_secret_senders", "idx", [("c.yml", 1)])
def workflow_secret_senders(spark, d):
    return workflows.secret_senders(_flows(spark, d)).select("path", "idx")


def _graph(spark: SparkSession, d: str) -> DataFrame:
    one = tables.table(spark, d, "region").select("r_regionkey").where("r_regionkey = 0")
    rows = spark.createDataFrame(FLOWS, "name string, text string")
    return workflows.consumers(workflows.steps(one.join(F.broadcast(rows)).select(F.col("name").alias("path"), "text")))


QUERIES["workflow_consumers"] = _graph
ORACLES["workflow_consumers"] = "SELECT 'c.yml' AS consumer, 'a.yml' AS producer"


# ------------------------------------------------------------------ settings, attestations, archives, feeds
def _sampled(spark: SparkSession, d: str, texts: list[str]) -> DataFrame:
    rows = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "name string, text string")
    return tables.table(spark, d, "nation").select("n_nationkey").join(F.broadcast(rows)).select(F.format_string("n%d/%s", "n_nationkey", "name").alias("path"), "text")


def sampled_query(name: str, columns: str, values: list[tuple]):
    def add(f):
        QUERIES[name] = f
        cell = lambda x: "NULL" if x is None else _quoted(x) if isinstance(x, str) else str(x)
        rows = ", ".join(f"({', '.join(map(cell, v))})" for v in values)
        ORACLES[name] = f"SELECT 'n' || n_nationkey::VARCHAR || '/' || e.file AS path, {', '.join('e.' + c for c in columns.split(', '))} FROM nation, (VALUES {rows}) e(file, {columns})"
        return f

    return add


SERVERS = ['{ // servers\n "mcpServers": {"a": {"command": "npx", "args": ["-y", "bad-server@1.0.0"]}, "b": {"command": "npx", "args": ["@s/good"]}, "c": {"url": "http://x.test/m", "env": {"API_TOKEN": "x"}}, "d": {"url": "http://localhost:1/"}, } }', "not json"]


@sampled_query("tool_server_findings", "server, rule", [("t0", "a", "MCP_MALICIOUS_SERVER_PACKAGE"), ("t0", "b", "MCP_UNPINNED_SERVER"), ("t0", "c", "MCP_HTTP_ENDPOINT"), ("t0", "c", "MCP_ENV_SECRET_TO_REMOTE")])
def tool_server_findings(spark, d):
    return formats.tool_server_findings(formats.tool_servers(_sampled(spark, d, SERVERS)), spark.createDataFrame([("bad-server",)], "package string"))


@sampled_query("auto_commands", "command", [("t0", "a.sh"), ("t0", "b.sh"), ("t1", "c.sh")])
def auto_commands(spark, d):
    return formats.auto_commands(_sampled(spark, d, ['{"hooks": [{"on": "start", "run": {"command": "a.sh"}}, {"command": "b.sh", "x": 1}]}', '// c\n{"command": "c.sh"}', "{"]))


@sampled_query("plugin_findings", "rule", [("t0", "PLUGIN_STARTUP_ACTIVATION"), ("t0", "PLUGIN_EXTERNAL_LLM"), ("t1", "PLUGIN_AUTOCAPTURE"), ("t1", "PLUGIN_CLOUD_BACKEND")])
def plugin_findings(spark, d):
    return formats.plugin_findings(_sampled(spark, d, ['{"activation": {"onStartup": true}, "llm": {"provider": "cloud"}}', '{"capture": {"auto": true}, "llm": {"provider": "local"}, "backend": {"url": "https://x.test"}}', "{}"]))


_STATEMENT = {"predicateType": "https://slsa.dev/provenance/v1", "subject": [{"name": "p", "digest": {"sha256": "ab"}}], "predicate": {"runDetails": {"builder": {"id": "https://x.test/b"}}}}


@sampled_query("attestation_subjects", "predicate, builder, subject, digest", [("t0", _STATEMENT["predicateType"], "https://x.test/b", "p", "ab"), ("t1", _STATEMENT["predicateType"], "https://x.test/b", "p", "ab")])
def attestation_subjects(spark, d):
    wrapped = json.dumps({"dsseEnvelope": {"payload": base64.b64encode(json.dumps(_STATEMENT).encode()).decode()}})
    return formats.attestations(_sampled(spark, d, [json.dumps(_STATEMENT), wrapped, '{"payload": "%%"}']))


@sampled_query("agent_frontmatter", "head, body", [("t0", "name: x\non: push", "Do it.")])
def agent_frontmatter(spark, d):
    return formats.frontmatter(_sampled(spark, d, ["---\nname: x\non: push\n---\nDo it.", "no head\n---\n"]))


@sampled_query("policy_items", "section, item, value", [("t0", "disable", "RULE_A", None), ("t0", "severity", "RULE_B", "low"), ("t1", "warning", "unreadable policy", None)])
def policy_items(spark, d):
    return formats.policy(_sampled(spark, d, ["disable:\n  - RULE_A\nseverity:\n  RULE_B: low\n", "a: b\n   c: d"]))


@sampled_query("late_commits", "hash", [("t0", "h1")])
def late_commits(spark, d):
    each = _sampled(spark, d, ["h1\t0\t3000000\nh2\t0\t86400"]).select("path", F.explode(F.split("text", "\n")).alias("value"))
    return each.select("path", F.col("value").alias("value")).join(formats.commits(each).select("hash").distinct(), F.col("value").startswith(F.concat(F.col("hash"), F.lit("\t")))).select("path", "hash")


@sampled_query("diff_paths", "status", [("t0", "M"), ("t0", "R")])
def diff_paths(spark, d):
    each = _sampled(spark, d, ["M\ta.js\nD\tb.js\nR100\tc.js\td.js"]).select("path", F.explode(F.split("text", "\n")).alias("value"))
    changed = formats.changed_paths(each.select("value").distinct())
    return each.join(changed.select("status", F.col("path").alias("new")), F.col("value").endswith(F.concat(F.lit("\t"), F.col("new")))).select("path", "status")


FEEDS = ['[{"type": "domain", "value": "x.test", "severity": "high"}, {"type": "domain", "value": ""}]', '{"entries": [{"type": "ip", "value": "10.0.0.1"}, {"type": "odd", "value": "y"}]}', "oops"]


@sampled_query("feed_entries", "type, value, severity", [("f", "domain", "x.test", "high"), ("f", "ip", "10.0.0.1", None)])
def feed_entries(spark, d):
    entries = formats.feed(_sampled(spark, d, FEEDS).select(F.col("text").alias("value")))
    return tables.table(spark, d, "nation").join(F.broadcast(entries)).select(F.format_string("n%d/f", "n_nationkey").alias("path"), "type", "value", "severity")


@sampled_query("feed_quarantine", "type", [("f", "domain"), ("f", "odd")])
def feed_quarantine(spark, d):
    entries = formats.quarantined(_sampled(spark, d, FEEDS).select(F.col("text").alias("value"))).select("type").distinct()
    return tables.table(spark, d, "nation").join(F.broadcast(entries)).select(F.format_string("n%d/f", "n_nationkey").alias("path"), "type")


def _archives() -> list[tuple[str, bytes]]:
    out = []
    for name in ("a/ok.txt", "../out.txt"):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(name, "hello")
        out.append((f"{name[:2].strip('./') or 'bad'}.zip", b.getvalue()))
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        i = tarfile.TarInfo("d/x.js")
        i.size = 3
        t.addfile(i, io.BytesIO(b"abc"))
    out.append(("c.tgz", b.getvalue()))
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        i = tarfile.TarInfo("link")
        i.type, i.linkname = tarfile.SYMTYPE, "../../etc/passwd"
        t.addfile(i)
    return [*out, ("l.tar", b.getvalue()), ("broken.zip", b"PK rest")]


@sampled_query("archive_members", "member, size, problem", [("a.zip", "a/ok.txt", 5, None), ("bad.zip", None, -1, "leads out"), ("c.tgz", "d/x.js", 3, None), ("l.tar", None, -1, "leads out"), ("broken.zip", None, -1, "unreadable: BadZipFile")])
def archive_members(spark, d):
    rows = spark.createDataFrame(_archives(), "name string, content binary")
    files = tables.table(spark, d, "nation").select("n_nationkey").join(F.broadcast(rows)).select(F.format_string("n%d/%s", "n_nationkey", "name").alias("path"), "content")
    return formats.members(files).select("path", "member", F.coalesce("size", F.lit(-1)).alias("size"), "problem")


ORACLES["archive_members"] = ORACLES["archive_members"].replace("e.size", "e.size::BIGINT AS size")


# ------------------------------------------------------------------ coverage
def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """For each part one reader's file, by its key; a part of an odd size has its file cut to a third."""
    names = sorted(n for n in formats.WITH_PROBLEMS if n in READERS)
    rows = spark.createDataFrame([(k, n, READERS[n][1], READERS[n][2]) for k, n in enumerate(names)], "k long, reader string, file string, body string")
    part = tables.table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % len(names)).alias("k"))
    # cut before the key and the size are filled in: a cut by the filled text's length leaves a whole file for some keys
    text = F.when(F.col("p_size") % 2 == 0, F.col("body")).otherwise(F.expr("left(body, int(length(body) / 3))"))
    # a handful of constants
    return part.join(F.broadcast(rows), "k").select(F.format_string("r%d/%s/%s", "p_partkey", "reader", "file").alias("path"), _filled(text).alias("text"), "p_partkey", "p_size")


def _readers() -> dict[str, str]:
    return {n: f"/{n}/" for n in sorted(n for n in formats.WITH_PROBLEMS if n in READERS)}


@query(f"SELECT 'r' || p_partkey::VARCHAR || '/' || e.reader || '/' || e.file AS path, 'unreadable' AS state, 1::BIGINT AS n FROM part JOIN (VALUES {', '.join(f'({k}, {_quoted(n)}, {_quoted(READERS[n][1])})' for k, n in enumerate(_readers()))}) e(k, reader, file) ON p_partkey % {len(_readers())} = e.k WHERE p_size % 2 = 1")
def coverage_of_readers(spark, d):
    """Files cut short give one coverage row each; the others none."""
    return coverage.per_file(coverage.problems(_damaged(spark, d), _readers())).select("path", "state", F.col("n").cast("long").alias("n"))


@query("SELECT 'src' || (doc_id % 7)::VARCHAR AS target, bool_or(strlen(text) > 20000 OR doc_id % 50 = 3) AS partial FROM documents GROUP BY 1")
def coverage_partial_targets(spark, d):
    """Documents without content, over 20,000 bytes or absent make their target partial."""
    docs = tables.files(spark, d).withColumn("path", F.format_string("src%d/%d", F.col("doc_id") % 7, "doc_id"))
    there = docs.where("doc_id % 50 <> 3")
    _, lost = coverage.bounded(there, 20_000)
    seen = coverage.missing(docs, there).union(lost)
    targets = docs.select(F.substring_index("path", "/", 1).alias("target")).distinct().withColumn("partial", F.lit(False))
    return coverage.partial(targets, seen, F.substring_index("path", "/", 1))


ODD_FILES = [
    ("a/tool_servers", '{"mcpServers": {"a": {"args": [5, "p@1"]}, "b": 7, "c": {"command": ["x"]}, "d": {"command": "ok"}}}'),
    ("b/pyproject", '[project]\ndependencies = ["a>=1", 5]\n[dependency-groups]\nx = ["b"]\ny = [{include-group = "x"}, "c", {include-group = "z"}]\n'),
    ("c/auto_commands", "[" * 100_000),
    ("d/npm_lock_v1", '{"dependencies": {"a": 5, "b": {"version": "1", "dependencies": {"c": {"version": 2}}}}}'),
    ("e/bun_lock", '{"packages": {"a": ["a@1"], "b": 5, "c": [null], "d": ["ws"]}}'),
    ("f/attestations", '{"subject": [{"name": "p"}, 3, {"name": 4}]}'),
    ("g/cargo_toml", '[dependencies]\na = 5\nb = "1"\n'),
    ("h/tool_servers", None),
]


@sampled_query("coverage_of_odd_entries", "state, n", [("a/tool_servers", "partial", 2), ("b/pyproject", "partial", 2), ("c/auto_commands", "unreadable", 1), ("d/npm_lock_v1", "partial", 2), ("e/bun_lock", "partial", 2), ("f/attestations", "partial", 2), ("g/cargo_toml", "partial", 1), ("h/tool_servers", "unreadable", 1)])
def coverage_of_odd_entries(spark, d):
    """Each entry is judged alone; a nested, a null and an odd file end no job."""
    rows = spark.createDataFrame(ODD_FILES, "name string, text string")
    files = tables.table(spark, d, "nation").select("n_nationkey").join(F.broadcast(rows)).select(F.format_string("n%d/%s", "n_nationkey", "name").alias("path"), "text")
    return coverage.per_file(coverage.problems(files, {n: f"/{n}$" for n in formats.WITH_PROBLEMS})).select("path", "state", F.col("n").cast("int").alias("n"))
