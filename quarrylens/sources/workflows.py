"""Workflow documents: YAML text to jobs and steps as rows, and what their structure gives away.

A small reader of the YAML that workflows are written in runs once a file in the
tasks; everything after it is DataFrame work on its rows. A text that it cannot read
gives no row and counts as unreadable in ``coverage``. Where a line stands (in a
command, an environment or elsewhere) is told from the lines' indents alone, also in
files that can't be read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "path string, triggers array<string>, listens array<string>, permissions string, job string, needs array<string>, job_permissions string, gate string, idx int, name string, uses string, run string, env map<string,string>, inputs map<string,string>, ok boolean"


_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#'"\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?|<<)\s*:(?=\s|$)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
#: Collections within one another at most; deeper documents are unreadable.
DEEPEST = 60


def _unquoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)


class _Yaml:
    """One document, block by block; ``self.at`` is the next line. Lines are (indent, text without indent and comment, whole)."""

    def __init__(self, text: str):
        whole = text.replace("\r", "").replace("\t", "  ").split("\n")
        self.lines = [(len(x) - len(x.lstrip(" ")), x.strip(" "), x) for x in whole]
        self.at, self.anchors = 0, {}

    def skip(self) -> bool:
        """To the next line that says something; whether there is one."""
        while self.at < len(self.lines) and (not self.lines[self.at][1] or self.lines[self.at][1][0] == "#" or self.lines[self.at][1] in ("---", "...")):
            self.at += 1
        return self.at < len(self.lines)

    def block_text(self, indent: int, folded: bool) -> str:
        out = []
        while self.at < len(self.lines) and (not self.lines[self.at][1] or self.lines[self.at][0] > indent):
            out.append(self.lines[self.at][2])
            self.at += 1
        depth = min((len(x) - len(x.lstrip(" ")) for x in out if x.strip()), default=0)
        return (" " if folded else "\n").join(x[depth:] for x in out).rstrip()

    def more(self, indent: int) -> str:
        """The next line, which continues a scalar or flow collection; none that stands further left."""
        if self.at >= len(self.lines) or (self.lines[self.at][1] and self.lines[self.at][0] <= indent):
            raise ValueError("it doesn't end")
        self.at += 1
        return self.lines[self.at - 1][1]

    def scalar(self, rest: str, indent: int, depth: int):
        """The value that begins with ``rest``, which may go on over further lines."""
        if rest[0] == "&":
            name, _, rest = rest[1:].partition(" ")
            self.anchors[name] = value = self.value(rest.strip(), indent, depth)
            return value
        if rest[0] == "*":
            return self.anchors[rest[1:].split()[0]]
        if rest[0] == "!":
            return self.value(rest.partition(" ")[2].strip(), indent, depth)
        if rest[0] in "|>":
            if not re.match(r"[|>][-+0-9]*\s*(?:#.*)?$", rest):
                raise ValueError(rest)
            return self.block_text(indent, rest[0] == ">")
        if rest[0] in "\"'":
            pattern = re.compile(r""""(?:\\.|[^"\\])*"|'(?:''|[^'])*'""", re.S)
            while not (m := pattern.match(rest)):
                rest += " " + self.more(indent)
            if rest[m.end() :].strip() and not re.match(r"\s+#", rest[m.end() :]):
                raise ValueError(rest)
            return _unquoted(m[0])
        if rest[0] in "[{":
            parts = [rest]
            while True:
                value, left = self.flow("\n".join(parts), depth)
                if left is not None:
                    break
                parts.append(self.more(indent))
            if left.strip() and not left.strip().startswith("#"):
                raise ValueError(left)
            return value
        out = [re.sub(r"\s+#.*$", "", rest)]
        # a plain scalar goes on over lines that stand further right, none of them a key
        while self.at < len(self.lines) and self.lines[self.at][1] and self.lines[self.at][0] > indent and not _KEY.match(self.lines[self.at][1]) and self.lines[self.at][1][0] != "#" and "#" not in rest[len(out[0]) :]:
            out.append(re.sub(r"\s+#.*$", "", self.more(indent)))
        return " ".join(out)

    def flow(self, text: str, depth: int):
        """(value, what follows) of a flow collection; (None, None) where the text ends too soon."""
        token = re.compile(r"""\s*(?:\#[^\n]*\s*)?([\[\]{},]|:(?=[\s,\[\]{}"']|$)|"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|(?:[^\s\[\]{},:#"']|:(?![\s,\[\]{}]|$)|[ \t](?=[^\s\[\]{},:#])|\#)+)""", re.S)
        stack: list = []
        at, key, last = 0, None, None
        keys: list = []
        while m := token.match(text, at):
            at, t = m.end(), m[1]
            if t in "[{":
                if depth + len(stack) > DEEPEST:
                    raise ValueError("too deep")
                stack.append([] if t == "[" else {})
                keys.append(key)
                key = last = None
            elif t in "]},":
                top = stack[-1]
                if key is not None:
                    pair = {key: last[0] if last else None}
                    top.append(pair) if isinstance(top, list) else top.update(pair)
                elif last:
                    top.append(last[0]) if isinstance(top, list) else top.update({str(last[0]): None})
                key = last = None
                if t != ",":
                    if (t == "]") != isinstance(top, list):
                        raise ValueError(text)
                    last, key = (stack.pop(),), keys.pop()
                    if not stack:
                        return last[0], text[at:]
            elif t == ":":
                key, last = str(last[0]) if last else "", None
            else:
                if last:
                    raise ValueError(text)
                last = (_unquoted(t) if t[0] in "\"'" else self.anchors[t[1:]] if t[0] == "*" else t.strip(),)
        if text[at:].strip() and not text[at:].strip().startswith(("#", '"', "'")):
            raise ValueError(text)
        return None, None

    def value(self, rest: str, indent: int, depth: int):
        """What stands after a key or a dash: on its line, or below it, further right (a sequence also as far left as its key)."""
        if rest and rest[0] != "#":
            return self.scalar(rest, indent, depth)
        if self.skip() and (self.lines[self.at][0] > indent or (self.lines[self.at][0] == indent and re.match(r"-(?:\s|$)", self.lines[self.at][1]))):
            return self.node(self.lines[self.at][0], depth + 1)
        return None

    def node(self, indent: int, depth: int = 0):
        if depth > DEEPEST:
            raise ValueError("too deep")
        text = self.lines[self.at][1]
        if re.match(r"-(?:\s|$)", text):
            items = []
            while self.skip() and self.lines[self.at][0] == indent and (m := re.match(r"-(?:\s+|$)", self.lines[self.at][1])):
                rest = self.lines[self.at][1][m.end() :]
                inner = indent + m.end()
                if re.match(r"-(?:\s|$)", rest) or _KEY.match(rest):
                    # what follows the dash is a node of its own, as if the dash were blanks
                    self.lines[self.at] = (inner, rest, " " * inner + rest)
                    items.append(self.node(inner, depth + 1))
                else:
                    self.at += 1
                    items.append(self.value(rest, indent, depth))
            return items
        if not _KEY.match(text):
            self.at += 1
            return self.scalar(text, indent - 1, depth)
        out: dict = {}
        while self.skip() and self.lines[self.at][0] == indent:
            m = _KEY.match(self.lines[self.at][1])
            if not m:
                raise ValueError(self.lines[self.at][1])
            self.at += 1
            key, value = m[1], self.value(self.lines[self.at - 1][1][m.end() :].strip(), indent, depth)
            if key == "<<":
                for other in value if isinstance(value, list) else [value]:
                    out = dict(other) | out
            else:
                out[_unquoted(key) if key[0] in "\"'" else key] = value
        if self.at < len(self.lines) and self.lines[self.at][0] > indent:
            raise ValueError(self.lines[self.at][1])
        return out


def read_yaml(text: str):
    """Nested dicts, lists and strings of a document; raises ValueError where a line fits nowhere.

    Block and flow collections, plain, quoted and block scalars over any number of
    lines, comments, anchors, aliases and merge keys are read; a second document isn't.
    """
    y = _Yaml(text)
    if not y.skip():
        return {}
    out = y.node(y.lines[y.at][0])
    if y.skip():
        raise ValueError(y.lines[y.at][1])
    return out


def _strings(x) -> dict[str, str]:
    return {str(k): "" if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in x.items()} if isinstance(x, dict) else {}


def _list(x) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else [str(i) for i in x]


def _rows(path: str, text: str | None) -> list[dict]:
    none = {"path": path, "triggers": [], "listens": [], "permissions": None, "job": None, "needs": [], "job_permissions": None, "gate": None, "idx": None, "name": None, "uses": None, "run": None, "env": {}, "inputs": {}, "ok": False}
    try:
        doc = read_yaml(text or "")
        flat = lambda p: None if p is None else p if isinstance(p, str) else json.dumps(p, sort_keys=True)
        on = doc.get("on")
        listens = _list((on.get("workflow_run") or {}).get("workflows")) if isinstance(on, dict) else []
        top = none | {"triggers": _list(on), "listens": listens, "permissions": flat(doc.get("permissions")), "name": doc.get("name"), "env": _strings(doc.get("env")), "ok": True}
        out = [top]
        for job, j in (doc.get("jobs") or {}).items():
            base = top | {"job": job, "needs": _list(j.get("needs")), "job_permissions": flat(j.get("permissions")), "gate": j.get("if"), "env": _strings(doc.get("env")) | _strings(j.get("env"))}
            for k, s in enumerate(j.get("steps") or []):
                out.append(base | {"idx": k, "name": s.get("name"), "uses": s.get("uses"), "run": s.get("run"), "env": base["env"] | _strings(s.get("env")), "inputs": _strings(s.get("with"))})
        return out
    except Exception:  # noqa: BLE001  whatever a file holds, the others are read
        return [none]


def steps(files: DataFrame) -> DataFrame:
    """One row for each file (job null) and each step, with what is in scope there: triggers, permissions, needs, environment."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", SCHEMA)]
        for f in frames:
            yield pd.DataFrame([r for p, t in zip(f["path"], f["text"], strict=True) for r in _rows(p, t)], columns=names)

    return files.select("path", "text").mapInPandas(read, SCHEMA)


def coverage(rows: DataFrame) -> DataFrame:
    """path of the files that could not be read."""
    return rows.where("NOT ok").select("path").distinct()


# Triggers that run with secrets on outside contributions, and what outsiders can write.
PRIVILEGED = ("pull_request_target", "workflow_run", "issue_comment")
UNTRUSTED = r"\$\{\{\s*github\.(?:event\.(?:issue|pull_request|comment|review|discussion|head_commit)\.[a-z_.]*(?:title|body|message|ref|label|name|email)|head_ref)\b"


def action_refs(rows: DataFrame) -> DataFrame:
    """path, job, idx, owner, action, ref, kind (sha, version, branch, none) of each used action; local and container ones are left out."""
    used = rows.where("uses IS NOT NULL AND NOT uses RLIKE '^(\\\\./|docker://)'")
    ref = F.regexp_extract("uses", "@(.+)$", 1)
    kind = F.when(ref == "", "none").when(ref.rlike("^[0-9a-f]{40}$"), "sha").when(ref.rlike(r"^v?[0-9]+(\.[0-9]+)*$"), "version").otherwise("branch")
    return used.select("path", "job", "idx", F.substring_index("uses", "/", 1).alias("owner"), F.substring_index("uses", "@", 1).alias("action"), ref.alias("ref"), kind.alias("kind"))


def action_findings(refs: DataFrame, malicious: DataFrame, trusted: tuple[str, ...] = ("actions", "github")) -> DataFrame:
    """Rules on action references: known bad commits (malicious: ref), branches, tags, owners that are not trusted."""
    joined = refs.join(malicious.select("ref", F.lit(True).alias("bad")), "ref", "left")
    own = F.col("owner").isin(*trusted)
    rules = {"GHA_KNOWN_MALICIOUS_SHA": F.col("bad"), "GHA_UNPINNED_ACTION": F.col("kind").isin("branch", "none"), "GHA_TAG_NOT_SHA": (F.col("kind") == "version") & ~own, "GHA_THIRD_PARTY_ACTION": ~own}
    return _found(joined, rules, "path", "job", "idx", "action")


def _found(rows: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    ids = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(ids).alias("rule"))


def structure_findings(rows: DataFrame) -> DataFrame:
    """path, job, idx, rule: privileged triggers, checkouts of outside code under them, scripts and commands with outside text, broad permissions."""
    privileged = F.arrays_overlap("triggers", F.array(*map(F.lit, PRIVILEGED)))
    top = F.col("job").isNull() & F.col("ok")
    rules = {
        "GHA_PRIVILEGED_TRIGGER": top & privileged,
        "GHA_PERMS_WRITE_ALL": top & (F.col("permissions") == "write-all"),
        "GHA_PERMS_DEFAULT_BROAD": top & F.col("permissions").isNull(),
        "GHA_PWN_REQUEST_CHECKOUT": privileged & F.col("uses").startswith("actions/checkout") & F.element_at("inputs", "ref").rlike(r"github\.(?:head_ref|event\.pull_request\.head)"),
        "GHA_GITHUB_SCRIPT_INJECTION": F.col("uses").startswith("actions/github-script") & F.element_at("inputs", "script").rlike(UNTRUSTED),
        "GHA_SCRIPT_INJECTION": F.col("run").rlike(UNTRUSTED),
    }
    return _found(rows, rules, "path", "job", "idx")


def tainted_reads(rows: DataFrame) -> DataFrame:
    """path, job, idx, variable: variables set from outside text that the step's command reads into a shell evaluation."""
    assigned = rows.where("run IS NOT NULL").select("path", "job", "idx", "run", F.explode("env").alias("variable", "value")).where(F.col("value").rlike(UNTRUSTED))
    reads = F.explode(F.array_distinct(F.regexp_extract_all("run", F.lit(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("variable")
    read = rows.where(F.col("run").rlike(r"\b(?:eval|bash -c|sh -c)\b")).select("path", "job", "idx", reads)
    return assigned.drop("run", "value").join(read, ["path", "job", "idx", "variable"]).distinct()


def secret_senders(rows: DataFrame) -> DataFrame:
    """path, job, idx of the steps that have a secret in scope and run a network command."""
    secret = F.exists(F.map_values("env"), lambda v: v.rlike(r"\$\{\{\s*secrets\."))
    return rows.where(secret & F.col("run").rlike(r"\b(?:curl|wget|nc)\b")).select("path", "job", "idx")


def artifacts(rows: DataFrame, action: str) -> DataFrame:
    """path, artifact of upload-artifact or download-artifact steps; null where the name is not known before the run."""
    name = F.element_at("inputs", "name")
    return rows.where(F.col("uses").startswith(f"actions/{action}-artifact")).select("path", F.when(~name.contains("${{"), name).alias("artifact"))


def consumers(rows: DataFrame) -> DataFrame:
    """consumer, producer: privileged workflows that download what another workflow uploads; an unknown name may be any."""
    up, down = artifacts(rows, "upload"), artifacts(rows, "download")
    many = lambda df, who: df.groupBy(F.col("path").alias(who)).agg(F.collect_set("artifact").alias(f"{who}_names"), F.bool_or(F.col("artifact").isNull()).alias(f"{who}_any"))
    runs = rows.where("job IS NULL").select(F.col("path").alias("consumer"), F.explode("listens").alias("wanted"))
    named = rows.where("job IS NULL").select(F.col("path").alias("producer"), F.col("name").alias("wanted"))
    pairs = runs.join(named, "wanted").join(many(down, "consumer"), "consumer").join(many(up, "producer"), "producer")
    return pairs.where(F.col("consumer_any") | F.col("producer_any") | F.arrays_overlap("consumer_names", "producer_names")).select("consumer", "producer")


# ------------------------------------------------------------------ regions
_LINE_KEY = r"^\s*((?:-\s+)*)[\"']?([\w-]+)[\"']?\s*:(?:\s+(.*))?$"
#: Keys whose value is run.
RUN_KEYS = ("run", "script")


def _spans(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """path, start, stop (lines) of what stands below each head (path, line, column): up to the next line that doesn't stand further right.

    Each line meets the columns of its file's heads, which are a few; the line that
    ends a head's span is the next one of those at or left of its column.
    """
    columns = heads.select("path", "column").distinct()
    ends = lines.join(columns, "path").where("indent <= column").select("path", "column", "line")
    following = F.lead("line").over(Window.partitionBy("path", "column").orderBy("line"))
    spans = ends.withColumn("next", following).join(heads.select("path", "line", "column"), ["path", "column", "line"])
    return spans.select("path", (F.col("line") + 1).cast("long").alias("start"), F.coalesce(F.col("next") - 1, F.lit(1 << 40)).cast("long").alias("stop")).where("stop >= start")


def regions(files: DataFrame) -> DataFrame:
    """path, line, content, region of the lines that aren't blank: exec (part of a command), env (set as data) or other.

    What stands below a command is part of it whatever it looks like.
    """
    from quarrylens.operators import fixpoint
    from quarrylens.operators.assess import within

    each = files.select("path", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("i", "content")).where("trim(content) <> ''")
    bare = F.regexp_replace("content", r"(?:^|\s+)#.*$", "")
    lines = each.select("path", (F.col("i") + 1).cast("long").alias("line"), "content", F.length(F.regexp_extract("content", r"^ *", 0)).alias("indent"), bare.alias("bare"))
    key, value = F.regexp_extract("bare", _LINE_KEY, 2), F.trim(F.regexp_extract("bare", _LINE_KEY, 3))
    # read many times below: what files it comes from, and the keys, are worked out once
    lines = fixpoint.staged(lines.select("path", "line", "content", "indent", (F.col("indent") + F.length(F.regexp_extract("bare", _LINE_KEY, 1))).alias("column"), key.alias("key"), value.alias("value")), "region-lines")
    keyed = lines.select("path", "line", "column", "key", "value")
    lines = lines.select("path", "line", "content", "indent")
    runs = keyed.where(F.col("key").isin(*RUN_KEYS))
    at_once = runs.where("value <> '' AND NOT value RLIKE '^[|>][0-9+-]*$'").select("path", "line")
    below = within(lines.select("path", "line"), _spans(lines, runs), "path", "line").select("path", "line")
    executed = at_once.union(below).distinct().withColumn("executed", F.lit(True))
    marked = keyed.join(executed, ["path", "line"], "left").where("key = 'env' AND executed IS NULL")
    data = within(lines.select("path", "line"), _spans(lines, marked.where("value = ''")), "path", "line").select("path", "line").union(marked.where("value <> ''").select("path", "line"))
    both = lines.join(executed, ["path", "line"], "left").join(data.distinct().withColumn("data", F.lit(True)), ["path", "line"], "left")
    return both.select("path", "line", "content", F.when(F.col("executed"), "exec").when(F.col("data"), "env").otherwise("other").alias("region"))


#: Rules of the workflow family that speak of the structure; the others of what is run.
STRUCTURAL = ("GHA_OIDC_WRITE_PERM", "GHA_CACHE_POISONING", "GHA_BASE64_PAYLOAD")


def rule_hits(files: DataFrame) -> DataFrame:
    """path, line, rule, severity: the workflow rules' hits, those on commands in commands only."""
    from quarrylens.operators import families, rules

    hits = rules.line_hits(files, families.WORKFLOW)
    placed = hits.join(regions(rules.able(files, families.WORKFLOW)).select("path", F.col("line").cast("int").alias("line"), "region"), ["path", "line"])
    return placed.where(F.col("rule").isin(*STRUCTURAL) | (F.col("region") == "exec")).select("path", "line", "rule", "severity")
