"""More readers: nested and commented JSON, TOML and XML manifests, attestations, archives, agent and plugin settings.

files(path, text) -> path, name, version unless a reader says otherwise; what doesn't parse gives no row
here, and one in ``coverage.problems``.
"""

from __future__ import annotations

import base64
import io
import json
import posixpath
import re
import tarfile
import tomllib
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Odd(str):
    """An entry that couldn't be read, in the place of its row."""


def _by_file(files: DataFrame, read: Callable[[str], Iterable[tuple]], columns: str, source: str = "text") -> DataFrame:
    """path, the columns of what ``read`` gives for each file's text, and problem.

    Whatever goes wrong, the other files are read: a file that fails gives one row
    with the problem ``unreadable`` after what was read before, a null one too, and an
    entry that ``read`` gives as Odd one with ``odd entry`` and what it is.
    """
    names = ["path", *(c.strip().split(" ")[0] for c in columns.split(",")), "problem"]
    width = len(names) - 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, text in zip(f["path"], f[source], strict=True):
                try:
                    for row in read(text):
                        out.append((path, *[None] * width, f"odd entry: {row}") if isinstance(row, Odd) else (path, *row, None))
                except Exception as e:  # noqa: BLE001  files are hostile: none of them may end the job
                    out.append((path, *[None] * width, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", source).mapInPandas(run, f"path string, {columns}, problem string")


#: Readers that run Python in the tasks: name -> the frame with its problems.
WITH_PROBLEMS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def _reader(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The reader's rows without its problems, which ``coverage.problems`` gives."""

    def rows(files: DataFrame) -> DataFrame:
        return f(files).where("problem IS NULL").drop("problem")

    rows.__name__, rows.__doc__ = f.__name__, f.__doc__
    WITH_PROBLEMS[f.__name__] = f
    return rows


def _text(x, what: str) -> str | None:
    """x where it is a string or nothing; other values are an odd entry."""
    if x is not None and not isinstance(x, str):
        raise ValueError(what)
    return x


def _each(entries: Iterable, one: Callable) -> Iterator[tuple]:
    """What ``one`` gives for each entry, Odd where it fails."""
    for e in entries:
        try:
            yield from one(e)
        except (ValueError, KeyError, TypeError, AttributeError, IndexError):
            yield Odd(str(e)[:80])


@_reader
def npm_lock_v1(files: DataFrame) -> DataFrame:
    """package-lock.json of version 1: dependencies nested to any depth."""

    def read(text: str) -> Iterator[tuple]:
        left = [json.loads(text).get("dependencies") or {}]

        def one(entry: tuple) -> Iterator[tuple]:
            name, d = entry
            yield name, _text(d.get("version"), name)
            left.append(d.get("dependencies") or {})

        while left:
            yield from _each(left.pop().items(), one)

    return _by_file(files, read, "name string, version string")


def yarn_berry(files: DataFrame) -> DataFrame:
    """Keys with a protocol, then an indented version."""
    entry = r'(?m)^"?((?:@[^@/"\s]+/)?[^@"\s#][^@"]*)@(?:npm|patch|workspace):[^\n]*:\n(?:  [^\n]*\n)*?  version: "?([^"\n]+)'
    x = F.explode(F.regexp_extract_all("text", F.lit(entry), F.lit(0))).alias("x")
    return files.select("path", x).select("path", F.regexp_extract("x", entry, 1).alias("name"), F.regexp_extract("x", entry, 2).alias("version"))


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas to JSON; strings are left alone."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", out)


@_reader
def bun_lock(files: DataFrame) -> DataFrame:
    """bun.lock (JSON with comments); entries without a version, such as links into the workspace, give no row."""

    def one(e) -> Iterator[tuple]:
        if not isinstance(e, list) or not isinstance(e[0], str):
            raise ValueError
        if "@" in e[0][1:]:
            yield tuple(e[0].rsplit("@", 1))

    return _by_file(files, lambda text: _each((json.loads(without_comments(text)).get("packages") or {}).values(), one), "name string, version string")


_REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;]*)")


def _version(v) -> str:
    return v if isinstance(v, str) else _text(v.get("version", "*"), "version")


@_reader
def pyproject(files: DataFrame) -> DataFrame:
    """PEP 621 dependencies and extras, PEP 735 groups with what they include, and poetry's tables; python itself is left out."""

    def read(text: str) -> Iterator[tuple]:
        doc = tomllib.loads(text)
        project, poetry = doc.get("project") or {}, (doc.get("tool") or {}).get("poetry") or {}
        groups = doc.get("dependency-groups") or {}

        def spec(s) -> Iterator[tuple]:
            if isinstance(s, dict):
                if s.get("include-group") not in groups:
                    raise ValueError(s)
                return  # its entries are read where that group stands
            if not (m := _REQUIREMENT.match(s)):
                raise ValueError(s)
            yield m[1], m[2].strip()

        def entry(e: tuple) -> Iterator[tuple]:
            if e[0] != "python":
                yield e[0], _version(e[1])

        for specs in [project.get("dependencies") or [], *(project.get("optional-dependencies") or {}).values(), *groups.values()]:
            yield from _each(specs, spec)
        for table in [poetry.get("dependencies") or {}, *((g.get("dependencies") or {}) for g in (poetry.get("group") or {}).values())]:
            yield from _each(table.items(), entry)

    return _by_file(files, read, "name string, version string")


def _matches(files: DataFrame, pattern: str, name: int = 1, version: int | None = 2) -> DataFrame:
    each = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("x"))
    return each.select("path", F.regexp_extract("x", pattern, name).alias("name"), (F.regexp_extract("x", pattern, version) if version else F.lit("")).alias("version"))


def csproj(files: DataFrame) -> DataFrame:
    return _matches(files, r'<PackageReference\s+Include="([^"]+)"\s+Version="([^"]+)"')


def nuget_config(files: DataFrame) -> DataFrame:
    """Feeds by name, with their address as the version."""
    return _matches(files, r'<add\s+key="([^"]+)"\s+value="(https?://[^"]+)"')


def gemfile(files: DataFrame) -> DataFrame:
    return _matches(files, r"(?m)^\s*gem ['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?")


@_reader
def cargo_toml(files: DataFrame) -> DataFrame:
    """Dependencies of every kind; those without a version have *."""

    def read(text: str) -> Iterator[tuple]:
        doc = tomllib.loads(text)
        for k in ("dependencies", "dev-dependencies", "build-dependencies"):
            yield from _each((doc.get(k) or {}).items(), lambda e: [(e[0], _version(e[1]))])

    return _by_file(files, read, "name string, version string")


def composer_json(files: DataFrame) -> DataFrame:
    m = F.from_json("text", "require map<string,string>, `require-dev` map<string,string>")
    both = F.concat(F.coalesce(F.map_entries(m["require"]), F.array()), F.coalesce(F.map_entries(m["require-dev"]), F.array()))
    return files.select("path", F.explode(both).alias("x")).select("path", F.col("x.key").alias("name"), F.col("x.value").alias("version")).where("name <> 'php' AND NOT name LIKE 'ext-%'")


def setup_requires(files: DataFrame) -> DataFrame:
    """Names in install_requires lists of setup.py files."""
    lists = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)install_requires\s*=\s*\[(.*?)\]"), F.lit(1))).alias("l"))
    spec = F.explode(F.regexp_extract_all("l", F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))).alias("x")
    return lists.select("path", spec).select("path", F.regexp_extract("x", r"^([A-Za-z0-9._-]+)", 1).alias("name"), F.trim(F.regexp_extract("x", r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?([^;]*)", 1)).alias("version"))


def frontmatter(files: DataFrame) -> DataFrame:
    """path, head, body of texts that start with a block between lines of three dashes."""
    p = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    return files.where(F.col("text").rlike(p)).select("path", F.regexp_extract("text", p, 1).alias("head"), F.regexp_extract("text", p, 2).alias("body"))


@_reader
def tool_servers(files: DataFrame) -> DataFrame:
    """path, server, command, package, version, url, secret_env (boolean) of tool-server settings (JSON with comments)."""

    def one(entry: tuple) -> Iterator[tuple]:
        name, s = entry
        first = next((a for a in map(str, s.get("args") or []) if not a.startswith("-")), None)
        at = first.rfind("@") if first else -1
        env = any(re.search(r"TOKEN|SECRET|KEY|PASSWORD", k, re.I) for k in s.get("env") or {})
        yield name, _text(s.get("command"), name), first[:at] if at > 0 else first, first[at + 1 :] if at > 0 else None, _text(s.get("url"), name), env

    def read(text: str) -> Iterator[tuple]:
        doc = json.loads(without_comments(text))
        return _each((doc.get("mcpServers") or doc.get("servers") or {}).items(), one)

    return _by_file(files, read, "server string, command string, package string, version string, url string, secret_env boolean")


def tool_server_findings(servers: DataFrame, bad: DataFrame) -> DataFrame:
    """path, server, rule; bad(package): names known to be malicious."""
    joined = servers.join(bad.select("package", F.lit(True).alias("bad")), "package", "left")
    local = F.col("url").rlike(r"^https?://(localhost|127\.|\[::1\])")
    rules = {
        "MCP_MALICIOUS_SERVER_PACKAGE": F.col("bad"),
        "MCP_UNPINNED_SERVER": F.col("package").isNotNull() & (F.col("version").isNull() | (F.col("version") == "latest")),
        "MCP_HTTP_ENDPOINT": F.col("url").startswith("http://") & ~local,
        "MCP_ENV_SECRET_TO_REMOTE": F.col("url").isNotNull() & ~local & F.col("secret_env"),
    }
    ids = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull())
    return joined.select("path", "server", F.explode(ids).alias("rule"))


@_reader
def auto_commands(files: DataFrame) -> DataFrame:
    """path, command: every string under a key named command, at any depth, of settings that run things by themselves (JSON with comments)."""

    def read(text: str) -> list[tuple]:
        out, left = [], [json.loads(without_comments(text))]
        while left:
            x = left.pop()
            if isinstance(x, dict):
                out += [(v,) for k, v in x.items() if k == "command" and isinstance(v, str)]
                left += [v for v in x.values() if isinstance(v, dict | list)]
            elif isinstance(x, list):
                left += x
        return out

    return _by_file(files, read, "command string")


def plugin_findings(files: DataFrame) -> DataFrame:
    """path, rule of agent plugin manifests: started at once, recording by itself, an outside model or backend."""
    m = F.from_json("text", "activation struct<onStartup:boolean>, capture struct<auto:boolean>, llm struct<provider:string>, backend struct<url:string>")
    rules = {"PLUGIN_STARTUP_ACTIVATION": m["activation"]["onStartup"], "PLUGIN_AUTOCAPTURE": m["capture"]["auto"], "PLUGIN_EXTERNAL_LLM": m["llm"]["provider"] != "local", "PLUGIN_CLOUD_BACKEND": m["backend"]["url"].startswith("http")}
    ids = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull())
    return files.select("path", F.explode(ids).alias("rule"))


@_reader
def attestations(files: DataFrame) -> DataFrame:
    """path, predicate, builder, subject, digest of in-toto statements, bare or inside a DSSE envelope or bundle."""

    def read(text: str) -> Iterator[tuple]:
        doc = json.loads(text)
        envelope = doc.get("dsseEnvelope", doc)
        if "payload" in envelope:
            doc = json.loads(base64.b64decode(envelope["payload"], validate=True))
        builder = ((doc.get("predicate") or {}).get("builder") or {}).get("id") or (((doc.get("predicate") or {}).get("runDetails") or {}).get("builder") or {}).get("id")
        kind = _text(doc.get("predicateType"), "predicateType")
        return _each(doc.get("subject") or [], lambda s: [(kind, _text(builder, "builder"), _text(s.get("name"), "name"), _text((s.get("digest") or {}).get("sha256"), "digest"))])

    return _by_file(files, read, "predicate string, builder string, subject string, digest string")


# Entries, bytes in and bytes out that an archive may have.
ARCHIVE_ENTRIES, ARCHIVE_IN, ARCHIVE_OUT = 100_000, 128 << 20, 256 << 20


def _unsafe(name: str) -> bool:
    clean = posixpath.normpath(name.replace("\\", "/"))
    return clean.startswith(("/", "../")) or clean == ".." or bool(re.match(r"^[A-Za-z]:", name)) or "\0" in name


def members(files: DataFrame) -> DataFrame:
    """path, member, size, content, problem of zip, tar and tar.gz files (path, content): regular members, within the bounds.

    An archive that breaks a bound, or holds a path or link that leads out of it,
    gives one row with the problem and none of its members. A member that can't be
    read (encrypted, damaged, of an unknown method) has a problem and no content; the
    others are read. An archive that can't be opened, or ends too soon, has a row with
    the problem after the members before.
    """

    def zipped(body: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            if len(infos) > ARCHIVE_ENTRIES or sum(i.file_size for i in infos) > ARCHIVE_OUT:
                yield None, None, None, "expands too far"
            elif any(_unsafe(i.filename) or (i.external_attr >> 28) == 0o12 for i in infos):
                yield None, None, None, "leads out"
            else:
                for i in infos:
                    try:
                        yield i.filename, i.file_size, z.read(i), None
                    except Exception as e:  # noqa: BLE001  each member for itself
                        yield i.filename, i.file_size, None, f"unreadable: {type(e).__name__}"

    def tarred(body: bytes) -> list[tuple]:
        out, total = [], 0
        try:
            with tarfile.open(fileobj=io.BytesIO(body)) as t:
                for m in t:
                    total += m.size
                    if len(out) > ARCHIVE_ENTRIES or total > ARCHIVE_OUT:
                        return [(None, None, None, "expands too far")]
                    if _unsafe(m.name) or ((m.issym() or m.islnk()) and _unsafe(posixpath.join(posixpath.dirname(m.name) if m.issym() else "", m.linkname))):
                        return [(None, None, None, "leads out")]
                    if m.isfile():
                        out.append((m.name, m.size, t.extractfile(m).read(), None))
        except Exception as e:  # noqa: BLE001
            out.append((None, None, None, f"unreadable: {type(e).__name__}"))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, body in zip(f["path"], f["content"], strict=True):
                if body is None or len(body) > ARCHIVE_IN:
                    rows: Iterable[tuple] = [(None, None, None, "unreadable: no content" if body is None else "too large")]
                else:
                    rows = zipped(body) if body[:2] == b"PK" else tarred(body)
                out = []
                try:
                    for row in rows:
                        out.append((path, *row))
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, None, None, f"unreadable: {type(e).__name__}"))
                yield pd.DataFrame(out, columns=["path", "member", "size", "content", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, size long, content binary, problem string")


def has_pe_magic(content: Column) -> Column:
    """Whether a file starts as a Windows program does."""
    return F.hex(F.substring(content, 1, 2)) == "4D5A"


def commits(log: DataFrame) -> DataFrame:
    """hash, author_at, committer_at, days of log lines (hash, author and committer seconds by tabs) whose two dates are over 30 days apart."""
    part = F.split("value", "\t")
    rows = log.select(part[0].alias("hash"), part[1].cast("long").alias("author_at"), part[2].cast("long").alias("committer_at"))
    return rows.withColumn("days", F.abs(F.col("committer_at") - F.col("author_at")) / 86400.0).where("days > 30")


def changed_paths(diff: DataFrame) -> DataFrame:
    """status, path of a name-status diff (value); renames count under their new name, deletions are left out."""
    part = F.split("value", "\t")
    return diff.select(F.substring(part[0], 1, 1).alias("status"), F.element_at(part, -1).alias("path")).where("status <> 'D' AND path <> ''")


def feed(payloads: DataFrame) -> DataFrame:
    """type, value, severity of threat-feed payloads (value: a JSON array or an object with entries); invalid entries are in ``quarantined``."""
    return _entries(payloads).where("ok").select("type", "value", "severity").distinct()


def quarantined(payloads: DataFrame) -> DataFrame:
    """Entries of a feed without a known type or value."""
    return _entries(payloads).where("NOT ok").select("type", "value", "severity")


def _entries(payloads: DataFrame) -> DataFrame:
    entry = "array<struct<type:string,value:string,severity:string>>"
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", entry)).otherwise(F.from_json("value", f"entries {entry}")["entries"])
    each = payloads.where(F.trim("value").rlike(r"^[\[{]")).select(F.explode(listed).alias("e")).select("e.type", "e.value", "e.severity")
    known = F.col("type").isin("domain", "ip", "hash", "package", "wallet", "account", "url")
    return each.withColumn("ok", F.coalesce(known & (F.length("value") > 0), F.lit(False)))


def policy(files: DataFrame) -> DataFrame:
    """path, section, item, value of policy documents: lists give items without a value, mappings both; unreadable ones give a warning row."""
    from quarrylens.sources.workflows import read_yaml

    def read(text: str) -> list[tuple]:
        out = []
        for section, body in read_yaml(text).items():
            if isinstance(body, dict):
                out += [(section, str(k), v if isinstance(v, str) else json.dumps(v)) for k, v in body.items()]
            else:
                out += [(section, str(x), None) for x in ([body] if isinstance(body, str) else body or [])]
        return out

    rows = _by_file(files, read, "section string, item string, value string")
    warning = F.col("problem").isNotNull()
    return rows.select("path", F.when(warning, "warning").otherwise(F.col("section")).alias("section"), F.when(warning, "unreadable policy").otherwise(F.col("item")).alias("item"), "value")
