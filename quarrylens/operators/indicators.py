"""Text against indicator lists, and path globs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host-like or word-like tokens of lower-cased text.
TOKEN = r"[a-z0-9][a-z0-9.-]*[a-z0-9]"


def parent_names(token: Column) -> Column:
    """The token and what is left of it after each dot: a.b.c, b.c, c."""
    parts = F.split(token, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def indicator_hits(lines: DataFrame, indicators: DataFrame) -> DataFrame:
    """path, line, value of indicators(value) that are a token of the line or a parent domain of one.

    Tokens meet indicators in an equi-join, so the work grows with the text and not
    with text times indicators. Indicators are lower-cased; repeated ones count once.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(TOKEN), F.lit(0)))
    each = lines.select("path", "line", F.explode(F.array_distinct(F.flatten(F.transform(tokens, parent_names)))).alias("value"))
    return each.join(indicators.select(F.lower("value").alias("value")).distinct(), "value").select("path", "line", "value")


#: Indicators that one automaton holds; a longer list is searched in blocks.
LITERALS = 100_000


def literal_hits(lines: DataFrame, indicators: DataFrame, block: int = LITERALS, content: bool = False) -> DataFrame:
    """path, line, value (and, if asked for, content) of indicators(value, exact: boolean) that stand anywhere in the line, whatever surrounds them.

    Case counts for exact ones (addresses) only. One pass over the lines for each
    ``block`` indicators, by an Aho-Corasick automaton in the tasks: the work does not
    grow with lines times indicators, and what is broadcast has a bound.
    """
    wanted = indicators.where("length(value) > 0").select(F.when(F.col("exact"), F.col("value")).otherwise(F.lower("value")).alias("value"), "exact").distinct()
    blocks = max(1, -(-wanted.count() // block))
    out = None
    for k in range(blocks):
        part = [(r["value"], r["exact"]) for r in wanted.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == k).collect()]
        share = lines.sparkSession.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            machines = []
            for exact in (True, False):
                a = ahocorasick.Automaton()
                for value, kind in share.value:
                    if kind == exact:
                        a.add_word(value, value)
                if len(a):
                    a.make_automaton()
                    machines.append((a, exact))
            for b in batches:
                found = [
                    (i, v)
                    for i, text in enumerate(b.column(2).to_pylist()) if text
                    for v in sorted({v for a, exact in machines for _, v in a.iter(text if exact else text.lower())})
                ]
                rows = pa.array([i for i, _ in found], pa.int64())
                cols = [b.column(0).take(rows), b.column(1).take(rows), pa.array([v for _, v in found], pa.string()), b.column(2).take(rows)]
                yield pa.RecordBatch.from_arrays(cols if content else cols[:3], ["path", "line", "value", "content"][: 3 + content])

        each = lines.select("path", F.col("line").cast("int").alias("line"), "content").mapInArrow(search, "path string, line int, value string" + ", content string" * content)
        out = each if out is None else out.union(each)
    return out


# Files that speak about indicators rather than use them.
PROSE = r"(?i)(^|/)(changelog|security|readme)[^/]*$|\.(md|mdx|rst|adoc)$"


def wildcard_hits(lines: DataFrame, indicators: DataFrame, skip: str | None = PROSE) -> DataFrame:
    """path, line, value of indicators(value) with ``*`` for one or more word characters, whatever their case; prose is skipped.

    Each indicator is filed under its longest piece without a ``*``; one automaton
    finds those pieces, and only there the whole pattern is tried. An indicator without
    any such piece matches nothing. A line has a value once.
    """
    parts = F.split(F.lower("value"), r"\*")
    longest = F.array_max(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    regex = F.array_join(F.transform(parts, lambda p: F.when(p == "", "").otherwise(F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))), r"\w+")
    filed = indicators.select("value", longest.alias("piece"), regex.alias("regex")).where("piece IS NOT NULL").distinct()
    searched = lines.where(~F.col("path").rlike(skip)) if skip else lines
    found = literal_hits(searched, filed.select(F.col("piece").alias("value"), F.lit(False).alias("exact")).distinct(), content=True).withColumnRenamed("value", "piece")
    tried = found.join(filed, "piece").where(F.expr("lower(content) RLIKE regex"))
    return tried.select("path", "line", "value").distinct()


def feed_hits(lines: DataFrame, feed: DataFrame, skip: str | None = PROSE) -> DataFrame:
    """path, line, value, pos, severity: feed rows (pos, type, value, severity) but packages, found in the text.

    Domains may hold ``*``; other values are literal. Of rows with one value the first counts.
    """
    first = feed.where("type <> 'package' AND length(value) > 0").groupBy("value").agg(F.min_by(F.struct("pos", "type", "severity"), "pos").alias("x")).select("value", "x.*")
    wild = (F.col("type") == "domain") & F.col("value").contains("*")
    literal = literal_hits(lines.where(~F.col("path").rlike(skip)) if skip else lines, first.where(~wild).select("value", (F.col("type").isin("wallet", "account")).alias("exact")))
    exact = F.when(F.col("type").isin("wallet", "account"), F.col("value")).otherwise(F.lower("value"))
    named = literal.withColumnRenamed("value", "key").join(first.where(~wild).withColumn("key", exact), "key")
    wildly = wildcard_hits(lines, first.where(wild).select("value"), skip).join(first, "value")
    cols = ["path", "line", "value", "pos", "severity"]
    return named.select(*cols).union(wildly.select(*cols))


def glob_regex(glob: str) -> str:
    """Anchored pattern of a path glob: **/ is any number of folders, ** anything, * and ? stay in a folder."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(meaning.get(p, re.escape(p)) for p in parts) + "$"


def not_globbed(findings: DataFrame, suppressed: dict[str, list[str]], path: str = "path") -> DataFrame:
    """Findings but those whose rule is suppressed on a glob that matches their path."""
    out = F.lit(False)
    for rule, globs in suppressed.items():
        for g in globs:
            out = out | ((F.col("rule") == rule) & F.col(path).rlike(glob_regex(g)))
    return findings.where(~out)


def surface(path: Column, prose: str, example: str) -> Column:
    """example, prose or source of a path; the two patterns are parameters, example wins."""
    return F.when(path.rlike(example), "example").when(path.rlike(prose), "prose").otherwise("source")


def single_valued(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of keys that have exactly one distinct value (a digest that can be trusted for a location)."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_max")).where(F.col(value) == F.col("_max")).drop("_max")
