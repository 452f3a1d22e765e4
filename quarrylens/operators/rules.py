"""Declarative text rules, compiled to Catalyst columns.

A registry of rules becomes one choice by number: a file carries the numbers of the
rules that its path and text allow, its lines are tried by these in one pass, and a
line without a hit yields no row. Guards on the path are evaluated once a file.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.operators.ordered import Sequence, quoted


@dataclass(frozen=True)
class Rule:
    """A line pattern, or a sequence of tokens (or several, one of which is found), with guards.

    ``spans`` > 1 matches that many lines joined by a newline; a match belongs to
    the line where it starts, and a dot matches the newline too. ``accept`` is a
    condition on the value of ``group``; ``exempt`` is a pattern of lines that the
    rule skips; ``flags`` are inline flags such as ``i``.
    """

    id: str
    severity: str
    pattern: str | Sequence | tuple[Sequence, ...]
    confidence: float = 0.8
    only_path: str | None = None
    not_path: str | None = None
    requires: str | None = None
    spans: int = 1
    flags: str = ""
    group: int = 0
    accept: Callable[[Column], Column] | None = None
    exempt: str | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.spans <= 20:
            raise ValueError(f"{self.id}: a rule spans 1 to 20 lines")
        if not self.id or not self.pattern:
            raise ValueError("a rule has an id and a pattern")
        if self.sequences:
            if self.accept is not None or self.group:
                raise ValueError(f"{self.id}: a sequence has no groups")
            return
        try:
            re.compile(self.pattern)
        except re.error as e:
            raise ValueError(f"{self.id}: {e}") from e

    @property
    def sequences(self) -> tuple[Sequence, ...]:
        return (self.pattern,) if isinstance(self.pattern, Sequence) else self.pattern if isinstance(self.pattern, tuple) else ()

    @property
    def regex(self) -> str:
        flags = self.flags + ("s" if self.spans > 1 else "")
        head = f"(?{flags})" if flags else ""
        return head + (rf"\A[^\n]*?(?:{self.pattern})" if self.spans > 1 else self.pattern)

    def _exempt(self, content: str) -> str:
        return f" AND NOT {content} RLIKE {quoted(self.exempt)}" if self.exempt else ""

    def hits(self, content: str) -> Column:
        """Whether a line (or, with ``spans``, so many lines joined), a column, is a hit."""
        if self.accept is not None:
            return F.exists(self._values(content), self.accept) & F.expr("true" + self._exempt(content))
        own = " OR ".join(x.found(content, self.flags, self.spans > 1) for x in self.sequences) or f"{content} RLIKE {quoted(self.regex)}"
        return F.expr(f"({own})" + self._exempt(content))

    def _values(self, content: str) -> Column:
        return F.regexp_extract_all(content, F.lit(self.regex), F.lit(self.group))

    def value(self, content: str) -> Column:
        """What ``group`` holds in the first match that is accepted."""
        values = self._values(content)
        return F.get(F.filter(values, self.accept) if self.accept is not None else values, F.lit(0))

    def possible(self, text: str) -> Column:
        """Whether a file, by its column of text, can hold a hit: true wherever a line hits."""
        if self.sequences:
            return F.expr(" OR ".join(x.possible(text, self.flags) for x in self.sequences))
        if re.search(r"\\[AzZG]", self.pattern):
            return F.lit(True)
        return F.expr(f"{text} RLIKE {quoted(f"(?m{self.flags}{'s' if self.spans > 1 else ''}){self.pattern}")}")

    def finding(self) -> str:
        return f"named_struct('rule', {quoted(self.id)}, 'severity', {quoted(self.severity)}, 'confidence', {float(self.confidence)}D)"


def validated(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """The rules, if no two have the same id."""
    ids = [r.id for r in rules]
    if again := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"ids of several rules: {', '.join(again)}")
    return rules


DEFAULT = (
    Rule("ADDRESS_IPV4", "medium", r"(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}([^0-9.]|$)", 0.7),
    Rule("CONTACT_EMAIL", "low", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", 0.6),
    Rule("SECRET_TOKEN_ASSIGNED", "critical", r'(token|key|secret|password) *= *"[0-9a-f]{40}"', 0.9),
    Rule("LICENSE_NOTICE", "info", r"Licensed under the ", 0.9),
)


def lines(files: DataFrame) -> DataFrame:
    """files(path, text) -> path, line (from 1), content."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("i", "content")).select("path", (F.col("i") + 1).alias("line"), "content")


def guard(rule: Rule, path: str = "path", text: str | None = None) -> str:
    """The rule's conditions on a file, as SQL over its columns."""
    out = ["true"]
    if rule.only_path:
        out.append(f"{path} RLIKE {quoted(rule.only_path)}")
    if rule.not_path:
        out.append(f"NOT {path} RLIKE {quoted(rule.not_path)}")
    if rule.requires and text is not None:
        out.append(f"{text} RLIKE {quoted(rule.requires)}")
    return " AND ".join(out)


def _chosen(k: Column, conditions: list[Column], first: int = 0) -> Column:
    """The condition that the number k names, found by halves: few comparisons, and no other condition is evaluated."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return F.when(k < first + half, _chosen(k, conditions[:half], first)).otherwise(_chosen(k, conditions[half:], first + half))


def _allowed(rules: tuple[Rule, ...], scope: Callable[[Rule], str] | None) -> Column:
    """The numbers of the rules that a file's path and whole text allow; a condition on the path is tried once for all rules that have it."""
    alike: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        alike.setdefault(f"({scope(r)}) AND {guard(r)}" if scope else guard(r), []).append(k)
    none = F.array().cast("array<int>")
    tried = F.flatten(F.array(*(F.when(F.expr(condition), F.array(*map(F.lit, own))).otherwise(none) for condition, own in alike.items())))
    possible = [r.possible("text") & F.expr(f"text RLIKE {quoted(r.requires)}") if r.requires else r.possible("text") for r in rules]
    return F.filter(tried, lambda k: _chosen(k, possible))


def able(files: DataFrame, rules: tuple[Rule, ...] = DEFAULT, scope: Callable[[Rule], str] | None = None) -> DataFrame:
    """The files whose path and whole text allow a hit of some rule."""
    return files.where(F.size(_allowed(rules, scope)) > 0)


def line_hits(files: DataFrame, rules: tuple[Rule, ...] = DEFAULT, scope: Callable[[Rule], str] | None = None) -> DataFrame:
    """path, line, content, rule, severity, confidence of each rule that hits a line, in files of any size.

    A rule is tried on the lines of those files only whose path and whole text allow
    it (and its ``scope``, a condition on the columns of files as SQL); a file that
    allows none isn't split. A file carries the numbers of its own rules, so a line costs
    these and not the registry. Spans of lines are cut from the file's own row, so
    nothing is shuffled.
    """
    guarded = files.select("path", "text", _allowed(rules, scope).alias("allowed"))
    widths = {w: [k for k, r in enumerate(rules) if r.spans == w] for w in sorted({r.spans for r in rules if r.spans > 1})}
    wanted = [F.arrays_overlap("allowed", F.array(*map(F.lit, own))).alias(f"wants{w}") for w, own in widths.items()]
    # not a filter, which Spark would move below the list and evaluate it twice
    split = guarded.select("path", "allowed", F.when(F.size("allowed") > 0, F.split("text", "\n")).alias("lines"), *wanted)

    def entry(x: Column, i: Column) -> Column:
        return F.struct(x.alias("content"), *(F.when(F.col(f"wants{w}"), F.array_join(F.slice("lines", i + 1, w), "\n")).alias(f"span{w}") for w in widths))

    each = split.select("path", "allowed", F.posexplode(F.transform("lines", entry)).alias("i", "x")).select("path", "allowed", "i", "x.*")
    hits = [r.hits("content" if r.spans == 1 else f"span{r.spans}") for r in rules]
    # the outer form, as Spark would evaluate all rules once more to leave out lines without a hit before a plain explode
    found = each.select("path", (F.col("i") + 1).alias("line"), "content", F.explode_outer(F.filter("allowed", lambda k: _chosen(k, hits))).alias("k")).where("k IS NOT NULL")
    known = F.expr(f"element_at(array({', '.join(r.finding() for r in rules)}), k + 1)")
    return found.select("path", "line", "content", known.alias("h")).select("path", "line", "content", "h.rule", "h.severity", "h.confidence")


def first_hits(hits: DataFrame) -> DataFrame:
    """path, rule, line of the first hit of each rule in each file."""
    return hits.groupBy("path", "rule").agg(F.min("line").alias("line"))


def capped(hits: DataFrame, per_rule: int = 25, per_file: int = 100) -> DataFrame:
    """At most per_rule findings of a rule in a file, then the most severe per_file - 1 of a file."""
    from quarrylens.functions.scalars import severity_rank

    by_rule = hits.withColumn("rn", F.row_number().over(Window.partitionBy("path", "rule").orderBy("line"))).where(F.col("rn") <= per_rule).drop("rn")
    order = Window.partitionBy("path").orderBy(severity_rank(F.col("severity")).desc(), "line", "rule")
    return by_rule.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_file - 1).drop("rn")


def not_suppressed(hits: DataFrame, all_lines: DataFrame, marker: str = "ignore:") -> DataFrame:
    """Hits without a directive (# or //, marker, rule id) on the line above."""
    above = all_lines.select("path", (F.col("line") + 1).alias("line"), F.regexp_extract("content", rf"(?:#|//) *{marker} *([A-Z0-9_]+)", 1).alias("rule")).where("rule <> ''")
    return hits.join(above, ["path", "line", "rule"], "left_anti")
