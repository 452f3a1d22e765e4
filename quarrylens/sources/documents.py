"""Report documents: one text a target, made of its findings (target, seq, rule, severity, file, line, description)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions.scalars import severity_rank
from quarrylens.operators.assess import markdown_cell, xml_text


def _ordered(row: Column, key: str = "seq") -> Column:
    """The rows of a target in order, as one array; a target's findings are what one report holds."""
    return F.transform(F.sort_array(F.collect_list(F.struct(key, row.alias("v")))), lambda x: x["v"])


def sarif(findings: DataFrame) -> DataFrame:
    """target, document: a SARIF run with its rules, in order of their first appearance, and results that point to them."""
    first = findings.groupBy("target", "rule").agg(F.min("seq").alias("at"))
    rules = first.groupBy("target").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "rule"))), lambda x: x["rule"]).alias("rules"))
    rank = severity_rank(F.col("severity"))
    result = F.struct(F.col("rule").alias("ruleId"), F.when(rank >= 3, "error").when(rank == 2, "warning").otherwise("note").alias("level"), F.struct(F.col("description").alias("text")).alias("message"))
    results = findings.groupBy("target").agg(_ordered(result).alias("results"))
    indexed = F.transform("results", lambda r: F.struct(r["ruleId"].alias("ruleId"), (F.array_position(F.col("rules"), r["ruleId"]) - 1).alias("ruleIndex"), r["level"].alias("level"), r["message"].alias("message")))
    run = F.struct(F.struct(F.struct(F.lit("quarrylens").alias("name"), F.transform("rules", lambda x: F.struct(x.alias("id"))).alias("rules")).alias("driver")).alias("tool"), indexed.alias("results"))
    return rules.join(results, "target").select("target", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


#: Results of one row at most; a target with more has several rows, numbered by ``page``.
PAGE = 50_000


def sarif_located(findings: DataFrame, suppressed: Column | None = None, page: int = PAGE) -> DataFrame:
    """target, page, results: the SARIF results of a target with their places, suppressed ones left out, in pages of bounded size."""
    shown = findings if suppressed is None else findings.where(~F.coalesce(suppressed, F.lit(False)))
    rank = severity_rank(F.col("severity"))
    region = F.struct(F.greatest(F.lit(1), F.coalesce("line", F.lit(1))).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    level = F.when(rank >= 3, "error").when(rank == 2, "warning").otherwise("note")
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"))
    numbered = shown.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("target").orderBy("seq")) - 1) / page))
    return numbered.groupBy("target", "page").agg(F.to_json(_ordered(result)).alias("results"))


def markdown(findings: DataFrame) -> DataFrame:
    row = F.concat(F.lit("| "), F.col("severity"), F.lit(" | "), F.col("rule"), F.lit(" | "), markdown_cell(F.col("description")), F.lit(" |"))
    head = "# Findings\n\n| Severity | Rule | Description |\n|---|---|---|\n"
    return findings.groupBy("target").agg(F.concat(F.lit(head), F.array_join(_ordered(row), "\n"), F.lit("\n")).alias("document"))


def html(findings: DataFrame) -> DataFrame:
    row = F.concat(F.lit("<tr><td>"), F.col("severity"), F.lit("</td><td>"), xml_text(F.col("rule")), F.lit("</td><td>"), xml_text(F.col("description")), F.lit("</td></tr>"))
    return findings.groupBy("target").agg(F.concat(F.lit("<table>"), F.array_join(_ordered(row), ""), F.lit("</table>")).alias("document"))


def junit(findings: DataFrame) -> DataFrame:
    """One test case a rule, which fails on a critical or high finding."""
    per = findings.groupBy("target", "rule").agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    case = F.concat(F.lit('<testcase name="'), xml_text(F.col("rule")), F.when(F.col("worst") >= 3, '"><failure/></testcase>').otherwise('"/>'))
    counts = (F.count("*").cast("string"), F.count_if(F.col("worst") >= 3).cast("string"))
    suite = F.concat(F.lit('<testsuite tests="'), counts[0], F.lit('" failures="'), counts[1], F.lit('">'), F.array_join(_ordered(case, "rule"), ""), F.lit("</testsuite>"))
    return per.groupBy("target").agg(suite.alias("document"))


def badge(scores: DataFrame) -> DataFrame:
    """target, document: an endpoint badge of a score (target, score, level)."""
    color = F.when(F.col("level") == "clean", "brightgreen").when(F.col("level") == "low", "green").when(F.col("level") == "medium", "yellow").when(F.col("level") == "high", "orange").otherwise("red")
    message = F.concat(F.col("score").cast("string"), F.lit("/100"))
    return scores.select("target", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit("supply chain").alias("label"), message.alias("message"), color.alias("color"))).alias("document"))


def cyclonedx(components: DataFrame) -> DataFrame:
    """target, document: an inventory of components (target, name, version, purl)."""
    item = F.struct(F.lit("library").alias("type"), "name", "version", "purl")
    listed = components.groupBy("target").agg(F.sort_array(F.collect_list(item)).alias("components"))
    return listed.select("target", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), "components")).alias("document"))


def mermaid(edges: DataFrame) -> DataFrame:
    """target, document: a flow chart of edges (target, src, dst, type)."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    line = F.concat(F.lit("  "), clean("src"), F.lit(" -->|"), F.col("type"), F.lit("| "), clean("dst"))
    return edges.groupBy("target").agg(F.concat(F.lit("graph TD\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("document"))


FORMATS = {"sarif": sarif, "markdown": markdown, "html": html, "junit": junit}


def document(findings: DataFrame, kind: str) -> DataFrame:
    """target, document in the format of that name."""
    return FORMATS[kind](findings)
