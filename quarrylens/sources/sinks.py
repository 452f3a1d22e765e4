"""Report formats as one text column of a DataFrame; write them with df.write.text or .csv."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.scalars import severity_rank


def json_rows(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct("*")).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object a row."""
    level = F.when(severity_rank(F.col("severity")) >= 3, "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    region = F.struct(F.greatest(F.lit(1), F.coalesce("line", F.lit(1))).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def csv_rows(findings: DataFrame, partial: bool = False) -> DataFrame:
    """rule, severity, confidence, file, description, scan_status, partial_scan."""
    return findings.select("rule", "severity", "confidence", "file", "description", F.lit("partial" if partial else "complete").alias("scan_status"), F.lit(partial).alias("partial_scan"))


def osv_records(packages: DataFrame, prefix: str = "QL") -> DataFrame:
    """id, name, ecosystem, version: one record for each id; the id is a slug and eight digits of a hash."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 48)
    tail = F.substring(F.sha2(F.concat(F.col("ecosystem"), F.lit(":"), F.col("name"), F.lit("@"), F.coalesce("version", F.lit("*"))), 256), 1, 8)
    rows = packages.select(F.upper(F.concat_ws("-", F.lit(prefix), slug, tail)).alias("id"), "name", "ecosystem", "version")
    return rows.groupBy("id").agg(F.min("name").alias("name"), F.min("ecosystem").alias("ecosystem"), F.min("version").alias("version"))


def sbom_components(deps: DataFrame) -> DataFrame:
    """name, version, purl: the first scope (by pos) of each name and version."""
    purl = F.concat(F.lit("pkg:"), F.col("ecosystem"), F.lit("/"), F.regexp_replace(F.col("name"), " ", "%20"), F.lit("@"), F.col("version"))
    return deps.groupBy("ecosystem", "name", "version").agg(F.min_by("scope", "pos").alias("scope")).select("name", "version", "scope", purl.alias("purl"))
