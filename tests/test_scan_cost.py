"""What a scan must not do twice, or in one task, however few files its table has."""

import re

from quarrylens.operators import analytics, rules, scan
from quarrylens.plans import catalog_families, catalog_scan

SF = "/root/testdata/sf0.001"


def test_repositories_are_spread(spark):
    """a table of one row group doesn't leave the whole scan to one task."""
    cores = spark.sparkContext.defaultParallelism
    assert catalog_scan.repositories(spark, SF).rdd.getNumPartitions() >= cores


def test_samples_are_spread(spark):
    """F3."""
    cores = spark.sparkContext.defaultParallelism
    assert catalog_families.sample_files(spark, SF, catalog_families.SAMPLES["file"]).rdd.getNumPartitions() >= cores


def test_a_file_is_tried_once(spark):
    """whether a rule can hit a file is asked once, and a condition on paths once for all its rules."""
    files = spark.createDataFrame([("a.js", "eval(1)\nx"), ("b.js", "y"), (None, "eval(1)"), ("c.js", None)] * 2, "path string, text string")
    own = (rules.Rule("A", "low", r"\beval\("), rules.Rule("B", "high", r"\bnever\("), rules.Rule("C", "info", r"1\)\nx", spans=2))
    hits = rules.line_hits(files, own, scope=lambda r: "path RLIKE '[.]js$'")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("never") == 2  # the file, then the line
    assert plan.count("[.]js$") == 1
    assert sorted(tuple(r) for r in hits.select("path", "line", "rule", "severity").collect()) == [("a.js", 1, "A", "low")] * 2 + [("a.js", 1, "C", "info")] * 2


def test_report_sums_findings_in_one_pass(spark):
    """the findings, which are all detectors, are read once."""
    found = spark.createDataFrame([("t/a", "R", "low"), ("t/b", "R", "high"), ("t/b", "S", "critical"), ("u/a", "R", "info")], "path string, rule string, severity string")
    none = spark.createDataFrame([], "path string, state string, detail string")
    targets = spark.createDataFrame([("t",), ("u",), ("v",)], "target string")
    out = scan.report(found, none, targets)
    assert len(re.findall(r"LogicalRDD \[path#\d+, rule#\d+", out._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert sorted(map(tuple, out.collect())) == [("t", 40, 3, "critical", False), ("u", 1, 1, "info", False), ("v", 0, 0, "none", False)]
    summed = analytics.summary_by_target(found.selectExpr("substring_index(path, '/', 1) AS target", "rule", "severity"))
    assert sorted(map(tuple, summed.collect())) == [("t", 40, 3, "critical"), ("u", 1, 1, "info")]
