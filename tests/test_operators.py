import pytest
from pyspark.sql import functions as F

from quarrylens.functions import scalars
from quarrylens.operators import lookups, rules, timeseries
from quarrylens.sources import manifests, sinks
from quarrylens.streaming import monitor


def one(df):
    return [tuple(r) for r in df.collect()]


def test_entropy_of_known_strings(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("abab",), (None,)], "t string").select(scalars.byte_entropy("t"))
    assert [r[0] for r in df.collect()] == [0.0, 0.0, 1.0, 0.0]


def test_rounding_of_negative_halves(spark):
    assert one(spark.sql("SELECT -2.5D AS x").select(scalars.round_half_up(F.col("x")))) == [(-2,)]


def test_ip_classes(spark):
    ips = ["127.0.0.1", "10.1.2.3", "172.32.0.1", "192.0.2.9", "8.8.8.8", "01.2.3.4", "256.1.1.1", "1.2.3"]
    df = spark.createDataFrame([(x,) for x in ips], "ip string").select(scalars.ipv4_class(F.col("ip")))
    assert [r[0] for r in df.collect()] == ["loopback", "private", "public", "documentation", "public", "invalid", "invalid", "invalid"]


def test_similar_names_find_swaps_and_edits(spark):
    df = spark.createDataFrame([("lodahs",), ("lodash",), ("lodas",), ("lodasch",), ("react",)], "name string")
    assert set(one(lookups.similar_names(df, ["lodash"]))) == {("lodahs", "lodash"), ("lodas", "lodash"), ("lodasch", "lodash")}
    assert ("lodahs", "lodash") in one(lookups.similar_pairs(df))


def test_first_indicator_position_wins(spark):
    deps = spark.createDataFrame([(1, "a", "2"), (2, "a", "3")], "id long, name string, version string")
    feed = spark.createDataFrame([(0, "a", "2"), (1, "a", None)], "pos long, name string, version string")
    assert sorted(one(lookups.first_indicator(deps, feed, ["id"]).select("id", "pos"))) == [(1, 0), (2, 1)]


def test_spanning_rule_and_limits(spark):
    files = spark.createDataFrame([("p", "a = 1\nb = 2\nc")], "path string, text string")
    assert one(rules.line_hits(files, (rules.Rule("R", "low", r"1\nb", spans=2),)).select("line", "rule")) == [(1, "R")]
    with pytest.raises(ValueError):
        rules.Rule("R", "low", "x", spans=21)


def test_files_over_five_mebibytes_are_scanned(spark):
    rows = [("big", "x\n" * (3 << 20) + "a@b.example"), ("small", "c@d.example"), ("none", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    assert sorted(one(rules.line_hits(files).select("path", "line"))) == [("big", (3 << 20) + 1), ("small", 1)]


def test_inline_directive_silences_the_next_line(spark):
    files = spark.createDataFrame([("p", "# ignore: CONTACT_EMAIL\na@b.example\nc@d.example")], "path string, text string")
    assert one(rules.not_suppressed(rules.line_hits(files), rules.lines(files)).select("line")) == [(3,)]


def test_baseline_treats_nulls_as_equal(spark):
    f = spark.createDataFrame([("R", None, 1), ("S", "x", 1)], "rule string, file string, line int")
    assert one(lookups.minus_baseline(f, f.where("rule = 'R'")).select("rule")) == [("S",)]


@pytest.mark.parametrize(("series", "direction", "spike"), [([20, 22, 18, 20, 65], "increasing", True), ([10, 20, 30], "increasing", False), ([30, 20, 10], "decreasing", False), ([20, 21, 20], "stable", False)])
def test_trend_series(spark, series, direction, spike):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(series)], "k string, i int, v int")
    last = timeseries.trend(df, "k", "i", "v").orderBy(F.desc("i")).first()
    assert (last["direction"], last["spike"]) == (direction, spike)


def test_npm_lock_and_findings(spark):
    text = '{"lockfileVersion": 3, "packages": {"": {}, "node_modules/@s/a": {"version": "1.0.0", "resolved": "http://x.example/a.tgz"}, "node_modules/a/node_modules/b": {"version": "2.0.0", "integrity": "md5-x", "dev": true}}}'
    deps = manifests.npm_lock(spark.createDataFrame([("l", text), ("bad", "{")], "path string, text string"))
    assert sorted(one(deps.select("name", "version", "scope"))) == [("@s/a", "1.0.0", "required"), ("b", "2.0.0", "excluded")]
    assert sorted(one(manifests.lockfile_findings(deps).select("name", "rule"))) == [("@s/a", "LOCKFILE_NO_INTEGRITY"), ("@s/a", "LOCKFILE_UNTRUSTED_URL"), ("b", "LOCKFILE_INTEGRITY_PREFIX")]


def test_block_lockfiles(spark):
    cargo = '[[package]]\nname = "a"\nversion = "1.0"\n\n[[package]]\nname = "b"\nversion = "2.0"\nchecksum = "c"\n'
    yarn = '# yarn lockfile v1\n\n"@s/a@^1.0":\n  version "1.2.0"\n  resolved "https://registry.yarnpkg.com/a.tgz"\n  integrity sha512-abc\n'
    mk = lambda t: spark.createDataFrame([("f", t)], "path string, text string")
    assert sorted(one(manifests.cargo_lock(mk(cargo)).select("name", "version", "integrity"))) == [("a", "1.0", None), ("b", "2.0", "c")]
    assert one(manifests.yarn_lock(mk(yarn)).select("name", "version", "integrity")) == [("@s/a", "1.2.0", "sha512-abc")]
    assert one(manifests.go_sum(mk("m.example/x v1.2.3 h1:aa=\nm.example/x v1.2.3/go.mod h1:bb=\n")).select("name", "version")) == [("m.example/x", "v1.2.3")]
    assert sorted(one(manifests.requirements(mk("a==1.0 # c\n-r x.txt\nb[z]>=2 ; python_version > '3'\n")).select("name", "version"))) == [("a", "==1.0"), ("b", ">=2")]
    assert one(manifests.package_json(mk('{"dependencies": {"a": "^1"}}')).select("name", "version", "kind")) == [("a", "^1", "dependencies")]


def test_csv_columns(spark):
    f = spark.createDataFrame([("R", "low", 0.5, "f", 1, "d")], "rule string, severity string, confidence double, file string, line int, description string")
    assert sinks.csv_rows(f).columns == ["rule", "severity", "confidence", "file", "description", "scan_status", "partial_scan"]
    assert '"startLine":1' in sinks.sarif_results(f).first()[0]


def test_stream_replay_counts_every_event_once(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitor.last_seen(stream).writeStream.outputMode("update").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT key, max(seen) AS n FROM seen GROUP BY key").toPandas().set_index("key")["n"].to_dict()
    assert got == src.groupBy("user_id").count().toPandas().set_index("user_id")["count"].to_dict()


def test_stream_windows_equal_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(src.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = monitor.tumbling(stream, width="1 day").writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    pick = lambda df: {(r["window_start"], r["event_type"]): r["n"] for r in df.collect()}
    assert pick(spark.table("tumbling")) == pick(monitor.tumbling(src, width="1 day"))


def test_windows_report_a_match_where_it_starts(spark):
    files = spark.createDataFrame([("f", "a\nb = 2\nc\nend")], "path string, text string")
    hit = lambda p, n: sorted(r["line"] for r in rules.line_hits(files, (rules.Rule("R", "low", p, spans=n),)).collect())
    assert hit("b = 2", 2) == [2] and hit("a.b", 2) == [1] and hit("b.*end", 3) == [2] and hit("b.*end", 2) == []


def test_globs():
    import re

    from quarrylens.operators.indicators import glob_regex

    match = lambda g, p: re.match(glob_regex(g), p) is not None
    assert match("src/**/a.js", "src/a.js") and match("src/**/a.js", "src/x/y/a.js") and match("**/a.js", "a.js")
    assert not match("src/*.js", "src/x/a.js") and match("src/**", "src/x/a.js") and not match("a.js", "ba.js") and not match("**/a.js", "ba.js")


def test_tree_looks_below_the_root_only(spark, tmp_path):
    from quarrylens.sources import tables

    for name in ("build/app/a.js", "build/app/node_modules/b.js", "build/app/dist/c.js", "build/app/.git/d"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r["rel"] for r in tables.tree(spark, str(tmp_path / "build/app")).select("rel").collect()) == ["a.js", "dist/c.js"]
    assert [r["rel"] for r in tables.tree(spark, str(tmp_path / "build/app"), max_depth=0).collect()] == ["a.js"]


def test_unreadable_documents_give_no_rows(spark):
    from quarrylens.sources import formats, workflows

    bad = spark.createDataFrame([("f", "{"), ("g", None)], "path string, text string")
    assert formats.npm_lock_v1(bad).count() == formats.bun_lock(bad).count() == formats.pyproject(bad).count() == 0
    assert workflows.steps(spark.createDataFrame([("f", "a: b\n   c: d")], "path string, text string")).where("ok").count() == 0


@pytest.mark.parametrize("span", [None, 1, 10, 1000])
def test_as_of_is_the_same_in_stretches(spark, span):
    from quarrylens.operators import assess

    points = spark.createDataFrame([("a", 1, 10), ("a", 25, 20), ("a", 26, None), ("b", 5, 50), (None, 1, 9), ("a", None, 8)], "k string, at int, v int")
    probes = spark.createDataFrame([("a", 0), ("a", 1), ("a", 24), ("a", 25), ("a", 25), ("a", 99), ("b", 4), ("b", 5), (None, 7), ("a", None)], "k string, at int")
    got = sorted(one(assess.as_of(probes, points, "k", "at", "v", span).select("k", "at", "v")), key=str)
    assert got == sorted([("a", 0, None), ("a", 1, 10), ("a", 24, 10), ("a", 25, 20), ("a", 25, 20), ("a", 99, 20), ("b", 4, None), ("b", 5, 50), (None, 7, None), ("a", None, None)], key=str)
    assert assess.as_of(probes.limit(0), points, "k", "at", "v", span).count() == 0


def test_forecasts_on_a_limit_are_exact(spark):
    """The newest value first; exact slopes 17/2, 81/10, 5 and 1/2, and none for one row or none but nulls."""
    series = {"a": [60, 47, 2, 10, 36], "b": [51, 48, 56, 59, 5], "c": [32, 41, 33, 11, 0, 26], "d": [10**9 + 1, None, 10**9], "e": [7], "f": [None, None]}
    rows = [(k, -i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, i int, v long")
    got = {r.k: (r.n, r.current, r.slope, r.ahead) for r in timeseries.forecast(df, "k", "i", "v").collect()}
    assert got["a"] == (5, 60, 8.5, 102.5) and got["b"] == (5, 51, 8.1, 91.5) and got["c"] == (6, 32, 5, 57)
    assert got["d"] == (3, 10**9 + 1, 0.5, 10**9 + 3.5)
    assert got["e"] == (1, 7, None, None) and got["f"] == (2, None, None, None)
    warned = {tuple(r) for r in timeseries.forecast_warnings(df, "k", "i", "v").collect()}
    assert warned == {("a", "crosses", 103), ("b", "crosses", 92)}
