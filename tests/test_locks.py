import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import indicators, triage
from quarrylens.sources import locks

UV = 'version = 1\n\n[[package]]\nname = "a"\nversion = "1.0"\nsdist = { url = "u", hash = "sha256:ab" }\n\n[[package]]\nname = "b"\nversion = "2.0"\n'
GEM = "GIT\n  remote: x\n  specs:\n    g (9)\n\nGEM\n  remote: https://r.example/\n  specs:\n    rack (2.0)\n      dep (>= 1)\n    puma (5.1)\n\nPLATFORMS\n  ruby\n"
PNPM = "lockfileVersion: '6.0'\n\nimporters:\n  x@1:\n\npackages:\n\n  /a@1.0.0:\n    resolution: {}\n\n  '@s/b@2.0.0(react@18.0.0)':\n    dev: true\n\n  /@s/c/3.0.0:\n    dev: true\n\nsettings:\n  z@1:\n"
COMPOSER = '{"packages": [{"name": "v/a", "version": "1.0", "dist": {"shasum": "ff"}}], "packages-dev": [{"name": "v/b", "version": "2.0"}]}'
NUGET = '{"version": 1, "dependencies": {"net6.0": {"A": {"resolved": "1.0", "contentHash": "h"}}, "net7.0": {"A": {"resolved": "1.0", "contentHash": "h"}}}}'
PIPFILE = '{"default": {"a": {"version": "==1.0", "hashes": ["sha256:x"]}}, "develop": {"b": {"version": "==2.0"}}}'
GOMOD = "module m.example/m\n\ngo 1.21\n\nrequire a.example/x v1.0.0\nrequire (\n\tb.example/y v2.0.0 // indirect\n)\nreplace (\n\tc.example/z v1.0.0 => d.example/z v1.0.1\n)\n"


@pytest.mark.parametrize(
    ("reader", "text", "want"),
    [
        (locks.uv_lock, UV, [("a", "1.0", "sha256:ab"), ("b", "2.0", None)]),
        (locks.gemfile_lock, GEM, [("puma", "5.1", None), ("rack", "2.0", None)]),
        (locks.pnpm_lock, PNPM, [("@s/b", "2.0.0", None), ("@s/c", "3.0.0", None), ("a", "1.0.0", None)]),
        (locks.composer_lock, COMPOSER, [("v/a", "1.0", "ff"), ("v/b", "2.0", None)]),
        (locks.nuget_lock, NUGET, [("A", "1.0", "h")]),
        (locks.pipfile_lock, PIPFILE, [("a", "1.0", "sha256:x"), ("b", "2.0", None)]),
        (locks.go_mod, GOMOD, [("a.example/x", "v1.0.0", None), ("b.example/y", "v2.0.0", None)]),
    ],
)
def test_lockfiles(spark, reader, text, want):
    df = spark.createDataFrame([("f", text), ("empty", ""), ("none", None), ("odd", "{[")], "path string, text string")
    assert sorted(tuple(r) for r in reader(df).select("name", "version", "integrity").collect()) == want


def test_integrity_uses_the_strongest_digest(spark):
    sri = lambda name, body: f"{name}-" + base64.b64encode(hashlib.new(name, body).digest()).decode()
    rows = [(b"x", sri("sha512", b"x")), (b"x", sri("sha256", b"x") + " " + sri("sha512", b"y")), (b"x", "md5-abc"), (b"x", sri("sha384", b"x") + "?opt")]
    df = spark.createDataFrame(rows, "content binary, integrity string").select(locks.integrity_ok(F.col("content"), F.col("integrity")))
    assert [r[0] for r in df.collect()] == [True, False, None, True]


def test_artifact_selectors(spark):
    rows = [("dist-*", "dist-linux"), ("dist-*", "docs"), ("*-linux", "dist-*"), ("a*", "b*"), ("x", "x"), ("ab*ba", "aba")]
    df = spark.createDataFrame(rows, "a string, b string").select(locks.selectors_overlap(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == [True, False, True, False, True, False]


def test_globs():
    import re

    match = lambda g, p: bool(re.match(indicators.glob_regex(g), p))
    assert match("src/**", "src/a/b.js") and match("src/*.js", "src/a.js") and match("?.md", "a.md")
    assert not match("src/*.js", "src/a/b.js") and not match("a.md", "abmd") and not match("?.md", "/.md")


def test_indicators_match_parent_domains_but_not_parts_of_words(spark):
    lines = spark.createDataFrame([("p", 1, "see X.Evil.example, notevil.example and evil.example.org"), ("p", 2, None)], "path string, line int, content string")
    known = spark.createDataFrame([("EVIL.example",), ("evil.example",)], "value string")
    assert [tuple(r) for r in indicators.indicator_hits(lines, known).collect()] == [("p", 1, "evil.example")]


def test_volatility_ignores_zero_steps(spark):
    rows = [("up", i, 10 * i) for i in range(6)] + [("zigzag", i, v) for i, v in enumerate([10, 60, 60, 5, 70])] + [("one", 0, 5)]
    got = {r["k"]: r for r in triage.volatility(spark.createDataFrame(rows, "k string, i int, v int"), "k", "i", "v").collect()}
    assert (got["up"]["reversals"], got["up"]["volatile"], got["one"]["volatile"]) == (0, False, False)
    assert (got["zigzag"]["reversals"], got["zigzag"]["volatile"]) == (2, True)


def test_triage_states(spark):
    rows = [("accepted", "1998-01-01", "1998-06-01"), ("accepted", "1998-01-01", "1999-06-01"), ("new", "1998-11-01", None), ("new", "1998-12-20", None), ("resolved", "1990-01-01", "1991-01-01")]
    df = spark.createDataFrame(rows, "s string, a string, b string").select("s", F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    got = df.select(triage.triage_state(F.col("s"), F.col("a"), F.col("b"), "1999-01-01")).collect()
    assert [r[0] for r in got] == ["expired", "ok", "stale", "ok", "ok"]
