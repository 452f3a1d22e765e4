"""Reachability over long chains and cycles, ranges that overlap, and data flow that a chain of hundreds of names carries."""

import random

from pyspark.sql import functions as F

from quarrylens.operators import assess, fixpoint, flow, lookups


def test_closure_of_cycles_and_long_chains(spark):
    edges = [(1, 2), (2, 1), (2, 3)] + [(k, k + 1) for k in range(100, 260)] + [(None, 1)]
    got = {(r["a"], r["b"]): r["depth"] for r in lookups.closure(spark, spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got[1, 1] == 2 and got[1, 3] == 2 and got[2, 3] == 1
    assert got[100, 260] == 160 and len(got) == 6 + 160 * 161 // 2


def test_reached_equals_a_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(k, k + 1) for k in range(1000, 1400)]
    seeds = [3, 17, 1000]
    want = {}
    for s in sorted(seeds, reverse=True):
        left, seen = [s], set()
        while left:
            n = left.pop()
            if n not in seen:
                seen.add(n)
                left += [b for a, b in edges if a == n]
        want |= dict.fromkeys(seen, s)
    got = fixpoint.reached(spark.createDataFrame([(s,) for s in seeds], "key long"), spark.createDataFrame(edges, "source long, target long").distinct())
    assert {r["key"]: r["origin"] for r in got.collect()} == want
    assert fixpoint.reached(spark.createDataFrame([], "key long"), spark.createDataFrame(edges, "source long, target long")).count() == 0


def test_overlapping_ranges(spark):
    rng = random.Random(4)
    ranges = [(k, s, s + rng.randrange(-2, 9)) for k in "ab" for s in (rng.randrange(40) for _ in range(12))]
    events = [(k, at) for k in "abc" for at in range(45)]
    df = assess.within(spark.createDataFrame(events, "k string, at long"), spark.createDataFrame(ranges, "k string, start long, stop long"), "k", "at")
    want = {(k, at) for k, at in events if any(k == x and s <= at <= e for x, s, e in ranges)}
    assert {(r["k"], r["at"]) for r in df.collect()} == want and want


def test_a_long_alias_chain_and_clean_files(spark):
    chain = "\n".join(["const a0 = process.env.NPM_TOKEN;", *(f"const a{k} = a{k - 1};" for k in range(1, 300)), "fetch(a299);"])
    files = spark.createDataFrame([("a.js", chain), ("b.js", "fetch(x)"), ("c.js", None), ("d.txt", chain)], "path string, text string")
    assert [tuple(r) for r in flow.credential_flow(files).collect()] == [("a.js", 1, 301)]
    assert flow.credential_flow(files.limit(0)).count() == 0


def test_code_and_strings_are_told_apart(spark):
    text = "const t = 'process.env.NPM_TOKEN'; // fetch(t)\nconst s = `${process.env.NPM_TOKEN}`;\nfetch('t', s)"
    files = spark.createDataFrame([("a.ts", text)], "path string, text string")
    rows = flow.pieces(files).orderBy("at").select(F.trim("bare").alias("bare")).collect()
    assert rows[0]["bare"].replace(" ", "") == "constt='';"
    assert [r["sink_line"] for r in flow.credential_flow(files).collect()] == [3]
