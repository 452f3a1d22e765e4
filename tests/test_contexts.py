"""Lexical contexts against a lexer that goes sign by sign through whole files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import contexts, disclosure

PATHS = {"c": "a.ts", "hash": "a.py", "markdown": "a.md", "plain": "a.bin"}


def by_hand(text, kind):
    """Context of each character, and the text without comments and insides of strings."""
    state, out, code = "0", [], []
    for line in text.split("\n"):
        i, states, kept = 0, [], []
        while i < len(line):
            m = re.compile(contexts.SIGNS[kind]).match(line, i) if kind != "plain" else None
            if m and kind == "markdown" and m[0].lstrip()[:1] in "`~" and len(m[0].strip()) == 3 and line[:i].strip():
                m = re.compile("`").match(line, i)
            sign = m[0] if m else line[i]
            was = state
            if m:
                if kind == "c":
                    state = {"0": {"/*": "1", "`": "2", "//": "#", '"': "d", "'": "s"}, "1": {"*/": "0"}, "2": {"`": "0"}, "d": {'"': "0"}, "s": {"'": "0"}}.get(state, {}).get(sign, state)
                elif kind == "hash":
                    state = {"0": {'"""': "1", "'''": "2", "#": "#", '"': "d", "'": "s"}, "1": {'"""': "0"}, "2": {"'''": "0"}, "d": {'"': "0"}, "s": {"'": "0"}}.get(state, {}).get(sign, state)
                else:
                    fence = len(sign.strip()) == 3
                    state = {"0": "1" if fence else "t", "1": "0" if fence else "1", "t": "t" if fence else "0"}[state]
            states += [was] * len(sign)
            comment = was == "#" or kind == "c" and was == "1" or was == "0" and (state == "#" or kind == "c" and state == "1")
            inside = not m and was in (("d", "s", "2") if kind == "c" else ("d", "s", "1", "2"))
            kept.append(" " * len(sign) if comment or inside else sign)
            i += len(sign)
        fenced = kind == "markdown" and re.match(r"\s*(?:```|~~~)", line)
        name = lambda s: "markdown_code" if kind == "markdown" and (fenced or s in "1t") else "plain" if kind in ("markdown", "plain") or s == "0" else "comment" if s == "#" or kind == "c" and s == "1" else "quoted"  # noqa: E731, B023
        out.append([name(s) for s in states])
        code.append("".join(kept))
        state = state if state in "012" else "0"
    return out, code


@pytest.mark.parametrize("kind", PATHS)
def test_equals_a_lexer_by_hand(spark, kind):
    rng = random.Random(3)
    signs = {"c": ["/*", "*/", "//", "`", '"', "'", "\\n", "a", " ", "x "], "hash": ['"""', "'''", "#", '"', "'", "\\t", "b", " "], "markdown": ["```", "~~~", "`", "c ", " "], "plain": ['"', "x"]}[kind]
    texts = ["\n".join("".join(rng.choice(signs) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(12))) for _ in range(150)]
    texts = [re.sub(r"/\*/", "/* ", t) for t in texts]
    files = spark.createDataFrame([(f"{k}/{PATHS[kind]}", t) for k, t in enumerate(texts)], "path string, text string").repartition(4)
    rows = contexts.lines(files)
    each = rows.select("path", "line", "content", F.explode(F.sequence(F.lit(1), F.greatest(F.length("content"), F.lit(1)))).alias("at"), "kind", "entry").where("length(content) > 0")
    got = {(r["path"], r["line"], r["at"]): r["c"] for r in each.select("path", "line", "at", contexts.context(F.col("content"), F.col("at"), F.col("kind"), F.col("entry")).alias("c")).collect()}
    for k, t in enumerate(texts):
        found, _ = by_hand(t, kind)
        for line, states in enumerate(found, 1):
            content = t.split("\n")[line - 1]
            for at, want in enumerate(states, 1):
                # a place inside a sign has no context of its own
                if kind == "plain" or not any(m.start() < at - 1 < m.end() for m in re.finditer(contexts.SIGNS[kind], content)):
                    assert got[f"{k}/{PATHS[kind]}", line, at] == want, (t, line, at)
    if kind in ("c", "hash"):
        code = {(r["path"], r["line"]): r["code"] for r in rows.select("path", "line", contexts.code_only(F.col("content"), F.col("entry"), kind, False).alias("code")).collect()}
        for k, t in enumerate(texts):
            for line, want in enumerate(by_hand(t, kind)[1], 1):
                assert code[f"{k}/{PATHS[kind]}", line] == want, t


def test_states_go_over_many_lines(spark):
    text = "/*\n" + "x\n" * 25_000 + "*/\ny"
    rows = contexts.lines(spark.createDataFrame([("a.c", text)], "path string, text string"))
    assert {(r["entry"], r["n"]) for r in rows.groupBy("entry").agg(F.count("*").alias("n")).collect()} == {("0", 2), ("1", 25_001)}
    assert "Exchange" not in rows._jdf.queryExecution().toString()


def test_caps_overlaps_and_second_values(spark):
    many = "\n".join(f"h = '10.0.0.{k % 250}'" for k in range(200))
    files = spark.createDataFrame([("a.js", many), ("b.js", "x = '8.8.8.8 10.1.1.1 and http://10.1.1.1/'"), ("examples/c.js", "'10.1.1.1'")], "path string, text string")
    got = disclosure.scan(files).collect()
    assert sum(r["path"] == "a.js" for r in got) == 25
    assert [(r["rule"], r["match"]) for r in got if r["path"] == "b.js"] == [("INTERNAL_PRIVATE_IP", "10.1.1.1")]
    assert not any(r["path"].startswith("examples") for r in got)
