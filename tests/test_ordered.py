"""Sequences of tokens: against a search by hand, and on lines made to be slow."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import families
from quarrylens.operators.ordered import Sequence
from quarrylens.operators.rules import Rule, line_hits


def by_hand(seq, text, first_line=False):
    """All chains, tried one after the other."""
    places = [[m.span() for m in re.finditer(t, text)] for t in seq.tokens]
    limit = text.find("\n") if first_line and "\n" in text else len(text)

    def go(k, end):
        if k == len(seq.tokens):
            return True
        for s, e in places[k]:
            if k == 0 and s < limit or k and 0 <= s - end <= seq.gap and not re.search(f"[{'' if seq.across else chr(10)}{seq.barriers}\x00]", text[end:s]):
                if go(k + 1, e):
                    return True
        return False

    return go(0, 0)


SEQUENCES = [Sequence(("a+b", "cd"), 6), Sequence(("x", "y", "z"), 4, ";"), Sequence(("x", "x", "y"), 5, "", True), Sequence((r"\bq\b", r"\|", r"\bq\b", "y|z"), 8, ";")]


@pytest.mark.parametrize("first_line", [False, True])
def test_equals_a_search_by_hand(spark, first_line):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["aab", "cd", "x", "y", "z", ";", " ", " ", "\n", "q", "|", "--"]) for _ in range(rng.randrange(25))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    rows = df.select("t", *(F.expr(s.found("t", first_line=first_line)).alias(f"s{k}") for k, s in enumerate(SEQUENCES))).collect()
    for r in rows:
        assert [r[f"s{k}"] for k in range(len(SEQUENCES))] == [by_hand(s, r["t"], first_line) for s in SEQUENCES], r["t"]
    assert all(any(r[f"s{k}"] for r in rows) for k in range(len(SEQUENCES)))


def test_what_a_sequence_may_not_be():
    for tokens in (("a",), ("a", "(b)"), ("a", "b*")):
        with pytest.raises(ValueError):
            Sequence(tokens)
    with pytest.raises(ValueError):
        Rule("R", "low", Sequence(("a", "b")), group=1)


#: What comes once, so that no token is missing, and what is repeated so that each rule nearly matches everywhere.
SLOW = {
    "GHA_CURL_DOWNLOAD_EXEC": ("sh\t", "curl -o && "), "SCRIPT_CURL_EXEC": ("sh;", "curl | "), "GHA_SECRET_CURL": ("${{ secrets.a }}" + " " * 300, "curl curl "), "EVAL_ATOB": ("atob(", "eval( "),
    "DOCKER_CURL_PIPE": ("sh;", "RUN curl | "), "BINARY_CURL_OUTPUT": (".exe;", "curl -o  "), "GHA_ENV_EXFIL": ("curl ", "env | "), "PROTESTWARE_GEO": ("rimraf ", "geoip "),
    "OBF_PROXY_TRAP": ("eval ", "new Proxy( "), "C2_DYNAMIC_CONFIG": ("fetch ", "JSON.parse( "),
}


@pytest.mark.parametrize("rule_id", SLOW)
def test_five_mebibytes_of_near_misses_take_seconds(spark, rule_id):
    (rule,) = (r for r in families.EVERY if r.id == rule_id)
    once, again = SLOW[rule_id]
    text = once + again * ((5 << 20) // len(again))
    path = ".github/workflows/a.yml" if rule_id.startswith("GHA_") else "Dockerfile" if rule_id.startswith("DOCKER") else "a.js"
    files = spark.createDataFrame([(path, text)], "path string, text string")
    assert files.select(rule.possible("text")).first()[0]
    began = time.time()
    assert line_hits(files, (rule,)).count() == 0
    assert time.time() - began < 15  # seconds on a busy machine; 2 to 5 otherwise


def test_every_rule_ends_on_long_lines(spark):
    text = "curl -o && | eval( atob( fetch( x; JSON.parse( " * 6000
    began = time.time()
    line_hits(spark.createDataFrame([("a.js", text)], "path string, text string"), families.EVERY).count()
    assert time.time() - began < 90


def test_scan_splits_only_files_that_a_rule_allows_and_shuffles_nothing(spark):
    files = spark.createDataFrame([("a.js", "x\neval(\natob(p))\n"), ("b.js", "clean"), ("n.js", None)], "path string, text string")
    rule = Rule("R", "low", Sequence((r"eval\(", r"atob\("), across=True), spans=3)
    hits = line_hits(files, (rule, Rule("S", "low", r"^clean$")))
    assert sorted((r["path"], r["line"], r["rule"]) for r in hits.collect()) == [("a.js", 2, "R"), ("b.js", 1, "S")]
    assert "Exchange" not in hits._jdf.queryExecution().toString()
