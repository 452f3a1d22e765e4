"""Workflows as people write them, and regions by indentation against a stack of open keys."""

import random
import re

import pytest

from quarrylens.sources.workflows import read_yaml, regions, rule_hits, steps

FORMS = [
    ("a:\n-   name: x\n    run: y\n-   name: z\n", {"a": [{"name": "x", "run": "y"}, {"name": "z"}]}),
    ("on:\n  push:\n    branches: [main,\n      dev,\n      'rel/**']\n", {"on": {"push": {"branches": ["main", "dev", "rel/**"]}}}),
    ("if: github.ref == 'x' &&\n  github.actor != 'y'\nb: 1\n", {"if": "github.ref == 'x' && github.actor != 'y'", "b": "1"}),
    ("x: &base\n  env: {A: 1}\ny: *base\nz:\n  <<: *base\n  b: 2\n", {"x": {"env": {"A": "1"}}, "y": {"env": {"A": "1"}}, "z": {"env": {"A": "1"}, "b": "2"}}),
    ('uses: "a@v4" # pin\nname: \'it\'\'s\' # c\n', {"uses": "a@v4", "name": "it's"}),
    ("on: {push: {branches: [main, dev]}, workflow_dispatch: }\n", {"on": {"push": {"branches": ["main", "dev"]}, "workflow_dispatch": None}}),
    ("on: [push, pull_request]\nrun: |\n  echo a: b\n\n  # kept\nlast: >-\n  a\n  b\n", {"on": ["push", "pull_request"], "run": "echo a: b\n\n# kept", "last": "a b"}),
    ('"on": push\n? x\n', None),
    ("a: b\n   c: d\n", None),
    ("a: [1, 2\nb: 3\n", None),
    ("- - a\n  - b\n- c\n", [["a", "b"], "c"]),
    ("a:\n  - b: 1\n    c:\n    - d\n  -\n    e: f\n", {"a": [{"b": "1", "c": ["d"]}, {"e": "f"}]}),
    ("a: 'x: y'\nb: http://x.test:80/#z\nc: \"q\\n\\\"\"\n", {"a": "x: y", "b": "http://x.test:80/#z", "c": 'q\n"'}),
    ("", {}),
    ("# only\n---\n", {}),
    ("a: {b: [x, {c: d}], 'e f': \"g, h\"}\n", {"a": {"b": ["x", {"c": "d"}], "e f": "g, h"}}),
    ("a: ${{ x }}\nb: !ref c\nd:\n", {"a": "${{ x }}", "b": "c", "d": None}),
]


@pytest.mark.parametrize(("text", "want"), FORMS)
def test_forms(text, want):
    if want is None:
        with pytest.raises(Exception):  # noqa: B017
            read_yaml(text)
    else:
        assert read_yaml(text) == want


def test_steps_of_a_workflow_with_many_forms(spark):
    text = "on: {push: {branches: [main, dev]}}\njobs:\n  b:\n    needs: [a,\n      c]\n    steps:\n    -   uses: \"x/y@v1\" # pin\n    -   name: n\n        run: make\n          all\n"
    rows = steps(spark.createDataFrame([("a.yml", text)], "path string, text string")).orderBy("idx").collect()
    assert rows[0]["ok"] and rows[0]["triggers"] == ["push"]
    assert [(r["uses"], r["run"], r["needs"]) for r in rows[1:]] == [("x/y@v1", None, ["a", "c"]), (None, "make all", ["a", "c"])]


def by_stack(text):
    out, stack = {}, []
    for n, raw in enumerate(text.split("\n"), 1):
        if not raw.strip():
            continue
        indent = len(raw) - len(raw.lstrip(" "))
        while stack and indent <= stack[-1][1]:
            stack.pop()
        inside = [r for r, _ in stack]
        if "exec" in inside:
            out[n] = "exec"
            continue
        out[n] = "env" if "env" in inside else "other"
        m = re.match(r"^\s*((?:-\s+)*)([\w-]+)\s*:(?:\s+(.*))?$", re.sub(r"(?:^|\s+)#.*$", "", raw))
        if m:
            column, value = indent + len(m[1]), (m[3] or "").strip()
            if m[2] in ("run", "script"):
                if value and not re.match(r"^[|>][0-9+-]*$", value):
                    out[n] = "exec"
                stack.append(("exec", column))
            elif m[2] == "env":
                if value:
                    out[n] = "env"
                else:
                    stack.append(("env", column))
    return out


def test_regions_equal_a_stack(spark):
    rng = random.Random(6)
    keys = ["run: |", "run: x", "env:", "env: {A: 1}", "- run: |", "- name: n", "with:", "script: >-", "A: 1", "text", "", "- env:", "# c"]
    texts = ["\n".join(" " * rng.randrange(0, 9, 2) + rng.choice(keys) for _ in range(rng.randrange(1, 25))) for _ in range(120)]
    rows = regions(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")).collect()
    got = {(r["path"], r["line"]): r["region"] for r in rows}
    assert got == {(str(k), n): r for k, t in enumerate(texts) for n, r in by_stack(t).items()}


def test_only_what_is_run_counts(spark):
    text = "jobs:\n  b:\n    steps:\n    - env:\n        X: curl a | sh\n      name: curl a | sh\n      run: |\n        curl a | sh\n    permissions:\n      id-token: write\n"
    hits = rule_hits(spark.createDataFrame([(".github/workflows/a.yml", text)], "path string, text string"))
    assert sorted((r["line"], r["rule"]) for r in hits.collect()) == [(8, "GHA_CURL_PIPE_EXEC"), (10, "GHA_OIDC_WRITE_PERM")]
