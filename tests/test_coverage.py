"""Damaged, encrypted, nested and odd files: each costs its own row and no other."""

import io
import json
import struct
import tarfile
import zipfile

import pytest

from quarrylens.sources import coverage, formats, workflows


def zip_of(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return bytearray(b.getvalue())


def patched(raw, field, value):
    """All local (offset 6 or 8) and central (8 or 10) headers with a new flag or method."""
    out = bytearray(raw)
    for sign, at in ((b"PK\x03\x04", {"flag": 6, "method": 8}[field]), (b"PK\x01\x02", {"flag": 8, "method": 10}[field])):
        k = out.find(sign)
        while k >= 0:
            out[k + at : k + at + 2] = struct.pack("<H", value)
            k = out.find(sign, k + 4)
    return bytes(out)


def archives():
    whole = zip_of(a="x" * 5000, b="y" * 5000)
    broken = bytearray(whole)
    at = broken.find(b"PK\x03\x04") + 31
    broken[at : at + 8] = b"\xff" * 8
    tgz = io.BytesIO()
    with tarfile.open(fileobj=tgz, mode="w:gz") as t:
        info = tarfile.TarInfo("f")
        info.size = 100_000
        t.addfile(info, io.BytesIO(bytes(range(256)) * 391))
    return {
        "good": bytes(whole), "stream": bytes(broken), "locked": patched(whole, "flag", 1), "method": patched(whole, "method", 77),
        "cut": bytes(whole[:60]), "cut.tgz": tgz.getvalue()[:300], "empty": b"", "none": None, "noise": b"\x00\x01" * 600,
    }


def test_no_archive_ends_the_job(spark):
    files = spark.createDataFrame([*archives().items()], "path string, content binary").repartition(2)
    rows = formats.members(files).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"], []).append((r["member"], r["problem"] and r["problem"].split(":")[0]))
    assert sorted(by["good"]) == [("a", None), ("b", None)]
    assert sorted(by["stream"]) == [("a", "unreadable"), ("b", None)]
    assert sorted(by["locked"]) == sorted(by["method"]) == [("a", "unreadable"), ("b", "unreadable")]
    assert all(by[k] == [(None, "unreadable")] for k in ("cut", "cut.tgz", "empty", "none", "noise"))
    seen = {r["path"]: r["state"] for r in coverage.per_file(coverage.of_archives(formats.members(files))).collect()}
    assert seen == {"stream": "partial", "locked": "partial", "method": "partial", "cut": "unreadable", "cut.tgz": "unreadable", "empty": "unreadable", "none": "unreadable", "noise": "unreadable"}


DEEP = ["[" * 100_000, "{\"a\":" * 100_000, "".join("  " * k + f"k{k}:\n" for k in range(3000)), "a: " + "[" * 3000, "\x00", "é", "", None, "null", "5", "[]", '"x"', "a = 1", json.dumps({"packages": 5, "dependencies": 5, "mcpServers": 5, "subject": 5})]


@pytest.mark.parametrize("name", sorted(formats.WITH_PROBLEMS))
def test_no_text_ends_a_reader(spark, name):
    files = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(DEEP)] + [("p0", "{}")], "path string, text string")
    told = formats.WITH_PROBLEMS[name](files).where("problem IS NOT NULL").collect()
    assert {"p0", "p7"} <= {r["path"] for r in told} and all(r["problem"].startswith(("unreadable", "odd entry")) for r in told)


def test_no_text_ends_workflows_and_policies(spark):
    files = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(DEEP)], "path string, text string")
    assert {"p0", "p1", "p2"} <= {r["path"] for r in workflows.coverage(workflows.steps(files)).collect()}
    assert formats.policy(files).where("section = 'warning'").count() >= 3


def test_coverage_outlives_policies_and_makes_targets_partial(spark):
    files = spark.createDataFrame([("t1/a", "ok"), ("t2/a", None), ("t3/a", "x" * 50)], "path string, text string")
    kept, lost = coverage.bounded(files, 10)
    assert [r["path"] for r in kept.collect()] == ["t1/a"]
    seen = lost.union(coverage.missing(spark.createDataFrame([("t4/a",), ("t1/a",)], "path string"), files))
    assert {(r["path"], r["rule"]) for r in coverage.as_findings(seen).collect()} == {("t2/a", "SCAN_UNREADABLE"), ("t3/a", "SCAN_OVERSIZED"), ("t4/a", "SCAN_MISSING")}
    from pyspark.sql import functions as F

    targets = spark.createDataFrame([("t1", False), ("t2", False), ("t5", True)], "target string, partial boolean")
    got = coverage.partial(targets, seen, F.substring_index("path", "/", 1)).collect()
    assert {r["target"]: r["partial"] for r in got} == {"t1": False, "t2": True, "t3": True, "t4": True, "t5": True}
