"""op13 against a manifest built level by level in plain Python."""

import zlib
from hashlib import sha256

from quarrylens.llm import op13_merkle as op13

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, range int"


def h(*parts):
    return sha256(b"".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


def leaf(r, text):
    out = b""
    for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text):
        raw = b"" if v is None else str(v).encode()
        out += b"-" if v is None else b"%d:%s" % (len(raw), raw)
    return h(out)


def tree(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def sides(levels, i):
    for nodes in levels[:-1]:
        j = i - i % 16
        yield nodes[j:i], nodes[i + 1 : j + 16]
        i //= 16


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: tree([leaf(r, r["text"]) for r in groups[s]]) for s in names}
    above = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*sides(trees[s], i), *sides(above, k)]
            own = folded = trees[s][0][i]
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                folded = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in path:
                folded = h(*left, folded, *right)
            root = above[-1][0]
            out.append((r["doc_id"], own, trees[s][-1][0], root, h(*(d for p in path for x in p for d in x)), folded, folded == root))
    return out


def same(spark, rows):
    df = spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in op13.manifest(df).collect()]
    assert sorted(got, key=str) == sorted(by_hand(rows), key=str)
    return got


def test_manifest_of_odd_rows(spark):
    # a hot source over several ranges, null sources and ids, repeated ids and rows, many sources of one row
    rows = []
    for i in range(1500):
        source = None if i % 5 == 0 else "hot" if i % 3 else f"s{i}é"
        rows.append({"doc_id": i % 700 if i % 50 else None, "source": source, "lang": None if i % 7 == 0 else "é", "n_chars": None if i % 11 == 0 else i, "text": None if i % 13 == 0 else "ABcÉ:1" * (i % 4)})
    rows += [rows[1]] * 40 + [{"doc_id": 9999, "source": "hot", "lang": "", "n_chars": 0, "text": "Zy" * 1_000_000}]
    got = same(spark, rows)
    assert {v for *_, v in got} == {True, False}


def test_small_trees(spark):
    row = {"source": "a", "lang": "en", "n_chars": 1, "text": "A"}
    for n in (1, 2, 16, 17):
        same(spark, [row | {"doc_id": i} for i in range(n)])
    same(spark, [row | {"doc_id": 1, "source": s} for s in (None, "", "b", "B", "é")])
    assert op13.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_missing_children_are_an_error():
    import pytest

    with pytest.raises(ValueError):
        op13.run_of([(0, "x", False, None), (2, "y", True, None)])
    with pytest.raises(ValueError):
        op13.run_of([(0, "x", False, None)])
