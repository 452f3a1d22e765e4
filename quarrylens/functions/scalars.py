"""Column expressions: severity scales, rounding, address classes, URL parts, entropy, name normalisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ranks, score weights and dimension weights of the five severities.
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
SCORE_WEIGHT = {"critical": 25, "high": 15, "medium": 5, "low": 2, "info": 1}
DIMENSION_WEIGHT = {"critical": 10, "high": 6, "medium": 3, "low": 1, "info": 0}


def _by(col: Column, table: dict[str, int], default: int = 0) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(default)


def severity_rank(col: Column) -> Column:
    return _by(col, RANK)


def score_weight(col: Column) -> Column:
    return _by(col, SCORE_WEIGHT)


def dimension_weight(col: Column) -> Column:
    return _by(col, DIMENSION_WEIGHT)


def round_half_up(col: Column) -> Column:
    """floor(x + 0.5), also for negative halves."""
    return F.floor(col + F.lit(0.5))


def risk_level(score: Column) -> Column:
    return F.when(score <= 0, "clean").when(score <= 10, "low").when(score <= 30, "medium").when(score <= 60, "high").otherwise("critical")


def ipv4_class(ip: Column) -> Column:
    """invalid, loopback, private, documentation or public; an octet with a leading zero is invalid."""
    o = F.split(ip, r"\.")
    octet = [F.get(o, k).try_cast("int") for k in range(4)]
    text = [F.get(o, k) for k in range(4)]
    valid = F.size(o) == 4
    for n, t in zip(octet, text, strict=True):
        valid = valid & n.isNotNull() & (n >= 0) & (n <= 255) & ((F.length(t) == 1) | ~t.startswith("0"))
    a, b, c, _ = octet
    return (
        F.when(~F.coalesce(valid, F.lit(False)), "invalid")
        .when((a == 127) | (a == 0), "loopback")
        .when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)), "private")
        .when(((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)), "documentation")
        .otherwise("public")
    )


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def normalized_package(name: Column) -> Column:
    """Lower case, runs of - _ . as one hyphen."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


@F.arrow_udf(DoubleType())
def byte_entropy(texts: pa.Array) -> pa.Array:
    """Shannon entropy of the UTF-8 bytes, bits a byte; 0 for nothing. Counts are taken on the Arrow buffer; sums are wider than the result, so their order doesn't show in it."""
    if not len(texts):
        return pa.array([], pa.float64())
    wide = pa.types.is_large_string(texts.type)
    column = texts.fill_null("") if texts.null_count else texts
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    size, out = np.diff(offs), np.zeros(len(column))
    for i in range(0, len(column), 256):
        n = size[i : i + 256]
        part = raw[offs[i] - offs[0] : offs[i + len(n)] - offs[0]]
        counts = np.bincount(np.repeat(np.arange(len(n)) * 256, n) + part, minlength=256 * len(n)).reshape(-1, 256)
        row, byte = np.nonzero(counts)
        p = counts[row, byte].astype(np.longdouble) / n[row]
        terms, begins = p * np.log2(p), np.flatnonzero(np.diff(row, prepend=-1))
        if len(begins):
            out[i + row[begins]] = -np.add.reduceat(terms, begins) + 0.0
    return pa.array(out)


def osa_at_most_one(a: Column, b: Column) -> Column:
    """Optimal-string-alignment distance of at most 1: one edit, or one swap of neighbours."""
    n = F.length(a)
    swapped = (n == F.length(b)) & F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: (F.substring(a, i, F.lit(1)) == F.substring(b, i + 1, F.lit(1)))
        & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, i, F.lit(1)))
        & (F.substring(a, F.lit(1), i - 1) == F.substring(b, F.lit(1), i - 1))
        & (F.substring(a, i + 2, n) == F.substring(b, i + 2, n)),
    )
    return (F.abs(n - F.length(b)) <= 1) & ((F.levenshtein(a, b) <= 1) | swapped)
