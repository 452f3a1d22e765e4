"""Queries against their SQL on rows that the given tables lack."""

import random
from collections import Counter
from decimal import Decimal, localcontext

import duckdb

from quarrylens.functions import scalars
from quarrylens.plans import catalog


def compared(spark, folder, name, table, rows, schema):
    """Rows of the query and of its SQL over one table of a few rows."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    own, sql = catalog.QUERIES[name](spark, str(folder)).toPandas(), con.execute(catalog.ORACLES[name]).df()
    return [sorted(map(tuple, x[sorted(own.columns)].astype(str).to_numpy().tolist())) for x in (own, sql)]


def test_cut_files_are_unreadable_for_any_key(spark, tmp_path):
    """keys and sizes of one digit and of many."""
    rows = [(k, s) for k in (0, 1, 2, 3, 5, 9, 10, 11, 99, 1234567, 1234569, 123456789) for s in (1,)] + [(k, s) for k, s in ((13, 3), (17, 50), (21, 2), (25, 49))]
    own, sql = compared(spark, tmp_path, "coverage_of_readers", "part", rows, "p_partkey long, p_size int")
    assert own == sql and len(own) == 14


def test_entropy_of_texts_without_bytes(spark, tmp_path):
    """null and empty texts have no row; a text of one value has the SQL's zero."""
    rows = [(1, "abca"), (2, None), (3, ""), (4, "aaaa"), (5, "\u00e9\u00e9"), (6, " ")]
    own, sql = compared(spark, tmp_path, "file_entropy", "documents", rows, "doc_id long, text string")
    assert own == sql and [r[0] for r in own] == ["1", "4", "5", "6"]


def test_entropy_is_right_to_the_last_digit(spark):
    """no rounding of sums is left in the result, so that it decides no sixth decimal."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz  ", k=rng.randint(1, 3000))) for _ in range(300)]

    def exact(text):
        with localcontext() as c:
            c.prec = 40
            p = [Decimal(n) / len(text) for n in Counter(text).values()]
            return float(-sum(x * x.ln() for x in p) / Decimal(2).ln())

    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", scalars.byte_entropy("text").alias("e")).collect()
    assert [r["e"] for r in rows] == [exact(r["text"]) + 0.0 for r in rows]
