"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

from quarrylens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text_rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(tuple, frame[cols].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    assert text_rows(catalog.QUERIES[name](spark, SF).toPandas()) == text_rows(con.execute(catalog.ORACLES[name]).df())


def test_report_json(spark):
    assert catalog.QUERIES["report_json"](spark, SF).where("value LIKE '{\"ruleId\"%'").count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["orphans"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)" in plan
    assert "l_extendedprice" not in plan.split("== Physical Plan ==")[1]
