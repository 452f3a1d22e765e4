"""A walk within budgets, and a watch over keys of which one is poisoned, across a restart."""

import json
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from quarrylens.sources import walk
from quarrylens.streaming import monitor


def test_walk_reports_what_it_leaves_out(spark, tmp_path):
    for p, size in {"top.txt": 3, "a/x.txt": 2, "a/b/c/deep.txt": 1, "a/b/y.txt": 1, "big/large.bin": 5000, **{f"many/f{k}": 1 for k in range(1, 7)}, "node_modules/z.js": 1, "many/.git/h": 1}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x" * size)
    rows = walk.tree(spark, str(tmp_path), maxDepth=2, maxEntries=5, maxBytes=1000)
    got = {r["path"]: (r["size"], r["problem"]) for r in rows.collect()}
    assert got == {"top.txt": (3, None), "a/x.txt": (2, None), "a/b/y.txt": (1, None), "a/b/c": (None, "too deep"), "big/large.bin": (5000, "oversized"), "many/.git": (None, "excluded"), **{f"many/f{k}": (1, None) for k in range(1, 5)}, "many": (None, "entry budget used up"), "node_modules": (None, "excluded")}
    assert rows.rdd.getNumPartitions() >= 4
    assert {(r["path"], r["state"]) for r in walk.coverage(rows).collect()} == {("a/b/c", "partial"), ("big/large.bin", "oversized"), ("many", "partial")}
    lost = walk.tree(spark, str(tmp_path / "absent")).collect()
    assert len(lost) == 1 and lost[0]["problem"].startswith("unreadable")


def test_a_poisoned_key_costs_one_row_a_batch_and_state_outlives_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "user_id long, ts timestamp, props string"

    def read(frame):
        return pd.DataFrame({"at": frame["ts"], "what": [json.loads(x)["what"] for x in frame["props"]]})

    minute = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = monitor.watched(stream, read)
        write = lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))
        out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return {(r["key"], r["kind"], r["detail"], r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    arrive((1, minute(0), '{"what": "a"}'), (2, minute(0), '{"what": "b"}'), (3, minute(0), "poison"))
    first = run()
    assert {x[:3] for x in first} == {(3, "error", "JSONDecodeError")}
    arrive((1, minute(5), '{"what": "c"}'), (2, minute(4), "poison"), (2, minute(6), '{"what": "d"}'), (3, minute(7), '{"what": "e"}'))
    second = run() - first
    assert second == {(1, "alert", "c", minute(5)), (2, "alert", "d", minute(6)), (2, "error", "JSONDecodeError", minute(6))}
    arrive((1, minute(200), '{"what": "f"}'))
    third = run() - first - second
    assert (1, "alert", "f", minute(200)) in third
    arrive((1, minute(201), '{"what": "g"}'))
    last = run() - first - second - third
    assert {(k, kind) for k, kind, *_ in third | last} >= {(1, "alert"), (2, "silent"), (3, "silent")}
