"""Continuous monitoring with Structured Streaming."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def tumbling(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """window_start, <by>, n, total: windowed counts and sums behind a watermark; works on static frames as well."""
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    source = events.withWatermark(at, late) if events.isStreaming else events
    out = source.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def last_seen(events: DataFrame, key: str = "user_id", at: str = "ts", what: str = "event_type") -> DataFrame:
    """Per key and batch: number of events, newest event, and whether the key is new (the first batch is the baseline)."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, newest, kind = (state.get if state.exists else (0, pd.Timestamp(0), ""))
        known = state.exists
        for f in frames:
            seen += len(f)
            top = f.loc[f[at].idxmax()]
            if top[at] >= newest:
                newest, kind = top[at], top[what]
        state.update((seen, newest, kind))
        yield pd.DataFrame({"key": [k[0]], "seen": [seen], "newest": [newest], "kind": [kind], "known": [known]})

    return events.groupBy(key).applyInPandasWithState(
        update, "key long, seen long, newest timestamp, kind string, known boolean", "seen long, newest timestamp, kind string", "update", GroupStateTimeout.NoTimeout
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def replay(spark: SparkSession, out: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """The rows that a streaming frame gives for all that its source has now, with the batch they came in."""
    folder = shared_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/b{number}")

    out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(out.withColumn("batch", F.lit(0)).schema).parquet(f"{folder}/rows")


def newest_state(rows: DataFrame, key: str = "key") -> DataFrame:
    """The last state of each key of a replay."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), "batch").alias("s")).select("s.*").drop("batch")


def alerts(events: DataFrame, key: str = "user_id", at: str = "ts", what: str = "event_type") -> DataFrame:
    """key, at, what, newest_before: one row for each event that is newer than the last one seen of its key; the first batch of a key only sets the state."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (None,)
        rows = pd.concat(frames)
        newest = rows[at].max()
        if seen is not None:
            fresh = rows[rows[at] > seen].drop_duplicates([at, what]).sort_values([at, what])
            yield pd.DataFrame({"key": k[0], "at": fresh[at], "what": fresh[what], "newest_before": seen})
        state.update((newest if seen is None else max(newest, seen),))

    return events.groupBy(key).applyInPandasWithState(update, "key long, at timestamp, what string, newest_before timestamp", "newest timestamp", "append", GroupStateTimeout.NoTimeout)


def memos(transactions: DataFrame, programs: tuple[str, ...]) -> DataFrame:
    """id, memo: data of the top-level and inner instructions (arrays of struct<program, data>) of the given programs."""
    every = F.concat(F.coalesce("instructions", F.array()), F.coalesce(F.flatten("inner"), F.array()))
    return transactions.select("id", F.explode(every).alias("i")).where(F.col("i.program").isin(*programs)).select("id", F.col("i.data").alias("memo"))


def once(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once: by id within the watermark on a stream, over all rows on a static frame."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


class Watch(StatefulProcessor):
    """State of one watched key: the newest event seen and a timer for its silence.

    Frames of a batch are taken one after the other. Rows that ``read`` refuses give
    one error row for the key and batch; the key's other rows, and other keys, go on.
    The first batch with a readable row only sets the state.
    """

    def __init__(self, read: Callable[[pd.DataFrame], pd.DataFrame], quiet_ms: int):
        self.read, self.quiet_ms = read, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = pd.Timestamp(self.newest.get()[0]) if self.newest.exists() else None
        newest, error = seen, None
        for frame in rows:
            try:
                good, refused = self.read(frame), None
            except Exception as e:  # noqa: BLE001  a poisoned key must not stop the others
                good, refused = frame.iloc[:0], type(e).__name__
                for k in range(len(frame)):
                    with contextlib.suppress(Exception):
                        good = pd.concat([good, self.read(frame.iloc[k : k + 1])])
            error = error or refused
            if len(good):
                top = pd.Timestamp(good["at"].max())
                if seen is not None:
                    fresh = good[good["at"] > seen].drop_duplicates(["at", "what"]).sort_values(["at", "what"])
                    if len(fresh):
                        yield self._rows(key, fresh["at"], "alert", fresh["what"])
                newest = top if newest is None else max(newest, top)
        if error:
            yield self._rows(key, [newest], "error", [error])
        if newest is not None and newest != seen:
            self.newest.update((newest,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(newest.timestamp() * 1000) + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._rows(key, [pd.Timestamp(self.newest.get()[0])], "silent", [None])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, at, kind: str, detail) -> pd.DataFrame:  # noqa: ANN001
        return pd.DataFrame({"key": key[0], "at": list(at), "kind": kind, "detail": list(detail)})


def watched(events: DataFrame, read: Callable[[pd.DataFrame], pd.DataFrame], key: str = "user_id", at: str = "ts", late: str = "10 minutes", quiet_ms: int = 3_600_000) -> DataFrame:
    """key, at, kind (alert, error, silent), detail of a stream: news of each key, what could not be read, and keys that fell silent.

    ``read`` turns rows of a key into columns at and what. A key is silent when the
    watermark passes its newest event by ``quiet_ms``. Needs the RocksDB state store.
    """
    grouped = events.withWatermark(at, late).groupBy(key)
    return grouped.transformWithStateInPandas(statefulProcessor=Watch(read, quiet_ms), outputStructType="key long, at timestamp, kind string, detail string", outputMode="append", timeMode="eventtime")
