"""Streams over the events table: files in, windows and state, files out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from quern.sources.files import work_dir


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """A stream of Parquet files; ``ts`` becomes a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory():
        found = rows.parquet(path)
    else:  # streams read folders
        folder, _, name = path.rpartition("/")
        found = rows.option("pathGlobFilter", name).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append", keys: list[str] = (), settings: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote, read from its files.

    Each batch has a folder of its own, which a batch that is run again replaces. append gives all batches, complete
    the last one, and update the last row of each of ``keys``. A stream without rows gives an empty table.
    ``settings`` hold while the stream runs.
    """
    if mode == "update" and not keys:
        raise ValueError("name the keys whose last rows are wanted")
    spark, path = stream.sparkSession, work_dir(stream.sparkSession)
    written: list[int] = []

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        written.append(batch)

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(put).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not written:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/batch={max(written)}")
    batches = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(path)
    if mode == "append":
        return batches.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    last = batches.groupBy(*keys).agg(F.max_by(F.struct(F.lit(1).alias("_"), *rest), "batch").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest]).select(*stream.columns)


def to_memory(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into Spark's memory sink, on the driver: for results that stay small."""
    name = f"memory_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def tumbling(stream: DataFrame, length: str, late: str) -> DataFrame:
    """Count and sum of values per event type and window."""
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents"
    )


def sliding(stream: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide))
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def session(stream: DataFrame, gap: str, late: str) -> DataFrame:
    windowed = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return windowed.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def once_each(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Drops repeats of a key that come within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_totals(stream: DataFrame) -> DataFrame:
    """Per user: events so far and the largest value, kept in state between batches."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, 0)
        for rows in parts:
            n += len(rows)
            top = max(top, int((rows["value"] * 100).round().max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top_cents": [top]})

    return stream.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, n long, top_cents long", "n long, top long", "update", GroupStateTimeout.NoTimeout
    )


#: transformWithState keeps its state in RocksDB.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def merge_runs(runs: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Runs (first, last, n) in order of time; those no more than ``gap`` apart become one."""
    merged: list[tuple[int, int, int]] = []
    for first, last, n in sorted(runs):
        if merged and first <= merged[-1][1] + gap:
            merged[-1] = (merged[-1][0], max(merged[-1][1], last), merged[-1][2] + n)
        else:
            merged.append((first, last, n))
    return merged


class _Sessions(StatefulProcessor):
    """The open runs of a user, as one value. Rows that come late widen or join runs, and a run closes only when the watermark is the gap past its end.

    A user with open runs has one timer, for the run that ends first; each call to the state is a message to the JVM, so the timer is known by the runs and not asked for.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "runs binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        runs = before = self._runs()
        for part in rows:
            times, counts = np.unique(part["ms"].to_numpy(), return_counts=True)
            cuts = np.append(0, np.flatnonzero(np.diff(times) > self.gap_ms) + 1)
            ends = np.append(cuts[1:], len(times))
            runs = merge_runs(runs + [(int(times[i]), int(times[j - 1]), int(counts[i:j].sum())) for i, j in zip(cuts, ends, strict=True)], self.gap_ms)
        self._keep(runs)
        old, new = self._due(before), self._due(runs)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, passed = self._runs(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        left = [r for r in runs if r[1] + self.gap_ms > passed]
        self._keep(left)
        if left:
            self.handle.registerTimer(self._due(left))
        closed = [r for r in runs if r[1] + self.gap_ms <= passed]
        return iter([self._told(key, closed)] if closed else [])

    def _runs(self) -> list[tuple[int, int, int]]:
        held = self.open.get()
        return [tuple(r) for r in np.frombuffer(held[0], "<i8").reshape(-1, 3).tolist()] if held is not None else []

    def _due(self, runs: list[tuple[int, int, int]]) -> int | None:
        """When the run that ends first is over."""
        return min(last for _, last, _ in runs) + self.gap_ms if runs else None

    def _keep(self, runs: list[tuple[int, int, int]]) -> None:
        if runs:
            self.open.update((np.array(runs, "<i8").tobytes(),))
        else:
            self.open.clear()

    @staticmethod
    def _told(key: tuple, found: list) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]] * len(found), "first_ms": [x[0] for x in found], "last_ms": [x[1] for x in found], "n": [x[2] for x in found]}, dtype="int64")

    def close(self) -> None:
        pass


def closed_sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Per user: first and last time (milliseconds) and events of each session, once the watermark is ``gap`` past its end.

    A session ends with a pause of more than ``gap``; the order in which its rows come doesn't matter as long as none is later than ``late``, which is dropped. Run it with ROCKSDB as settings.
    """
    width = stream.sparkSession.sql(f"SELECT INTERVAL {gap} AS w").first()["w"]
    rows = stream.withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    processor = _Sessions(int(width.total_seconds() * 1000))
    return rows.groupBy("user_id").transformWithStateInPandas(processor, "user_id long, first_ms long, last_ms long, n long", "append", "EventTime")
