"""Streams whose rows come late, twice or not at all, over files written one by one."""

import datetime as dt
import os

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quern.streaming import events

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture
def stream(spark, tmp_path):
    """A stream that takes a file a batch, each from (event_id, minute, user_id, value)."""

    def made(*batches):
        for i, rows in enumerate(batches):
            full = [(e, at(m), u, "click", float(v), "{}") for e, m, u, v in rows]
            spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in-{i}")
        (tmp_path / "events").mkdir()
        for i in range(len(batches)):  # the order of their times is the order of batches
            target = tmp_path / "events" / f"{i}.parquet"
            next((tmp_path / f"in-{i}").glob("part-*")).rename(target)
            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
        schema = spark.createDataFrame([], SCHEMA).schema
        return events.read_stream(spark, f"file://{tmp_path}/events", schema, files_per_trigger=1)

    return made


def test_update_keeps_the_last_row_of_a_key(stream):
    found = events.drain(events.running_totals(stream([(1, 0, 7, 5), (2, 1, 8, 1)], [(3, 2, 7, 2)])), "update", ["user_id"])
    assert sorted(tuple(r) for r in found.collect()) == [(7, 2, 500), (8, 1, 100)]
    with pytest.raises(ValueError):
        events.drain(found, "update")


def test_streams_without_rows(spark, stream):
    found = events.drain(events.tumbling(stream(), "1 hour", "10 minutes"))
    assert found.columns == ["start", "event_type", "n", "cents"] and found.count() == 0


def test_rows_behind_the_watermark_are_dropped(stream):
    """The fourth batch has a row four hours late, which append mode leaves out, and one within ten minutes."""
    batches = [(1, 0, 7, 1), (2, 5, 7, 1)], [(3, 300, 7, 1)], [(8, 301, 7, 1)], [(4, 10, 7, 1), (5, 295, 7, 1)], [(6, 900, 7, 1)]
    found = events.drain(events.tumbling(stream(*batches), "1 hour", "10 minutes"))
    assert sorted((r["start"], r["n"]) for r in found.collect()) == [(at(0), 2), (at(240), 1), (at(300), 2)]


def test_repeats_within_the_watermark_count_once(stream):
    found = events.drain(events.once_each(stream([(1, 0, 7, 1), (2, 1, 7, 1)], [(1, 2, 7, 1), (3, 3, 7, 1)]).select("event_id", "ts"), ["event_id"], "10 minutes"))
    assert sorted(r["event_id"] for r in found.collect()) == [1, 2, 3]


def test_timers_close_sessions(spark, stream):
    """User 7 pauses for two hours; user 8's session goes on over batches, a late row is dropped, the last stays open."""
    rows = [(1, 0, 7, 1), (2, 30, 8, 1)], [(3, 80, 8, 1), (4, 130, 7, 1)], [(9, 132, 8, 1)], [(5, 1, 9, 1), (6, 133, 8, 1)], [(7, 400, 8, 1)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    found = events.drain(events.closed_sessions(stream(*rows), "1 HOUR", "10 minutes"), settings=events.ROCKSDB)
    minute = lambda ms: (ms - int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)) // 60_000
    assert sorted((r["user_id"], minute(r["first_ms"]), minute(r["last_ms"]), r["n"]) for r in found.collect()) == [(7, 0, 0, 1), (7, 130, 130, 1), (8, 30, 133, 4)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_memory_sink(stream):
    found = events.to_memory(stream([(1, 0, 7, 5)], [(2, 1, 8, 1)]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")
    assert [tuple(r) for r in found.collect()] == [("click", 2)]


def test_a_row_between_two_sessions_joins_them(stream):
    """Minutes 0 and 65, then 58, late but within the watermark."""
    rows = [(1, 0, 7, 1)], [(2, 65, 7, 1)], [(3, 58, 7, 1)], [(4, 600, 8, 1)], [(5, 601, 8, 1)]
    found = events.drain(events.closed_sessions(stream(*rows), "1 HOUR", "10 minutes"), settings=events.ROCKSDB)
    assert minutes(found) == [(7, 0, 65, 3)]


def minutes(found):
    start = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return sorted((r["user_id"], (r["first_ms"] - start) // 60_000, (r["last_ms"] - start) // 60_000, r["n"]) for r in found.collect())


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60)), min_size=1, max_size=40), st.randoms(use_true_random=False))
def test_sessions_in_any_order(spark, tmp_path_factory, rows, random):
    """Rows that come up to 200 minutes late, in random batches, give the sessions of all rows in order."""
    order = sorted(rows, key=lambda r: 10 * r[1] + random.randint(0, 190))
    batches = [order[i : i + 8] for i in range(0, len(order), 8)] + [[(9, 500)], [(9, 501)]]
    folder = tmp_path_factory.mktemp("any")
    (folder / "events").mkdir()
    for i, some in enumerate(batches):
        full = [(i, at(10 * m), u, "click", 1.0, "{}") for u, m in some]
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(f"file://{folder}/in-{i}")
        next((folder / f"in-{i}").glob("part-*")).rename(folder / "events" / f"{i}.parquet")
        os.utime(folder / "events" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    source = events.read_stream(spark, f"file://{folder}/events", spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    found = events.drain(events.closed_sessions(source, "30 MINUTES", "200 minutes"), settings=events.ROCKSDB)
    expected = []
    for user in {u for u, _ in rows}:
        runs = events.merge_runs([(10 * m, 10 * m, 1) for u, m in rows if u == user], 30)
        expected += [(user, *r) for r in runs]
    assert minutes(found) == sorted(expected)


@given(st.lists(st.integers(0, 30), max_size=12), st.integers(0, 5))
def test_merge_runs(times, gap):
    """As one scan of all times in order, whatever came first."""
    runs = []
    for t in times:
        runs = events.merge_runs([*runs, (t, t, 1)], gap)
    expected = []
    for t in sorted(times):
        if expected and t - expected[-1][1] <= gap:
            expected[-1][1:] = [t, expected[-1][2] + 1]
        else:
            expected.append([t, t, 1])
    assert runs == [tuple(x) for x in expected]


def test_sessions_ask_the_state_little():
    """A call to the state is a message to the JVM: a user's rows cost three at most, a user that closes two, and no empty frame goes back."""

    class Told:
        def __init__(self):
            self.held, self.timers, self.calls = None, set(), 0

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

        def clear(self):
            self.calls += 1
            self.held = None

        def registerTimer(self, at):
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):
            self.calls += 1
            self.timers.remove(at)

        def getExpiryTimeInMs(self):
            return 0

        def getCurrentWatermarkInMs(self):
            return 500

    told = Told()
    sessions = events._Sessions(100)
    sessions.init(told)
    rows = lambda *ms: iter([pd.DataFrame({"ms": ms})])
    assert list(sessions.handleInputRows((1,), rows(0, 50, 300, 1000), told)) == [] and told.calls == 3 and told.timers == {150}
    assert list(sessions.handleInputRows((1,), rows(1050), told)) == [] and told.calls == 5 and told.timers == {150}
    assert list(sessions.handleInputRows((1,), rows(120), told)) == [] and told.timers == {220}  # late: the first run ends later
    told.timers, told.calls = set(), 0  # Spark takes a timer away that has run out
    (closed,) = sessions.handleExpiredTimer((1,), told, told)
    assert closed.values.tolist() == [[1, 0, 120, 3], [1, 300, 300, 1]] and told.timers == {1150} and told.calls == 3
