"""Streams in several micro-batches give the batch answer."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mendframe.operators import steps as L
from mendframe.session import scratch_path
from mendframe.sources import event_log
from mendframe.streaming.audit import Audit, stream_audit
from mendframe.streaming.quality import quality_windows
from mendframe.streaming.sessions import Sessions, session_totals, stream_sessions
from mendframe.streaming.sinks import run_append, run_update, state_store
from test_steps import RECS, STEPS, make_log


def write_parts(df, column, parts, path):
    """One folder per part of the order, oldest first."""
    for i in range(parts):
        df.filter(F.col(column) % parts == i).drop(column).coalesce(1).write.mode("append").parquet(path)


def stream(spark, df, path, per_batch=1):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


DAY = 86_400


def at(seconds):
    """A time some seconds after a fixed moment."""
    return F.timestamp_seconds(F.lit(1_700_000_000) + seconds)


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_audit_does_not_depend_on_batches(spark, batches):
    """The rows come in any order, spread over the micro-batches by a hash."""
    rows, recs = make_log(3)
    steps = spark.createDataFrame(rows, STEPS)
    table = spark.createDataFrame(recs, RECS)
    issued = table.groupBy("session_id", "step").agg(F.collect_list("rec_id").alias("issued"))
    full = steps.join(issued, ["session_id", "step"], "left").withColumn("part", F.pmod(F.xxhash64("session_id", "step"), F.lit(batches)))
    full = full.withColumn("ts", at(F.col("step") * 10))
    path = scratch_path(spark, "audit-input")
    write_parts(full, "part", batches, path)
    columns = ["session_id", "step", "outcome", "budget_before", "streak", "rule"]
    got = run_append(stream_audit(stream(spark, full.drop("part"), path), delay="30 days"), "audit-test").select(columns)
    want = L.rule_audit(steps, table).select(columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_gap_delays_steps_until_the_watermark(spark):
    """Number 2 is missing, another log starts at 5; both go on once the watermark has passed them."""
    kind = "session_id bigint, step bigint, action string, rec_id string, accuracy_after double, target_accuracy double, s bigint, part int"
    query = lambda session, step, s, part: (session, step, "query_cleaner", None, 0.5, 0.9, s, part)
    rows = [query(1, 1, 0, 0), query(1, 3, 20, 0), query(1, 4, 30, 0), query(2, 5, 10, 0), query(2, 6, 20, 0)]
    rows += [query(9, 1, 40, 1), query(9, 2, 9000, 2), query(9, 3, 9001, 3)]
    df = spark.createDataFrame(rows, kind).select("*", at(F.col("s")).alias("ts"), F.array().cast("array<string>").alias("issued")).drop("s")
    path = scratch_path(spark, "audit-gap")
    write_parts(df, "part", 4, path)
    out = run_append(stream_audit(stream(spark, df.drop("part"), path), delay="1 minute"), "gap-test")
    found = sorted((r["session_id"], r["step"], r["outcome"], r["streak"]) for r in out.collect())
    assert found == [
        (1, 1, "executed", 1), (1, 3, "executed", 2), (1, 4, "blocked", 3), (2, 5, "executed", 1), (2, 6, "executed", 2),
        (9, 1, "executed", 1), (9, 2, "executed", 2), (9, 3, "blocked", 3),
    ]
    first = run_append(stream_audit(stream(spark, df.drop("part"), path), delay="30 days"), "gap-early")
    assert {(r["session_id"], r["step"]) for r in first.collect()} == {(1, 1), (9, 1), (9, 2), (9, 3)}


def session_rows(spark, rows):
    return spark.createDataFrame(rows, "session_id bigint, s bigint, part int").select("session_id", at(F.col("s")).alias("ts"), "part")


def totals(spark, df, parts, **options):
    path = scratch_path(spark, "sessions-input")
    write_parts(df, "part", parts, path)
    snapshots = run_append(stream_sessions(stream(spark, df.drop("part"), path), **options), "sessions-test")
    return {r["session_id"]: (r["n_steps"], r["n_rejected"]) for r in session_totals(snapshots).collect()}


def test_expired_sessions_stay_known(spark):
    """A step long after the expiry, in a later batch, is rejected and starts nothing anew."""
    rows = [(1, 0, 0), (1, 100, 0), (9, 90_000, 1), (9, 90_001, 2), (1, 180_000, 3), (9, 180_001, 3)]
    assert totals(spark, session_rows(spark, rows), 4, delay="1 minute") == {1: (2, 1), 9: (2, 1)}


def test_sessions_expire_from_their_start(spark):
    rows = [(1, 0, 0), (1, 100, 0), (1, 2000, 0), (2, 50, 0), (2, 1800, 0), (3, 9000, 0)]
    assert totals(spark, session_rows(spark, rows), 1) == {1: (2, 1), 2: (2, 0), 3: (1, 0)}


def test_an_earlier_step_moves_the_start(spark):
    """The step at 1,790 is in time of the start at 0 known first, and late for the true start at -30."""
    rows = [(1, 0, 0), (1, 1790, 0), (1, -30, 1), (2, 10, 1), (1, 1900, 2)]
    assert totals(spark, session_rows(spark, rows), 3, delay="1 hour") == {1: (2, 2), 2: (1, 0)}


@pytest.mark.parametrize("batches", [4, 12])
def test_state_holds_open_sessions_only(spark, batches):
    """Twenty new sessions a day: after any number of days the state is that of the open ones."""
    rows = [(day * 20 + i, day * DAY + i * 60, day) for day in range(batches) for i in range(20)]
    df = session_rows(spark, rows)
    path, out, state = (scratch_path(spark, n) for n in ("open-input", "open-output", "open-state"))
    write_parts(df, "part", batches, path)
    with state_store(spark):
        query = (
            stream_sessions(stream(spark, df.drop("part"), path), delay="1 minute")
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 100 and spark.read.parquet(out).where("status = 'expired'").count() == 20 * (batches - 1)


@pytest.mark.parametrize("per_batch", [1, 10])
def test_quality_windows_in_batch_and_stream(spark, per_batch):
    df = spark.range(600).select(
        F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("a"),
        (F.col("id") % 3 == 0).cast("int").alias("label"),
        (F.col("id") / 200).cast("int").alias("part"),
    )
    path = scratch_path(spark, "quality-input")
    write_parts(df, "part", 3, path)
    plain = df.drop("part")
    want = sorted(map(tuple, quality_windows(plain, ["a"]).collect()))
    windows = quality_windows(stream(spark, plain, path, per_batch), ["a"], delay="30 days")
    got = run_update(windows, "quality-test", ["window_start"])
    assert sorted(map(tuple, got.collect())) == want


def test_event_log_batch_and_stream(spark):
    df = spark.createDataFrame([(1, 1700000000.1234, "x")], "session_id int, t double, k string").withColumn(
        "ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint"))
    )
    path = scratch_path(spark, "events")
    event_log.write_event_log(event_log.to_event_lines(df, "query_step", "ts", "session_id", ["k"]), path)
    row = event_log.read_event_log(spark, path).first()
    assert (row["event"], row["session_id"], row["attrs"]) == ("query_step", "1", {"k": "x"})
    assert row["ts"].microsecond == 123000
    spark.createDataFrame([("no json",), ('{"ts": 1.5, "event": ',), ("",), ('{"ts": 1.5}',)], "value string").write.mode("append").text(path)
    good, bad = event_log.stream_event_log(spark, path)
    assert run_append(good, "events-test").count() == 1
    assert run_append(bad, "bad-lines").count() == 4


class Store:
    """Stands in for the state store; every call is a message that a worker would send."""

    def __init__(self):
        self.calls, self.values = [], {}

    def getValueState(self, name, schema):  # noqa: N802
        return Value(self, name)

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("timer")

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


class Value:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def __getattr__(self, call):
        def told(*value):
            self.store.calls.append(call)
            if value:
                self.store.values[self.name] = value[0]
            return self.store.values.get(self.name) is not None if call == "exists" else self.store.values.get(self.name)

        return told


@pytest.mark.parametrize("steps", [1, 50])
def test_a_session_costs_three_messages_a_batch(steps):
    step = {"action": "query_cleaner", "rec_id": None, "issued": None, "reached": False, "due": 9}
    asked = [{**step, "step": 2 * i + 1, "issued": ["a", "b"]} for i in range(steps)]
    for processor, rows in (
        (Sessions(1800), [Row(at=1000.0 + i) for i in range(steps)]),
        (Audit(5, 3), [pd.DataFrame(asked)]),
    ):
        store = Store()
        processor.init(store)
        for _ in range(2):
            store.calls.clear()
            assert list(processor.handleInputRows((1,), iter(rows), store))
            assert len(store.calls) <= 3
