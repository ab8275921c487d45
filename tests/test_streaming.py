from __future__ import annotations

import shutil
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vistrel.sources.views import table
from vistrel.streaming import events


def _run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def _stream(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "events.parquet")
    return events.read_stream(spark, str(tmp_path))


def test_windows_close_behind_the_watermark(spark, sf_dir, tmp_path):
    closed = _run(events.windowed(_stream(spark, sf_dir, tmp_path)), "windows", "append")
    batch = events.windowed(table(spark, sf_dir, "events"))
    assert closed.count() > 0
    assert closed.exceptAll(batch).isEmpty()


def test_sessions(spark, sf_dir, tmp_path):
    closed = _run(events.sessions(_stream(spark, sf_dir, tmp_path)), "sessions", "append")
    assert closed.count() > 0
    assert closed.exceptAll(events.sessions(table(spark, sf_dir, "events"))).isEmpty()


@pytest.fixture
def state_store(spark):
    before = {k: spark.conf.get(k, None) for k in events.STATE_STORE}
    for k, v in events.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_running_average(spark, sf_dir, tmp_path, state_store):
    """With an idle time beyond the table's, one row a user, over all its events."""
    out = _run(events.running_average(_stream(spark, sf_dir, tmp_path), idle=timedelta(days=99_999)), "averages", "update")
    assert out.agg(F.sum("n")).first()[0] == table(spark, sf_dir, "events").count()
    plain = {}
    for r in table(spark, sf_dir, "events").orderBy("ts", "event_id").collect():
        old = plain.get(r["user_id"])
        plain[r["user_id"]] = r["value"] if old is None else 0.99 * old + 0.01 * r["value"]
    assert {r["user_id"]: round(r["ema"], 9) for r in out.collect()} == {k: round(v, 9) for k, v in plain.items()}


def test_batches_late_rows_and_expiry(spark, tmp_path, state_store):
    """Three micro-batches: averages go on, a row behind the watermark is dropped, an idle user ends and begins anew."""
    at = lambda minutes: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=minutes)
    batches = [
        [(1, 1, at(0), 10.0), (2, 2, at(1), 5.0)],
        [(3, 1, at(100), 20.0)],
        [(4, 1, at(20), 99.0), (5, 1, at(101), 30.0), (6, 3, at(300), 1.0)],  # minute 20 is behind the watermark of the second batch
        [(7, 2, at(301), 8.0)],
    ]
    schema = "event_id long, user_id long, ts timestamp, value double"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    out = _run(events.running_average(stream, keep=0.5, idle=timedelta(minutes=60)), "expiry", "update")
    got = [tuple(r) for r in out.collect()]
    assert [r for r in got if r[0] == 1] == [(1, 1, 10.0, False), (1, 2, 15.0, False), (1, 3, 22.5, False), (1, 3, 22.5, True)]
    assert [r for r in got if r[0] == 2] == [(2, 1, 5.0, False), (2, 1, 5.0, True), (2, 1, 8.0, False)]
    assert (3, 1, 1.0, False) in got
