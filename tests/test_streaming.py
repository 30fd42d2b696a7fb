import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from earshot.operators.detect import SegmentMachine, SmoothedTrigger, TriggerMachine, replay
from earshot.operators.scans import series_rank
from earshot.streaming import detectors, flows

SCHEMA = "dev int, ts timestamp, seq long, pa double, pb double, active boolean, value double"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def frames(seed=1, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        for dev in (1, 2):
            p = rng.random()
            rows.append((dev, T0 + dt.timedelta(seconds=i), i, p, 1 - p, rng.random() < 0.6, round(rng.random(), 3)))
    return rows


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    detectors.use_rocksdb(spark)


def write_files(spark, rows, folder, parts=3):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(events, tmp, name):
    out, ck = os.path.join(tmp, name), os.path.join(tmp, name + "-ck")
    q = flows.append_sink(events, out, ck, available_now=True)
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return events.sparkSession.read.parquet(out)


MACHINE = SmoothedTrigger(("a", "b"), TriggerMachine(0.5, 2, 5), alpha=0.5)
FIELDS = {"label": "string", "score": "double"}


def batch_twin(df):
    return sorted(tuple(r) for r in replay(df, ["dev"], "seq", MACHINE, ["pa", "pb"], FIELDS, block_rows=32).select("dev", "seq", "label").collect())


def test_trigger_stream_equals_batch_and_survives_restart(spark, tmp_path):
    folder, tmp = str(tmp_path / "in"), str(tmp_path)
    rows = frames()
    write_files(spark, rows[:200], folder, 2)
    stream = flows.replay_source(spark, folder, SCHEMA)
    events = detectors.detect_stream(stream, "dev", "ts", "seq", MACHINE, ["pa", "pb"], FIELDS)
    run(events, tmp, "out")
    write_files(spark, rows[200:], folder, 2)  # resumes from the checkpointed state
    got = run(events, tmp, "out")
    assert sorted(tuple(r) for r in got.select("dev", "seq", "label").collect()) == batch_twin(spark.createDataFrame(rows, SCHEMA))


def test_buffered_stream_restores_event_order(spark, tmp_path):
    folder, tmp = str(tmp_path / "in"), str(tmp_path)
    rows = frames(2, 120)
    # neighbouring frames arrive swapped, within the allowed lateness
    shuffled = sorted(rows, key=lambda r: (r[2] // 8, -r[2], r[0]))
    write_files(spark, shuffled, folder, 3)
    last = [(d, T0 + dt.timedelta(hours=1), 10_000, 0.0, 0.0, False, 0.0) for d in (1, 2)]
    spark.createDataFrame(last, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = flows.replay_source(spark, folder, SCHEMA)
    events = detectors.detect_stream(stream, "dev", "ts", "seq", MACHINE, ["pa", "pb"], FIELDS, lateness="20 seconds")
    got = run(events, tmp, "out")
    want = batch_twin(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.select("dev", "seq", "label").collect()) == want


def test_segment_stream_equals_batch(spark, tmp_path):
    folder, tmp = str(tmp_path / "in"), str(tmp_path)
    rows = frames(3)
    write_files(spark, rows, folder)
    machine = SegmentMachine(0.4, onset=2, hangover=2, shortest=2, longest=15, pre=3, cooldown=4)
    fields = {"first": "long", "last": "long", "speech": "long", "score": "double", "fired": "boolean"}
    stream = flows.replay_source(spark, folder, SCHEMA).withColumn("at", F.col("seq"))
    got = run(detectors.detect_stream(stream, "dev", "ts", "seq", machine, ["at", "value", "active"], fields), tmp, "out")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.col("seq"))
    want = replay(df, ["dev"], "seq", machine, ["at", "value", "active"], fields, block_rows=40)
    cols = ["dev", "seq", *fields]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_windows_drop_late_rows(spark, tmp_path):
    folder, tmp = str(tmp_path / "in"), str(tmp_path)
    rows = [r for r in frames(4, 60) if r[0] == 1]
    for part in (rows[:30], rows[30:], [(1, T0 + dt.timedelta(seconds=2), 999, 0.0, 0.0, True, 0.0)],
                 [(1, T0 + dt.timedelta(hours=1), 1000, 0.0, 0.0, True, 0.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = flows.replay_source(spark, folder, SCHEMA)
    got = run(flows.tumbling_counts(stream, "ts", ["dev"], "10 seconds", "5 seconds"), tmp, "tumble")
    counts = {r.window.start.second + 60 * r.window.start.minute: r.n for r in got.collect()}
    assert counts[0] == 9 and counts[10] == 10  # the row at second 2 came too late
    history = run(flows.recent_history(flows.replay_source(spark, folder, SCHEMA), "ts", ["dev"], "value"), tmp, "recent")
    assert history.filter("n = 5").count() >= 50


def test_sessions_and_repeats(spark, tmp_path):
    folder, tmp = str(tmp_path / "in"), str(tmp_path)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, at(s), s, 0.0, 0.0, True, 0.0) for s in (1, 2, 3, 20, 21)] + [(1, at(3), 3, 0.0, 0.0, True, 0.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    spark.createDataFrame([(1, at(3600), 99, 0.0, 0.0, True, 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = flows.replay_source(spark, folder, SCHEMA)
    got = run(flows.sessions(stream, "ts", "dev", F.col("active"), "5 seconds", "1 second"), tmp, "ses")
    assert sorted(r.n_frames for r in got.collect()) == [2, 4]
    unique = run(flows.without_repeats(flows.replay_source(spark, folder, SCHEMA), "ts", ["dev", "seq"], "1 minute"), tmp, "uniq")
    assert unique.count() == 6


def test_live_settings(spark, tmp_path):
    folder, knobs = str(tmp_path / "in"), str(tmp_path / "knobs")
    write_files(spark, frames(5, 20), folder, 2)
    spark.createDataFrame([(0.5,)], "threshold double").write.parquet(knobs)
    out = str(tmp_path / "out")

    def handle(batch, settings, number):
        batch.filter(F.col("pa") >= settings["threshold"]).write.mode("append").parquet(out)

    q = flows.with_live_settings(flows.replay_source(spark, folder, SCHEMA), knobs, handle, str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == sum(r[3] >= 0.5 for r in frames(5, 20))


def test_event_table_as_stream(spark, tmp_path):
    """The whole event table replayed as a stream gives the batch triggers."""
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    machine = TriggerMachine(20.0, 2, 3)
    stream = flows.event_time(spark.readStream.schema(events.schema).parquet(path.replace("events.parquet", "events*.parquet")), "ts")
    got = run(detectors.detect_stream(stream, "user_id", "ts", "event_id", machine, ["event_type", "value"], FIELDS), str(tmp_path), "ev")
    ranked = series_rank(flows.event_time(events, "ts"), ["user_id"], "ts", "event_id", "seq")
    want = replay(ranked, ["user_id"], "seq", machine, ["event_type", "value"], FIELDS).join(
        ranked.select("user_id", "seq", "event_id"), ["user_id", "seq"]
    )
    cols = ["user_id", "event_id", "label", "score"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
