"""Stream forms against the batch operators, over several micro-batches of unordered rows."""

import os
import random
import shutil
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tools.compare import rows_of

from spindlewatch.operators import features, parse, status, windows
from spindlewatch.plans.registry import plain, timed
from spindlewatch.plans.stream_registry import marked
from spindlewatch.session import shared_path
from spindlewatch.sources.feeds import Feeds
from spindlewatch.streaming import pair_segments, sinks, transforms
from spindlewatch.streaming.watermarks import together

FILES = 4
DELAY = "5 seconds"


@pytest.fixture(scope="module")
def folder(small, tmp_path_factory):
    """``events`` in four files, rows out of order by less than the watermark delay."""
    out = tmp_path_factory.mktemp("split")
    table = pq.read_table(f"{small}/events.parquet")
    rng = random.Random(5)
    order = sorted(range(table.num_rows), key=lambda i: i + rng.uniform(0, 14))
    step = table.num_rows // FILES
    for f in range(FILES):
        end = table.num_rows if f == FILES - 1 else (f + 1) * step
        path = out / f"events-{f}.parquet"
        pq.write_table(table.take(order[f * step : end]), path)
        os.utime(path, (time.time() - 100 + f * 10,) * 2)
    return str(out)


@pytest.fixture(scope="module")
def stream(spark, folder):
    return Feeds(spark, folder, streaming=True, files_per_trigger=1)


@pytest.fixture(scope="module")
def batch(spark, small):
    return Feeds(spark, small)


def table(df):
    df = plain(df)
    return rows_of(df.columns, df.collect())


def drained(df):
    return sinks.drain(df, shared_path(df.sparkSession, "test"))


def watermark(feeds, *frames):
    """Five seconds behind the newest record of any input, given as (frame, time column)."""
    newest = [df.agg(F.max(c)).first()[0] for df, c in frames]
    return F.lit(max(t for t in newest if t)) - F.expr("INTERVAL 5 SECONDS")


def test_windows_and_spikes(stream, batch):
    sensor = batch.sensor_raw()
    closed = F.col("window_end") <= watermark(batch, (sensor, "timestamp"))
    size, label = "20 seconds", "20s"
    got = drained(transforms.filled_window_stream(marked(stream.sensor_raw(), "timestamp"), size, label))
    want = windows.window_metrics(sensor, size, label).filter(closed)
    assert table(got.drop("previous_vib_rms")) == table(want)
    spikes = table(transforms.spike_stream(got))
    assert spikes and spikes == table(windows.vibration_spikes(want))


def test_interpolation(stream, batch):
    columns = ["temperature", "vibration_x", "current"]
    got = drained(transforms.interpolate_stream(marked(stream.sensor_raw(), "timestamp"), columns))
    limit = watermark(batch, (batch.sensor_raw(), "timestamp"))
    due = batch.sensor_raw().filter(F.col("timestamp") <= limit)
    assert table(got) and table(got) == table(windows.interpolate_gaps(due, columns, "seq", 1, 5))


def test_pairs(stream, batch):
    frames = timed(batch.device_state()), timed(batch.sensor_metrics())
    limit = watermark(batch, *[(f, "event_time") for f in frames])
    got = drained(
        transforms.pair_stream(
            timed(stream.device_state()), timed(stream.sensor_metrics()), "seq", "event_time", DELAY
        )
    )
    want = features.pair_latest(*frames, ["event_time", "seq"]).filter(
        F.col("event_time") <= limit
    )
    columns = ["seq", "machineId", "state.isAlarm", "state.duration_seconds", "metrics.total_parts"]
    assert table(got.select(*columns)) == table(want.select(*columns))


@pytest.mark.parametrize("seconds", [1, 20])
def test_pairs_by_segment(stream, batch, seconds):
    frames = timed(batch.device_state()), timed(batch.sensor_metrics())
    limit = watermark(batch, *[(f, "event_time") for f in frames])
    got = drained(
        pair_segments.pair_stream_by_segment(
            timed(stream.device_state()), timed(stream.sensor_metrics()), "seq", "event_time", f"{seconds} seconds", DELAY
        )
    )
    closed = F.window("event_time", f"{seconds} seconds")["end"] <= limit
    want = features.pair_latest(*frames, ["event_time", "seq"]).filter(closed)
    columns = ["seq", "machineId", "event_time", "state.isAlarm", "state.duration_seconds", "metrics.total_parts"]
    assert table(got) and table(got.select(*columns)) == table(want.select(*columns))


def test_status(stream, batch):
    sensor, changes = batch.sensor_raw(), batch.changes()
    limit = watermark(batch, (sensor, "timestamp"), (changes, "start_time"))
    got = drained(transforms.status_stream(stream.sensor_raw(), stream.changes(), delay=DELAY))
    want = status.machine_status(sensor, changes).filter(F.col("update_time") <= limit)
    assert table(got) == table(want)


def test_health(stream, batch):
    sensor, changes = batch.sensor_raw(), batch.changes()
    limit = watermark(batch, (sensor, "timestamp"), (changes, "start_time"))
    got = drained(
        transforms.health_stream(*together((stream.sensor_raw(), "timestamp"), (stream.changes(), "start_time")), 9)
    )
    want = status.throttled_health(sensor, changes, "seq", 9).filter(F.col("update_time") <= limit)
    assert table(got) == table(want)


@pytest.mark.parametrize("until", ["false", "start_time < timestamp '2024-01-01 00:02:00'"])
def test_a_silent_change_feed_holds_nothing_back(stream, batch, until):
    """No change at all, or none after a while: status and health are those of the batch operators."""
    sensor, changes = batch.sensor_raw(), batch.changes().filter(until)
    limit = watermark(batch, (sensor, "timestamp"), (changes, "start_time"))
    quiet = stream.changes().filter(until)
    got = table(drained(transforms.status_stream(stream.sensor_raw(), quiet, delay=DELAY)))
    assert got and got == table(status.machine_status(sensor, changes).filter(F.col("update_time") <= limit))
    got = drained(transforms.health_stream(*together((stream.sensor_raw(), "timestamp"), (quiet, "start_time")), 9))
    want = status.throttled_health(sensor, changes, "seq", 9).filter(F.col("update_time") <= limit)
    assert table(got) == table(want)


def test_a_silent_pairing_side_holds_nothing_back(stream, batch):
    until = "event_time < timestamp '2024-01-01 00:02:00'"
    state, metrics = timed(batch.device_state()), timed(batch.sensor_metrics()).filter(until)
    limit = watermark(batch, (state, "event_time"), (metrics, "event_time"))
    quiet = timed(stream.sensor_metrics()).filter(until)
    got = drained(transforms.pair_stream(timed(stream.device_state()), quiet, "seq", "event_time", DELAY))
    want = features.pair_latest(state, metrics, ["event_time", "seq"]).filter(
        F.col("event_time") <= limit
    )
    columns = ["seq", "machineId", "state.isAlarm", "metrics.total_parts"]
    assert table(got.select(*columns)) and table(got.select(*columns)) == table(want.select(*columns))
    inputs = timed(stream.device_state()), quiet, stream.highfreq_sensor()
    records = drained(transforms.feature_record_stream(*together(*[(rows, "event_time") for rows in inputs])))
    assert records.count() >= got.count()


def test_restart_continues_state(spark, stream, folder, tmp_path):
    """A query stopped after two of four files goes on where it was."""

    def throttled(feeds):
        rows = marked(feeds.sensor_raw(), "timestamp")
        return transforms.throttle_stream(rows, "timestamp", ["speed"], "seq", 9)

    part = tmp_path / "part"
    part.mkdir()
    names = sorted(os.listdir(folder))
    path = shared_path(spark, "restart")

    def run():
        feeds = Feeds(spark, str(part), streaming=True, files_per_trigger=1)
        return sinks.drain(throttled(feeds), path)

    for i, name in enumerate(names):
        os.link(os.path.join(folder, name), part / name)
        if i in (1, 3):
            out = run()
    whole = Feeds(spark, folder, streaming=True, files_per_trigger=1)
    assert table(out) == table(drained(throttled(whole)))


def test_late_rows_are_dropped_and_counted(spark, small, tmp_path):
    """Rows behind the watermark of an earlier micro-batch are left out of closed windows."""
    rows = pq.read_table(f"{small}/events.parquet")
    late = rows.slice(0, 50)
    # the watermark of a micro-batch filters from the one after the next
    for i, part in enumerate([rows.slice(500, 300), rows.slice(800), late]):
        path = tmp_path / f"events-{i}.parquet"
        pq.write_table(part, path)
        os.utime(path, (time.time() - 100 + i * 10,) * 2)
    feeds = Feeds(spark, str(tmp_path), streaming=True, files_per_trigger=1)
    metrics = windows.window_metrics(marked(feeds.sensor_raw(), "timestamp"))
    path = shared_path(spark, "late")
    q = sinks.start_append(metrics, f"{path}/table", f"{path}/checkpoint", {"availableNow": True})
    q.awaitTermination()
    dropped = sum(
        op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]
    )
    assert dropped > 0
    first = spark.read.parquet(f"{path}/table").agg(F.min("window_start")).first()[0]
    kept = Feeds(spark, small).sensor_raw("seq >= 500").agg(F.min("timestamp")).first()[0]
    assert first >= kept.replace(second=0, microsecond=0)


def test_upsert_replaces_and_repeats(spark, tmp_path):
    path = str(tmp_path / "lake")
    schema = "machine_id string, ts long, v double, seq long, day string"
    old = spark.createDataFrame([("1", 1, 1.0, 1, "a"), ("1", 2, 2.0, 2, "a"), ("2", 9, 3.0, 3, "b")], schema)
    new = spark.createDataFrame([("1", 2, 20.0, 5, "a"), ("1", 2, 10.0, 4, "a"), ("1", 3, 30.0, 6, "a")], schema)
    write = sinks.upsert_writer(path, ["machine_id", "ts"], ["seq"], "day")
    for batch_id, df in enumerate([old, new, new]):
        write(df, batch_id)
    got = {(r.machine_id, r.ts): r.v for r in spark.read.parquet(path).collect()}
    assert got == {("1", 1): 1.0, ("1", 2): 20.0, ("1", 3): 30.0, ("2", 9): 3.0}


def test_upsert_finishes_what_a_dead_run_began(spark, tmp_path, monkeypatch):
    """The run dies when old files are gone and the new ones are not in place; the replay loses nothing."""
    path = str(tmp_path / "lake")
    schema = "machine_id string, ts long, v double, seq long, day string, hour int"
    old = spark.createDataFrame([("1", 1, 1.0, 1, "a", 0), ("1", 2, 2.0, 2, "a", 1), ("2", 9, 3.0, 3, "a", 1)], schema)
    new = spark.createDataFrame([("1", 2, 20.0, 5, "a", 1)], schema)
    keys = ["machine_id", "ts"], ["seq"], sinks.HOURLY
    sinks.upsert_files(old, path, *keys)
    untouched = {f.name for f in (tmp_path / "lake" / "day=a" / "hour=0").iterdir()}

    def dies(batch, path, partition):
        shutil.rmtree(f"{path}/day=a/hour=1")
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_apply_staged", dies)
        with pytest.raises(RuntimeError, match="lost"):
            sinks.upsert_files(new, path, *keys)
    for _ in range(2):
        sinks.upsert_files(new, path, *keys)
        got = {(r.machine_id, r.ts): r.v for r in spark.read.parquet(path).collect()}
        assert got == {("1", 1): 1.0, ("1", 2): 20.0, ("2", 9): 3.0}
    assert {f.name for f in (tmp_path / "lake" / "day=a" / "hour=0").iterdir()} == untouched


def test_upsert_reads_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "lake")
    schema = "k string, seq long, day string"
    sinks.upsert_files(spark.createDataFrame([("1", 1, "a"), ("2", 1, "b")], schema), path, ["k"], ["seq"], "day")
    batch = spark.createDataFrame([("1", 2, "a")], schema)
    stored = spark.read.schema(batch.schema).parquet(path).filter(sinks.touched_partitions(batch, "day"))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert [r.k for r in stored.collect()] == ["1"]


def test_landing_keeps_the_lines_as_they_are(spark, tmp_path, batch):
    rows = batch.log_lines()
    writers = {
        "topic": sinks.batch_folder_writer(str(tmp_path / "topic")),
        "files": lambda b, i: sinks.batch_folder_writer(str(tmp_path / "files"), "text")(b.select("value"), i),
    }
    want = sorted(r.value for r in rows.collect())
    sinks.landing_writer("log", writers)(parse.tag_feed(rows, "log"), 0)
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "topic")).collect()) == want
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "files")).collect()) == want
    sinks.landing_writer("state", {"topic": writers["topic"]})(parse.tag_feed(rows, "state"), 1)
    assert spark.read.text(str(tmp_path / "files")).count() == len(want)


def test_landing_replay_overwrites(spark, tmp_path):
    lines = parse.tag_feed(spark.createDataFrame([("a",), ("b",)], "value string"), "log")
    write = sinks.fan_out(
        sinks.batch_folder_writer(str(tmp_path / "x")), sinks.batch_folder_writer(str(tmp_path / "y"), "json")
    )
    write(lines, 0)
    write(lines, 0)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 2
    assert spark.read.json(str(tmp_path / "y")).count() == 2


def test_connector_options(monkeypatch):
    from spindlewatch.sources import readers

    monkeypatch.setenv("SPINDLEWATCH_JDBC_USER", "u")
    options = sinks.jdbc_options("jdbc:x", "t", "d", 10)
    assert options == {"url": "jdbc:x", "dbtable": "t", "driver": "d", "batchsize": "10", "user": "u"}
    assert readers.kafka_options("b", "t", per_trigger=5)["maxOffsetsPerTrigger"] == "5"
    assert "WHEN MATCHED" in sinks.merge_statement("t", ["k"], ["k", "v"], "s")
