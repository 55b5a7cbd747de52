"""Deviation episodes, batch and stream, against a plain walk over each machine's readings."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from spindlewatch.operators import episodes
from spindlewatch.sources.feeds import Feeds
from spindlewatch.operators import deviation
from spindlewatch.streaming import episode_stream, sinks
from spindlewatch.session import shared_path

START = datetime.datetime(2024, 1, 1)
SCHEMA = (
    "machine_id string, seq bigint, timestamp timestamp, current double, std_current double, current_dev double, "
    "speed double, std_speed double, speed_dev double"
)


def walk(rows, threshold, least, gap):
    """(machine, param, start, end, maxima, n, open) of each episode."""
    out = []
    for param, at in (("current", 3), ("speed", 6)):
        by_machine = {}
        for r in sorted(rows, key=lambda r: (r[2], r[1])):
            by_machine.setdefault(r[0], []).append(r)
        for machine, readings in by_machine.items():
            run = []

            def close(still_open, run=run, machine=machine, param=param, at=at):
                if run and (run[-1][2] - run[0][2]).total_seconds() >= least:
                    tops = tuple(max(r[at + i] for r in run) for i in range(3))
                    out.append((machine, param, run[0][2], run[-1][2], *tops, len(run), still_open))
                run.clear()

            for r in readings:
                over = r[at + 2] is not None and r[at + 2] > threshold
                if run and (not over or (gap is not None and (r[2] - run[-1][2]).total_seconds() > gap)):
                    close(False)
                if over:
                    run.append(r)
            close(True)
    return sorted(out)


def readings(seed, n=400):
    rng = random.Random(seed)
    rows, now, dev = [], {"a": 0.0, "b": 0.0, "c": 0.0}, {}
    for seq in range(n):
        m = rng.choice("aaab")
        now[m] += rng.choice([0, 0.5, 1, 2, 7])
        if rng.random() < 0.15 or m not in dev:
            dev[m] = rng.choice([0.0, 0.3, 0.3])
        speed = rng.choice([None, 0.05, 0.4, 0.4, 0.4])
        current_dev = dev[m] + rng.random() * 0.01
        rows.append((m, seq, START + datetime.timedelta(seconds=now[m]), 30 + current_dev, 30.0, current_dev, 9.0, 10.0, speed))
    return rows


def result(df):
    return sorted(
        (r.machine_id, r.param_name, r.record_time, r.end_time, r.actual_value, r.standard_value, r.deviation_ratio / 100, r.n_readings, r.still_open)
        for r in df.collect()
    )


@pytest.mark.parametrize("span", [1, 7, 100, 100_000])
@pytest.mark.parametrize("gap", [None, 3])
def test_episodes_do_not_depend_on_segments(spark, span, gap):
    rows = readings(span)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = result(episodes.deviation_episodes(df, 0.1, 4, gap, span))
    want = walk(rows, 0.1, 4, gap)
    assert [g[:4] + g[7:] for g in got] == [w[:4] + w[7:] for w in want] and want
    assert all(g[4:7] == pytest.approx(w[4:7]) for g, w in zip(got, want, strict=True))


def test_an_episode_across_a_window_boundary(spark):
    """40 seconds over the minute's end: a window of 30 seconds never sees them whole."""
    rows = [
        ("m", i, START + datetime.timedelta(seconds=i), 0.0, 1.0, 0.5 if 38 <= i <= 78 else 0.0, 0.0, 1.0, 0.0) for i in range(120)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    (found,) = episodes.deviation_episodes(df, 0.1, 30).collect()
    assert found.duration_seconds == 40 and found.record_time == START + datetime.timedelta(seconds=38) and not found.still_open
    assert deviation.sustained_deviation(df, 0.1).count() == 0
    assert episodes.deviation_episodes(df.limit(0), 0.1, 30).count() == 0


def test_stream_gives_the_ended_episodes_of_the_batch(spark, small):
    def deviations(feeds, mark):
        rows = feeds.sensor_raw()
        rows = rows.withWatermark("timestamp", "5 seconds") if mark else rows
        return deviation.with_deviation(deviation.with_standards(rows, feeds.standards()))

    streamed = sinks.drain(
        episode_stream.episode_stream(deviations(Feeds(spark, small, streaming=True), True), 0.05, 6, 5, "4 seconds"),
        shared_path(spark, "episodes-test"),
    )
    batch = deviations(Feeds(spark, small), False)
    last = batch.agg(F.max("timestamp")).first()[0] - datetime.timedelta(seconds=5)
    closed = batch.filter(F.window("timestamp", "4 seconds")["end"] <= F.lit(last))
    want = result(episodes.deviation_episodes(closed, 0.05, 6, 5).filter("not still_open"))
    assert result(streamed.filter("not still_open")) == want and want
    early = {(r.machine_id, r.param_name, r.record_time) for r in streamed.filter("still_open").collect()}
    ended = {(r[0], r[1], r[2]) for r in want}
    assert len(early) == streamed.filter("still_open").count() and early & ended
