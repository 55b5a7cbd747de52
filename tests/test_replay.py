"""Replay of keyed state on a store kept in a dictionary: what is held and given out at once stays small, in any order of the input."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spindlewatch.plans.registry import timed
from spindlewatch.session import shared_path
from spindlewatch.sources.feeds import Feeds
from spindlewatch.streaming import pair_segments, sinks, transforms
from spindlewatch.streaming import processors as p
from spindlewatch.streaming.watermarks import together

N = 30_000
SECOND = 1_000_000


class Map(dict):
    containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.__delitem__
    updateValue = dict.__setitem__


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def rows(us, payload, **more):
    return pd.DataFrame({
        p.US: us, p.RANK: np.zeros(len(us), np.int64), p.SIDE: np.zeros(len(us), np.int8), p.PAYLOAD: np.array(payload, object), **more,
    })


def replayed(processor, frame, watermarks):
    """Frames given out when ``frame`` arrives in random order before the watermark moves, and the largest fold."""
    handle, folded, inner = Handle(), [0], processor.fold

    def fold(memory, us, *columns):
        folded.append(len(us))
        return inner(memory, us, *columns)

    processor.fold = fold
    processor.init(handle)
    frame = frame.sample(frac=1, random_state=1)
    parts = (frame.iloc[i : i + 1000] for i in range(0, len(frame), 1000))
    out = list(processor.handleInputRows(("m",), parts, At(0)))
    for ms in watermarks:
        out += processor.handleExpiredTimer(("m",), At(ms), None)
    return out, max(folded)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(p, "HELD_ROWS", 5000)
    monkeypatch.setattr(p, "FOLD_ROWS", 1000)
    monkeypatch.setattr(p, "VECTOR_CHUNK", 20)


ENDS = [N * 400, N * 1000 + 1]


def test_gap_fill_gives_bounded_frames(small):
    us = np.arange(1, N + 1) * SECOND
    us[us // SECOND % 10 == 5] -= 1
    keep = us // SECOND % 7 != 3
    us = us[keep]
    frame = rows(us, [f"r{x}" for x in us])
    out, most = replayed(p.HoldAndSpike(["k"], 1, 5), frame, ENDS)
    assert most < 4000 and max(map(len, out)) < 4000
    found = pd.concat(out)
    held, last, before = {}, None, []
    for x in us.tolist():
        fills = last is not None and 1 < (x - last) // SECOND <= 5
        before.append(held.get(last))
        held[x] = held[last] if fills else f"r{x}"
        last = x
    assert found["left"].tolist() == [f"r{x}" for x in us]
    assert found["right"].tolist() == [held[x] for x in us.tolist()]
    assert found["before"].tolist() == before


def test_interpolation_gives_bounded_frames(small):
    at = np.cumsum(np.resize([1, 3, 2, 7, 1], N)) * SECOND
    value = np.sin(np.arange(N))
    frame = rows(at, [""] * N, at_us=at, v=value)
    out, most = replayed(p.Interpolate(["k"], ["v"], SECOND, 5 * SECOND), frame, [at[N // 3] // 1000, at[-1] // 1000])
    assert most < 4000 and max(map(len, out)) < 8000
    expected = [
        (x, a + (b - a) * ((x - s) / (e - s)))
        for s, e, a, b in zip(at[:-1].tolist(), at[1:].tolist(), value[:-1].tolist(), value[1:].tolist(), strict=True)
        if SECOND < e - s <= 5 * SECOND for x in range(s + SECOND, e, SECOND)
    ]
    found = pd.concat(out)
    assert list(zip(found["us"].tolist(), found["v"].tolist(), strict=True)) == expected


def test_segments_are_chained_in_bounded_frames(small):
    us = np.arange(1, N + 1) * SECOND
    text = np.array([str(i) for i in range(N)], object)
    # every segment is one record of side 0: it waits, and replaces the one that waited
    ones = {"a_side": np.zeros(N, np.int64), "b_side": np.full(N, -1), "a_held": text, "b_held": np.full(N, None, object)}
    pairs = {"a_pairs": np.full(N, "a", object), "b_pairs": np.full(N, "b", object)}
    frame = rows(us, text, first_us=us, **ones, **pairs)
    frame.loc[frame.index % 3 == 2, p.SIDE] = 1
    out, most = replayed(pair_segments.ChainSegments(["k"]), frame, ENDS)
    assert most < 4000 and max(map(len, out)) < 4000
    found = pd.concat(out)
    consumed, memory, waited = [], None, []
    for i, side in enumerate(frame[p.SIDE].tolist()):
        met = memory is not None and memory[0] != side
        consumed.append("b" if met else "a")
        waited.append(memory[1] if met else None)
        memory = None if met else (0, str(i))
    assert found["pairs"].tolist() == consumed
    assert found["waited"].tolist() == waited


def test_long_texts_are_put_away_early(monkeypatch):
    monkeypatch.setattr(p, "HELD_TEXT", 10_000)
    processor = p.LatestValue(["k"])
    stored = []
    monkeypatch.setattr(processor, "_store", lambda parts: stored.append(sum(len(x[0]) for x in parts)))
    processor.init(Handle())
    frames = [rows(np.arange(10) * SECOND, ["x" * 900] * 10) for _ in range(6)]
    list(processor.handleInputRows(("m",), iter(frames), At(0)))
    assert max(stored) <= 20 and sum(stored) == 60


def test_lookups_do_not_copy_the_right_side(spark, small_folder):
    feeds = Feeds(spark, small_folder, streaming=True)
    marked = together((feeds.sensor_raw(), "timestamp"), (feeds.changes(), "start_time"))
    for found in (transforms.status_stream(feeds.sensor_raw(), feeds.changes(), delay="5 seconds"), transforms.health_stream(*marked)):
        plan = found._jdf.queryExecution().analyzed().toString()
        assert "TransformWithState" in plan and "Generate" not in plan


@pytest.fixture
def small_folder():
    return "/root/testdata/sf0.001"


def test_segments_without_machine_are_one_chain(spark, small_folder, tmp_path):
    events = pq.read_table(f"{small_folder}/events.parquet")
    users = [None if i % 3 == 0 else 5 for i in range(events.num_rows)]
    events = events.set_column(events.schema.get_field_index("user_id"), "user_id", pa.array(users, pa.int64()))
    pq.write_table(events, tmp_path / "events.parquet")

    def pairs_of(expression):
        feeds = Feeds(spark, str(tmp_path), streaming=True)
        sides = [timed(x).withColumn("machineId", F.expr(expression)) for x in (feeds.device_state(), feeds.sensor_metrics())]
        found = pair_segments.pair_stream_by_segment(*sides, "seq", "event_time", "10 seconds", "5 seconds")
        return sorted(r[0] for r in sinks.drain(found, shared_path(spark, "test")).filter(F.coalesce("machineId", F.lit(0)) == 0).select("seq").collect())

    assert pairs_of("machineId") == pairs_of("coalesce(machineId, 0)") != []
