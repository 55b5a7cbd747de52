"""Ordered operators against plain Python, with segments and blocks small enough to matter."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spindlewatch.operators import asof, features, segments, status, windows

START = datetime.datetime(2026, 1, 1)


def pairing(events):
    """State machine: one waiting record per machine."""
    waiting, out = {}, []
    for machine, seq, side in events:
        held = waiting.get(machine)
        if held and held[1] != side:
            ids = {side: seq, held[1]: held[0]}
            out.append((machine, seq, ids[0], ids[1]))
            del waiting[machine]
        else:
            waiting[machine] = (seq, side)
    return sorted(out)


@pytest.mark.parametrize("span", [1, 3, 7, 50, 10_000])
@pytest.mark.parametrize("kind", ["random", "alternating", "long runs"])
def test_pairs(spark, span, kind):
    rng = random.Random(f"{span}{kind}")
    events, last = [], defaultdict(int)
    for seq in range(400):
        machine = rng.choice([1, 1, 1, 2, 3])
        if kind == "random":
            side = rng.randint(0, 1)
        else:
            flip = 0.97 if kind == "alternating" else 0.2
            side = last[machine] ^ (rng.random() < flip)
        last[machine] = side
        events.append((machine, seq, int(side)))
    df = spark.createDataFrame(events, "machineId int, seq long, side int").repartition(5)
    state = df.filter("side = 0").select("machineId", "seq", F.col("seq").alias("s"))
    metrics = df.filter("side = 1").select("machineId", "seq", F.col("seq").alias("m"))
    got = features.pair_latest(state, metrics, "seq", span).select(
        "machineId", "seq", "state.s", "metrics.m"
    )
    assert sorted(tuple(r) for r in got.collect()) == pairing(events)


@pytest.mark.parametrize("span", [1, 10, 3600])
def test_pairs_of_feeds_with_numbers_of_their_own(spark, span):
    """Each feed counts from one, times tie within and across feeds: time, side, number is the order."""
    rng = random.Random(span)
    events, counts, now = [], defaultdict(int), 0.0
    for _ in range(300):
        now += rng.choice([0, 0, 0.4, 3, 40])
        side = rng.randint(0, 1)
        counts[side] += 1
        events.append((rng.choice([1, 1, 2]), START + datetime.timedelta(seconds=now), side, counts[side]))
    df = spark.createDataFrame(events, "machineId int, t timestamp, side int, seq long").repartition(5)
    feed = [df.filter(f"side = {k}").select("machineId", "t", "seq", F.col("seq").alias("n")) for k in (0, 1)]
    got = features.pair_latest(*feed, ["t", "seq"], span).select("machineId", "t", "state.n", F.col("metrics.n").alias("m"))
    waiting, want = {}, []
    for machine, t, side, n in sorted(events):
        held = waiting.pop(machine, None)
        if held and held[0] != side:
            want.append((machine, t, *((n, held[1]) if side == 0 else (held[1], n))))
        else:
            waiting[machine] = (side, n)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("span", [1, 4, 13, 1000])
def test_running_sums_and_trailing_means(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice([1, 1, 1, 2]), seq, rng.uniform(0, 9)) for seq in range(200) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k int, seq long, x double").repartition(4)
    sums = segments.running_sums(df, ["k"], "seq", {"total": F.col("x")}, span)
    means = segments.trailing_means(df, ["k"], "seq", {"mean": "x"}, 10, span)
    got_sum = {(r.k, r.seq): r.total for r in sums.collect()}
    got_mean = {(r.k, r.seq): r.mean for r in means.collect()}
    seen = defaultdict(list)
    assert len(got_sum) == len(got_mean) == len(rows)
    for k, seq, x in rows:
        seen[k].append(x)
        assert got_sum[k, seq] == pytest.approx(sum(seen[k]))
        last = seen[k][-10:]
        assert got_mean[k, seq] == pytest.approx(sum(last) / len(last))


@pytest.mark.parametrize("span", [1, 5, 64, 1000])
def test_drop_late(spark, span):
    rng = random.Random(span)
    rows = [(i, START + datetime.timedelta(seconds=i + rng.randint(-60, 30))) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, t timestamp").repartition(4)
    got = {r.seq for r in windows.drop_late(df, "t", "seq", 30, span).collect()}
    newest, want = None, set()
    for seq, t in rows:
        if newest is None or t >= newest - datetime.timedelta(seconds=30):
            want.add(seq)
        newest = t if newest is None else max(newest, t)
    assert got == want


@pytest.mark.parametrize(("cell", "block"), [(1, 3), (1, asof.BLOCK), (7, 1), (60, 3), (60, asof.BLOCK), (100_000, 1)])
def test_asof(spark, monkeypatch, cell, block):
    monkeypatch.setattr(asof, "BLOCK", block)
    rng = random.Random(cell)

    def times(n):
        return [(rng.choice(["a", "a", "b", "c"]), i, START + datetime.timedelta(
            milliseconds=rng.randint(0, 300) * 500)) for i in range(n)]

    left, right = times(150), [(k, i, t, f"v{i}") for k, i, t in times(40) if k != "c"]
    got = asof.asof_left(
        spark.createDataFrame(left, "k string, i int, t timestamp"),
        spark.createDataFrame(right, "k string, seq int, at timestamp, v string"),
        "k", "t", "at", ["v"], "seq", cell,
    )
    want = {}
    for k, i, t in left:
        before = [(at, seq, v) for rk, seq, at, v in right if rk == k and at <= t]
        want[i] = max(before)[2] if before else None
    assert {r.i: r.v for r in got.collect()} == want


def test_asof_with_a_million_changes_in_a_minute(spark):
    """One key, one minute: sorted like other rows, with no list in a cell."""
    right = spark.range(1_000_000).selectExpr(
        "'a' AS k", "id AS seq", "timestamp_micros(1704067200000000 + id * 60) AS at", "id AS v"
    )
    left = spark.range(0, 200_000).selectExpr("'a' AS k", "id AS i", "timestamp_micros(1704067200000000 + id * 300 + 7) AS t")
    found = asof.asof_left(left, right, "k", "t", "at", ["v"], "seq")
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    assert found.filter("v = i * 5").count() == 200_000


@pytest.mark.parametrize(("interval", "fan"), [(1, 24), (2, 24), (9, 1), (59, 2), (60, 24), (60, 1), (61, 2), (90, 24), (400, 2), (5000, 1)])
def test_throttle(spark, monkeypatch, interval, fan):
    monkeypatch.setattr(status, "FAN", fan)
    rng = random.Random(interval)
    rows, now = [], defaultdict(float)
    for seq in range(600):
        m = rng.choice(["1", "1", "2"])
        now[m] += rng.choice([0.2, 0.2, 3, 10, 59.5, 130])
        rows.append((m, seq, START + datetime.timedelta(seconds=round(now[m], 3)), "x", float(seq)))
    df = spark.createDataFrame(
        rows, "machine_id string, seq long, update_time timestamp, machine_status string, health_score double"
    ).repartition(4)
    out = status.throttled_rows(df, "update_time", "seq", interval)
    got = {(r.machine_id, r.health_score) for r in out.collect()}
    last, want = {}, set()
    for m, seq, t, _, _ in rows:
        second = int((t - START).total_seconds())
        if m not in last or second - last[m] >= interval:
            last[m] = second
            want.add((m, float(seq)))
    assert got == want


def test_fill_chains(spark):
    ends = [0, 3, 6, 7, 20, 25, 31]
    rows = [("1", START + datetime.timedelta(seconds=e), float(e), float(e), float(e), 1.0) for e in ends]
    df = spark.createDataFrame(
        rows,
        "machine_id string, window_end timestamp, max_temperature double, avg_vib_rms double, "
        "current_fluctuation double, temp_slope double",
    )
    got = windows.fill_held(df).orderBy("window_end").collect()
    assert [r.avg_vib_rms for r in got] == [0, 0, 0, 7, 20, 20, 31]
    assert [r.filled for r in got] == [False, True, True, False, False, True, False]


@pytest.mark.parametrize("block", [3, 10, 3600])
def test_interpolation(spark, block):
    rng = random.Random(block)
    rows, now = [], 0
    for seq in range(200):
        now += rng.choice([0, 100, 900, 1000, 1001, 2500, 4000, 5000, 5001, 9000])
        rows.append(("1", seq, START + datetime.timedelta(milliseconds=now), rng.uniform(0, 9)))
    df = spark.createDataFrame(rows, "machine_id string, seq long, timestamp timestamp, x double").repartition(3)
    got = windows.interpolate_gaps(df, ["x"], "seq", 1, 5, block).orderBy("timestamp").collect()
    want = []
    for (_, _, t0, x0), (_, _, t1, x1) in zip(rows, rows[1:], strict=False):
        gap = (t1 - t0).total_seconds()
        if 1 < gap <= 5:
            k = 1
            while k < gap:
                want.append((t0 + datetime.timedelta(seconds=k), x0 + (x1 - x0) * k / gap))
                k += 1
    assert [r.timestamp for r in got] == [t for t, _ in want]
    assert [r.x for r in got] == pytest.approx([x for _, x in want])
