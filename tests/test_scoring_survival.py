"""Survival curves, isotonic calibration, cumulative sums, merging and late rows against plain versions."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spindlewatch.operators import latest, surges, survival
from spindlewatch.schemas import WINDOW_FEATURES
from spindlewatch.session import shared_path
from spindlewatch.streaming import late

START = datetime.datetime(2024, 1, 1)


def test_no_window_is_dropped(spark):
    rows = [(1, START + datetime.timedelta(minutes=i), START + datetime.timedelta(minutes=i + 1), *[0.0] * 7) for i in range(10)]
    kinds = "machineId int, window_start timestamp, window_end timestamp, " + ", ".join(f"{c} double" for c in WINDOW_FEATURES)
    features = spark.createDataFrame(rows, kinds)
    log = spark.createDataFrame(
        [("1", "999", START + datetime.timedelta(minutes=5, seconds=30)), ("1", "200", START + datetime.timedelta(minutes=12))],
        "machine_id string, error_code string, timestamp timestamp",
    )
    lives = {r.window_start.minute: (round(r.life_hours * 60, 6), r.failed) for r in survival.observed_lives(features, log).collect()}
    assert lives == {i: (4.5 - i, True) if i < 5 else (11.0 - i, False) for i in range(10)}


def test_survival_curve(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.random() * 50, rng.random() < 0.6) for _ in range(300)] + [("c", 3.0, True), ("c", 2.0, True)]
    got = survival.survival_curve(spark.createDataFrame(rows, "g string, life_hours double, failed boolean"), F.col("g"), 2.0).collect()
    for g in "abc":
        left, s, want = sum(r[0] == g for r in rows), 1.0, []
        for t in sorted({math.floor(r[1] / 2) * 2 for r in rows if r[0] == g}):
            here = [r for r in rows if r[0] == g and math.floor(r[1] / 2) * 2 == t]
            d = sum(r[2] for r in here)
            s *= 1 - d / left
            want.append((t, left, d, len(here) - d, s))
            left -= len(here)
        mine = sorted((r.after_hours, r.at_risk, r.failures, r.censored, r.survival) for r in got if r.grp == g)
        assert [m[:4] for m in mine] == [w[:4] for w in want]
        assert [m[4] for m in mine] == pytest.approx([w[4] for w in want], abs=1e-9)


def pooled(values, weights):
    """Isotonic fit by pooling adjacent violators."""
    blocks = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [b[0] / b[1] for b in blocks for _ in range(b[2])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_calibration_pools_adjacent_violators(spark, seed):
    rng = random.Random(seed)
    rows = [(p, rng.random() < p * p) for p in (rng.random() for _ in range(150))] + [(1.0, True), (0.0, False)]
    df = spark.createDataFrame(rows, "p double, f boolean")
    table = sorted(survival.reliability(df, "p", F.col("f"), 16).collect())
    assert [r.calibrated for r in table] == pytest.approx(pooled([r.failures / r.n for r in table], [r.n for r in table]))
    known = {r.bin: r.calibrated for r in table}
    fitted = survival.with_calibrated(df, spark.createDataFrame(table), "p", "q", 16)
    assert all(r.q == known[min(int(r.p * 16), 15)] for r in fitted.collect())
    before, after = fitted.agg(survival.brier(df, "p", F.col("f")), survival.brier(df, "q", F.col("f"))).first()
    assert after < before
    assert survival.reliability(df.limit(0), "p", F.col("f")).count() == 0


def test_lives_can_be_fitted(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        x = [rng.random() for _ in WINDOW_FEATURES]
        life = math.exp(2 * x[0]) * (0.5 + rng.random())
        rows.append((START + datetime.timedelta(minutes=i), min(life, 4.0), life < 4.0, *x))
    kinds = "window_start timestamp, life_hours double, failed boolean, " + ", ".join(f"{c} double" for c in WINDOW_FEATURES)
    df = spark.createDataFrame(rows, kinds)
    scored = survival.fit_lives(df).transform(df)
    assert scored.stat.corr("rul_value", WINDOW_FEATURES[0]) > 0.8


def test_cusum(spark):
    rng = random.Random(5)
    counts = {"a": [rng.choice([0, 0, 2, 3]) for _ in range(80)], "b": [0] * 80}
    counts["a"][40:46] = [9, 9, 8, 0, 9, 9]
    counts["b"][0] = counts["b"][79] = 1
    rows = [(c, START + datetime.timedelta(minutes=m, seconds=rng.randint(0, 59))) for c in counts for m, n in enumerate(counts[c]) for _ in range(n)]
    found = surges.cusum_surges(spark.createDataFrame(rows, "error_code string, timestamp timestamp"), 60).collect()
    want = []
    for code, series in counts.items():
        mean = sum(series) / 80
        s, began = 0.0, 0
        for m, n in enumerate(series):
            if s <= 1e-12:
                began = m
            s = max(0.0, s + n - mean - 0.5 * math.sqrt(mean))
            if n and s > 4 * math.sqrt(mean):
                want.append((code, m, n, round(s, 6), began))
    got = sorted(
        (r.error_code, (r.window_start - START).seconds // 60, r.n, round(r.score, 6), (r.began - START).seconds // 60) for r in found
    )
    assert got == sorted(want) and got


def test_merge_moves_only_what_overlaps(spark):
    offline = spark.range(1000).selectExpr("cast(id % 7 as string) AS k", "id AS ts", "'old' AS v", "id AS seq")
    realtime = spark.createDataFrame([("1", 995 + i % 2 * 4, "new", 5000 + i) for i in range(4)] + [("x", 999, "new", 1)], "k string, ts bigint, v string, seq bigint")
    merged = latest.merge_offline_realtime(offline, realtime, ["k", "ts"], ["seq"], "ts")
    rows = {(r.k, r.ts): (r.v, r.source, r.seq) for r in merged.collect()}
    want = {(str(i % 7), i): ("old", "offline", i) for i in range(1000)}
    want |= {("1", 995): ("new", "realtime", 5002), ("1", 999): ("new", "realtime", 5003), ("x", 999): ("new", "realtime", 1)}
    assert rows == want and merged.count() == len(want)
    # the branch of offline rows outside the span of realtime times: from the union straight to the scan
    branches = re.split("\n[:+]- ", merged._jdf.queryExecution().optimizedPlan().toString())
    straight = [part for part in branches if "NOT coalesce" in part]
    assert len(straight) == 1 and "Join" not in straight[0] and "Window" not in straight[0] and "Range" in straight[0]


def test_late_rows_are_kept(spark):
    path = shared_path(spark, "late-test")
    write = late.late_router(path, "sensor", "t", 10)
    batches = [[0, 5, 50], [45, 39, 60, 100], [None, 89, 90, 3]]
    for _ in range(2):  # a replay changes nothing
        for i, seconds in enumerate(batches):
            rows = [(s, None if s is None else START + datetime.timedelta(seconds=s)) for s in seconds]
            write(spark.createDataFrame(rows, "s int, t timestamp"), i)
    found = {name: sorted(r.s if r.s is not None else -1 for r in spark.read.parquet(f"{path}/{name}").collect()) for name in (late.ON_TIME, late.LATE)}
    assert found == {late.ON_TIME: [-1, 0, 5, 45, 50, 60, 90, 100], late.LATE: [3, 39, 89]}
    counted = late.late_counts(spark.read.parquet(f"{path}/{late.LATE}"), "t").collect()
    assert sum(r.n for r in counted) == 3
