"""The jobs end to end, over file streams and file sinks."""

import pytest
from pyspark.sql import functions as F

from spindlewatch.config import PREFIX, Settings
from spindlewatch.operators import cleaner, features, latest, scoring
from spindlewatch.plans import jobs
from spindlewatch.plans.registry import timed
from spindlewatch.session import shared_path
from spindlewatch.sources.feeds import Feeds
from spindlewatch.streaming import sinks

ONCE = {"availableNow": True}


@pytest.fixture(scope="module")
def stream(spark, small):
    return Feeds(spark, small, streaming=True)


def test_realtime_engine(spark, stream, small):
    out = shared_path(spark, "realtime")
    by_key = {"sensor_detail_realtime", "device_log_realtime"}
    writers = {
        name: sinks.upsert_writer(f"{out}/{name}", ["machine_id", "ts"], ["seq"], sinks.HOURLY)
        if name in by_key
        else sinks.batch_folder_writer(f"{out}/{name}")
        for name in jobs.REALTIME_OUTPUTS
    }
    for name, order in (("change_record_status", ["start_time", "seq"]), ("device_health", ["update_time"])):
        writers[name] = sinks.keyed_store_writer(f"{out}/{name}", "machine_id", order)
    queries = jobs.start_realtime_engine(
        stream.sensor_raw(), stream.log_raw(), stream.changes(), stream.standards(), writers, f"{out}/checkpoints", trigger=ONCE,
    )
    for q in queries:
        q.awaitTermination()
        assert q.exception() is None
    rows = {name: spark.read.parquet(f"{out}/{name}") for name in writers}
    assert {name for name, df in rows.items() if df.isEmpty()} == set()
    assert rows["realtime_alerts"].count() == rows["alert_topic"].count()
    assert rows["sensor_detail_realtime"].count() == 1000
    assert "insert_time" in rows["realtime_alerts"].columns
    for name, (columns, _) in sinks.STATUS_TABLES.items():
        assert set(columns) <= set(rows[name].columns)
    for name in ("change_record_status", "device_health"):
        assert rows[name].count() == rows[name].select("machine_id").distinct().count()
    want = latest.last_value_by_key(
        Feeds(spark, small).changes(), "machine_id", "status", ["start_time", "seq"]
    )
    got = rows["change_record_status"].select("machine_id", "status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="no such outputs"):
        jobs.start_realtime_engine(*[stream.sensor_raw()] * 4, {"x": None}, out)


def test_feature_engine(spark, stream):
    out = shared_path(spark, "features")
    jobs.start_feature_engine(
        timed(stream.device_state()), timed(stream.sensor_metrics()), stream.highfreq_sensor(),
        sinks.batch_folder_writer(f"{out}/topic"), f"{out}/checkpoints", ONCE,
    ).awaitTermination()
    lines = spark.read.parquet(f"{out}/topic")
    assert lines.count() > 0
    assert lines.select(F.size(F.json_object_keys("value"))).distinct().collect() == [(22,)]


def test_cleaner_job_on_samples(spark):
    paths = jobs.run_cleaner(jobs.cleaner_samples(spark), shared_path(spark, "cleaned"))
    assert set(paths) == set(cleaner.OUTPUTS)
    state = spark.read.csv(paths["device_state_csv"], header=True).orderBy("record_id").collect()
    assert [(r.isRunning, r.isStandby, r.isAlarm, r.isOffline) for r in state] == [
        ("1.0", "0.0", "0.0", "0.0"), ("0.0", "1.0", "0.0", "0.0"),
        ("0.0", "0.0", "1.0", "0.0"), ("0.0", "0.0", "0.0", "1.0"),
    ]
    assert spark.read.json(paths["json_backup"]).count() == 4


def test_settings_from_session(spark):
    values = {
        "temperature_threshold": "75.5", "interpolation_max_gap_seconds": "x", "alert_codes": "999, 500",
        "alert_topic": "other",
    }
    try:
        for name, text in values.items():
            spark.conf.set(PREFIX + name, text)
        s = Settings.from_spark(spark)
    finally:
        for name in values:
            spark.conf.unset(PREFIX + name)
    assert (s.temperature_threshold, s.alert_codes, s.alert_topic) == (75.5, ("999", "500"), "other")
    # text that is no number leaves the default
    assert s.interpolation_max_gap_seconds == 5


def test_scoring_job(spark, small):
    feeds = Feeds(spark, small)
    windowed = features.window_features(feeds.highfreq_sensor())
    labelled = scoring.hours_to_next_failure(windowed, feeds.log_raw(), hour_seconds=0.1)
    models = shared_path(spark, "models")
    scoring.save_model(scoring.fit_rul(labelled), f"{models}/rul")
    scoring.save_model(scoring.fit_failure(labelled, 100.0), f"{models}/failure")
    paths = jobs.run_scoring(windowed, feeds.sensor_raw(), feeds.changes(), models, shared_path(spark, "scores"), 130.0)
    rows = spark.read.parquet(paths["rul_scores"]).collect()
    stable = scoring.in_stable_state(windowed, feeds.sensor_raw(), feeds.changes())
    assert sorted((r.machineId, r.window_start) for r in rows) == sorted(
        map(tuple, stable.select("machineId", "window_start").collect())
    )
    assert all(0 <= r.failure_probability <= 1 and r.rul_value >= 0 for r in rows)
    due = [r for r in rows if r.rul_value < 130 or r.failure_probability > 0.85]
    assert spark.read.parquet(paths["rul_alerts"]).count() == len(due)
