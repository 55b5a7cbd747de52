"""Every registered batch query: name -> callable(spark, folder) -> DataFrame.

Streaming queries are in ``stream_registry``; the checks in DuckDB SQL are in ``checks``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewatch import schemas
from spindlewatch.config import Settings
from spindlewatch.functions import columns as fn
from spindlewatch.operators import (
    alerts,
    cleaner,
    deviation,
    episodes,
    features,
    latest,
    log_patterns,
    parse,
    scoring,
    status,
    surges,
    survival,
    windows,
)
from spindlewatch.session import configure, shared_path
from spindlewatch.sources.feeds import Feeds
from spindlewatch.sources import fixture_exprs as fx

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6

_QUERIES: dict[str, Query] = {}


def plain(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Comparable form: doubles rounded, timestamps without zone."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(build: Callable[[Feeds], DataFrame]) -> Callable[[Feeds], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(build(Feeds(configure(spark), folder)))

    run.__doc__ = build.__doc__
    _QUERIES[build.__name__] = run
    return build


def settings(feeds: Feeds) -> Settings:
    return Settings.from_spark(feeds.spark)


# --- parsing ------------------------------------------------------------------------------------


@query
def parse_sensor_json(feeds: Feeds) -> DataFrame:
    return parse.parse_sensor_raw(feeds.sensor_lines())


@query
def parse_log_json(feeds: Feeds) -> DataFrame:
    return parse.parse_log_raw(feeds.log_lines())


@query
def parse_change_csv(feeds: Feeds) -> DataFrame:
    return parse.parse_change_record(feeds.change_lines())


@query
def parse_device_state_json(feeds: Feeds) -> DataFrame:
    return parse.parse_device_state(feeds.device_state_lines())


@query
def parse_sensor_metrics_json(feeds: Feeds) -> DataFrame:
    return parse.parse_sensor_metrics(feeds.sensor_metrics_lines())


@query
def parse_highfreq_json(feeds: Feeds) -> DataFrame:
    return parse.parse_highfreq_sensor(feeds.highfreq_lines())


@query
def quarantine(feeds: Feeds) -> DataFrame:
    """Unreadable lines of all JSON feeds, tagged with their feed."""
    inputs = [
        ("sensor", feeds.sensor_lines(), schemas.SENSOR_RAW),
        ("log", feeds.log_lines(), schemas.LOG_RAW),
        ("state", feeds.device_state_lines(), schemas.DEVICE_STATE),
        ("metrics", feeds.sensor_metrics_lines(), schemas.SENSOR_METRICS),
        ("highfreq", feeds.highfreq_lines(), schemas.HIGHFREQ_SENSOR),
    ]
    tagged = [parse.tag_feed(parse.quarantine(df, s), name) for name, df, s in inputs]
    return alerts.all_alerts(*tagged).select("seq", "topic_type", F.length("value").alias("n_chars"))


# --- alerts and logs ----------------------------------------------------------------------------


def _sensor_alerts(feeds: Feeds) -> DataFrame:
    s = settings(feeds)
    return alerts.sensor_alerts(
        feeds.sensor_raw(), s.temperature_threshold, s.vibration_threshold
    )


@query
def sensor_alerts(feeds: Feeds) -> DataFrame:
    return _sensor_alerts(feeds)


@query
def log_alerts(feeds: Feeds) -> DataFrame:
    return alerts.log_alerts(feeds.log_raw(), settings(feeds).alert_codes)


@query
def log_alerts_both_codes(feeds: Feeds) -> DataFrame:
    return alerts.log_alerts(feeds.log_raw(), ("999", "500"))


@query
def alerts_union(feeds: Feeds) -> DataFrame:
    return alerts.all_alerts(_sensor_alerts(feeds), alerts.log_alerts(feeds.log_raw()))


@query
def alerts_with_spikes(feeds: Feeds) -> DataFrame:
    """Threshold, error-code and vibration-spike alerts as one table."""
    s = settings(feeds)
    filled = windows.fill_held(windows.window_metrics(feeds.sensor_raw()))
    return alerts.all_alerts(
        _sensor_alerts(feeds), alerts.log_alerts(feeds.log_raw(), s.alert_codes),
        windows.vibration_spikes(filled, s.vibration_spike_ratio),
    )


@query
def alert_json(feeds: Feeds) -> DataFrame:
    """The alert lines, read back so that their fields can be compared."""
    both = alerts.all_alerts(_sensor_alerts(feeds), alerts.log_alerts(feeds.log_raw()))
    schema = (
        "machine_id string, alert_time string, alert_type string, trigger_value double, "
        "threshold_value double, suggested_action string"
    )
    return alerts.alert_json(both).select(F.from_json("value", schema).alias("a")).select("a.*")


@query
def log_severity(feeds: Feeds) -> DataFrame:
    return alerts.log_severity(feeds.log_raw()).drop("seq")


@query
def error_surge(feeds: Feeds) -> DataFrame:
    return alerts.error_surge(feeds.log_raw(), 10, 5, 1.5)


@query
def error_change_points(feeds: Feeds) -> DataFrame:
    """Surges by cumulative sums, with the window in which each began."""
    return surges.cusum_surges(feeds.log_raw(), 10)


@query
def log_templates(feeds: Feeds) -> DataFrame:
    return alerts.log_templates(feeds.log_raw())


@query
def rare_templates(feeds: Feeds) -> DataFrame:
    return alerts.rare_templates(feeds.log_raw(), 0.005)


def _log_assigned(feeds: Feeds) -> DataFrame:
    lines = feeds.log_texts()
    return log_patterns.assign_templates(lines, log_patterns.message_templates(lines))


@query
def log_line_patterns(feeds: Feeds) -> DataFrame:
    """Every log line with the template its message was clustered into."""
    return _log_assigned(feeds).select("seq", "machine_id", "error_msg", "template")


@query
def log_patterns_found(feeds: Feeds) -> DataFrame:
    return log_patterns.pattern_counts(_log_assigned(feeds))


@query
def log_new_patterns(feeds: Feeds) -> DataFrame:
    """Templates that come up after a minute without them (the feeds' clock runs fast)."""
    return log_patterns.new_patterns(_log_assigned(feeds), 60, 10)


# --- state --------------------------------------------------------------------------------------


def _status(feeds: Feeds) -> DataFrame:
    return status.machine_status(
        feeds.sensor_raw(), feeds.changes(), "seq", settings(feeds).start_speed
    )


@query
def machine_status(feeds: Feeds) -> DataFrame:
    return _status(feeds)


@query
def change_record_status(feeds: Feeds) -> DataFrame:
    """Last change status per machine."""
    return latest.last_value_by_key(
        status.valid_changes(feeds.changes()), "machine_id", "status", ["start_time", "seq"]
    )


def _latest_status(feeds: Feeds) -> DataFrame:
    """Newest status per machine: the newest reading first, its status after."""
    newest = latest.newest_by_key(feeds.sensor_raw(), ["machine_id"], "timestamp", "seq")
    return status.machine_status(newest, feeds.changes(), "seq", settings(feeds).start_speed)


@query
def health_latest(feeds: Feeds) -> DataFrame:
    return _latest_status(feeds)


@query
def latest_status_sample(feeds: Feeds) -> DataFrame:
    return latest.latest_rows(_latest_status(feeds), [F.desc("update_time"), "machine_id"], 20)


@query
def health_throttled(feeds: Feeds) -> DataFrame:
    s = settings(feeds)
    return status.throttled_health(
        feeds.sensor_raw(), feeds.changes(), "seq", s.health_min_update_seconds, s.start_speed
    )


# --- windows ------------------------------------------------------------------------------------


@query
def window_metrics_1m(feeds: Feeds) -> DataFrame:
    return windows.window_metrics(feeds.sensor_raw())


@query
def window_trend_1m(feeds: Feeds) -> DataFrame:
    return windows.window_metrics(feeds.sensor_raw(), trend=True).select(
        "window_start", "window_end", "machine_id", "temp_trend"
    )


@query
def window_metrics_5m(feeds: Feeds) -> DataFrame:
    return windows.window_metrics(feeds.sensor_raw(), "5 minutes", "5m")


@query
def window_metrics_1h(feeds: Feeds) -> DataFrame:
    return windows.window_metrics(feeds.sensor_raw(), "1 hour", "1h")


@query
def window_metrics_all(feeds: Feeds) -> DataFrame:
    """1m, 5m and 1h rows, gap-filled (which only windows closer than 5 s could need)."""
    rolled = windows.rolled_up_metrics(feeds.sensor_raw())
    return windows.fill_held(rolled, keys=("machine_id", "window_type")).drop("filled")


@query
def window_rollup(feeds: Feeds) -> DataFrame:
    return windows.rolled_up_metrics(feeds.sensor_raw())


@query
def simple_window(feeds: Feeds) -> DataFrame:
    return windows.simple_window(feeds.sensor_raw())


@query
def window_stability(feeds: Feeds) -> DataFrame:
    w = windows.window_metrics(feeds.sensor_raw())
    return w.select(
        "machine_id", "window_start", "window_end", "temp_slope", "current_fluctuation",
        fn.stability_status("max_temperature", "current_fluctuation", 79.0, 2.0).alias("status"),
    )


@query
def gap_fill_hold(feeds: Feeds) -> DataFrame:
    """Three-second windows, so that gaps of 1 to 5 s between window ends occur."""
    return windows.fill_held(windows.window_metrics(feeds.sensor_raw(), "3 seconds", "3s"))


@query
def vibration_spike(feeds: Feeds) -> DataFrame:
    filled = windows.fill_held(windows.window_metrics(feeds.sensor_raw()))
    return windows.vibration_spikes(filled, settings(feeds).vibration_spike_ratio)


@query
def interpolate(feeds: Feeds) -> DataFrame:
    s = settings(feeds)
    return windows.interpolate_gaps(
        feeds.sensor_raw(), ["temperature", "vibration_x", "current"], "seq",
        s.interpolation_step_seconds, s.interpolation_max_gap_seconds,
    )


@query
def latest_windows(feeds: Feeds) -> DataFrame:
    w = windows.window_metrics(feeds.sensor_raw())
    return latest.latest_rows(w, [F.desc("window_end"), "machine_id"], 10)


@query
def late_filter(feeds: Feeds) -> DataFrame:
    s = settings(feeds)
    return windows.drop_late(
        feeds.arrivals(), "event_time", "seq", s.max_allowed_lateness_seconds, s.arrival_span
    )


# --- deviation ----------------------------------------------------------------------------------


def _deviation(feeds: Feeds) -> DataFrame:
    s = settings(feeds)
    return deviation.with_deviation(
        deviation.with_standards(
            feeds.sensor_raw(), feeds.standards(), s.default_current, s.default_speed
        )
    )


@query
def process_deviation(feeds: Feeds) -> DataFrame:
    """Deviating readings themselves."""
    return deviation.deviating(_deviation(feeds), settings(feeds).deviation_threshold).select(
        "seq", "machine_id", "timestamp", "current", "std_current", "current_dev", "speed",
        "std_speed", "speed_dev",
    )


@query
def deviation_sliding(feeds: Feeds) -> DataFrame:
    return deviation.sliding_deviation(
        deviation.deviating(_deviation(feeds), settings(feeds).deviation_threshold)
    )


@query
def deviation_by_param(feeds: Feeds) -> DataFrame:
    return deviation.sliding_deviation_by_param(
        _deviation(feeds), settings(feeds).deviation_threshold
    )


@query
def deviation_sustained(feeds: Feeds) -> DataFrame:
    return deviation.sustained_deviation(_deviation(feeds), settings(feeds).sustained_deviation)


@query
def deviation_top5(feeds: Feeds) -> DataFrame:
    return deviation.top_deviations(
        deviation.sustained_deviation(_deviation(feeds), settings(feeds).sustained_deviation)
    )


@query
def deviation_episodes(feeds: Feeds) -> DataFrame:
    """Unbroken deviations by the configured share and length, with their true length."""
    s = settings(feeds)
    return episodes.deviation_episodes(
        _deviation(feeds), s.sustained_deviation, s.sustained_seconds, s.episode_max_gap_seconds, s.segment_seconds
    )


@query
def deviation_episodes_short(feeds: Feeds) -> DataFrame:
    """The same at the threshold of single readings, from eight seconds on."""
    s = settings(feeds)
    return episodes.deviation_episodes(_deviation(feeds), s.deviation_threshold, 8, s.episode_max_gap_seconds, s.segment_seconds)


# --- feature engine -----------------------------------------------------------------------------


@query
def highfreq_features(feeds: Feeds) -> DataFrame:
    return features.window_features(feeds.highfreq_sensor())


# sequence numbers of two feeds are not comparable: their times come first
TIME_ORDER = ["event_time", "seq"]


@query
def lowfreq_pairs(feeds: Feeds) -> DataFrame:
    pairs = features.pair_latest(
        timed(feeds.device_state()), timed(feeds.sensor_metrics()), TIME_ORDER, settings(feeds).segment_seconds
    )
    return features.low_frequency_record(pairs, ["seq"])


@query
def alarm_translate(feeds: Feeds) -> DataFrame:
    return features.translate_alarm(feeds.device_state(every=True)).select(
        "seq", "machineId", "isAlarm", "alarmMessage"
    )


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", fn.epoch_ms_to_timestamp("ts")).drop("ts")


def _feature_records(feeds: Feeds) -> DataFrame:
    return features.feature_records(
        timed(feeds.device_state()),
        timed(feeds.sensor_metrics()),
        features.window_features(feeds.highfreq_sensor()),
        TIME_ORDER,
        settings(feeds).segment_seconds,
    )


@query
def features_22(feeds: Feeds) -> DataFrame:
    return _feature_records(feeds)


@query
def feature_json(feeds: Feeds) -> DataFrame:
    """The 22-field JSON lines, all fields read back."""
    records = _feature_records(feeds)
    kinds = T.StructType([records.schema[c] for c in schemas.FEATURE_RECORD])
    lines = features.feature_json(records)
    return lines.select(
        F.size(F.json_object_keys("value")).alias("n_fields"), F.from_json("value", kinds).alias("r")
    ).select("r.*", "n_fields")


@query
def trailing10(feeds: Feeds) -> DataFrame:
    return features.trailing_ten(
        timed(feeds.sensor_metrics(every=True)), TIME_ORDER, settings(feeds).segment_seconds
    ).select("seq", "machineId", "avg_spindle_load_10", "avg_cutting_time_10")


@query
def running_totals(feeds: Feeds) -> DataFrame:
    """Alarms so far per machine, from its state records."""
    sums = {
        "alarms_so_far": F.when(F.col("isAlarm") != "", 1).otherwise(0).cast("bigint"),
        "runtime_so_far": F.col("duration_seconds"),
        "running_so_far": F.col("is_running").cast("bigint"),
    }
    return features.running_totals(
        timed(feeds.device_state(every=True)), sums, TIME_ORDER, settings(feeds).segment_seconds
    ).select("seq", "machineId", *sums)


# --- tables by key ------------------------------------------------------------------------------


@query
def latest_by_key(feeds: Feeds) -> DataFrame:
    """Newest log row per machine and error code."""
    return latest.latest_by_key(feeds.log_raw(), ["machine_id", "error_code"], ["ts", "seq"])


@query
def offline_realtime_merge(feeds: Feeds) -> DataFrame:
    offline = feeds.sensor_raw(fx.OFFLINE_FILTER).withColumn("temperature", F.lit(0.0))
    realtime = feeds.sensor_raw(fx.REALTIME_FILTER)
    return latest.merge_offline_realtime(offline, realtime, ["machine_id", "ts"], ["seq"], "ts").select(
        "source", "machine_id", "ts", "temperature", "speed"
    )


# --- cleaning -----------------------------------------------------------------------------------


@query
def clean_change_data(feeds: Feeds) -> DataFrame:
    return cleaner.clean_change_data(feeds.change_data())


@query
def xml_quarantine(feeds: Feeds) -> DataFrame:
    """Change records without a readable fragment."""
    broken = cleaner.quarantine_change_data(feeds.change_data(flawed=True))
    return broken.select("record_id", "machine_id", F.length("ChangeData").alias("n_chars"))


@query
def clean_outputs(feeds: Feeds) -> DataFrame:
    """Writes all four outputs and reads every one back, with all columns."""
    cleaned = cleaner.clean_change_data(feeds.change_data()).withColumn(
        "clean_time", F.current_timestamp()
    )
    paths = cleaner.write_outputs(cleaned, shared_path(feeds.spark, "cleaned"))
    whole = feeds.spark.read.csv(paths["cleaned_full_csv"], header=True, schema=_types(cleaned, "cleaned_full_csv"))
    metrics = feeds.spark.read.csv(paths["device_metrics_csv"], header=True, schema=_types(cleaned, "device_metrics_csv"))
    state = feeds.spark.read.csv(paths["device_state_csv"], header=True, schema=_types(cleaned, "device_state_csv"))
    backup = feeds.spark.read.json(paths["json_backup"], schema=_types(cleaned, "json_backup"))
    targets = []
    for name, rows in (("full", whole), ("metrics", metrics), ("state", state), ("json", backup)):
        rows = rows.drop("clean_time")
        for field in (f for f in cleaned.schema if f.name not in (*rows.columns, "clean_time", "is_readable")):
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
        targets.append(rows.withColumn("target", F.lit(name)))
    # an empty text is written as an empty field and read back as null
    texts = [f.name for f in cleaned.schema if isinstance(f.dataType, T.StringType) and f.name != "machine_id"]
    return alerts.all_alerts(*targets).withColumns({c: F.nullif(c, F.lit("")) for c in texts})


def _types(cleaned: DataFrame, target: str) -> T.StructType:
    return T.StructType([cleaned.schema[c] for c in cleaner.OUTPUTS[target][1]])


# --- scoring ------------------------------------------------------------------------------------


# the feeds' clock runs fast: a tenth of a second stands for an hour
HOUR_SECONDS, HORIZON_HOURS = 0.1, 100.0


def _stable(feeds: Feeds) -> DataFrame:
    return scoring.in_stable_state(
        features.window_features(feeds.highfreq_sensor()), feeds.sensor_raw(), feeds.changes(), "seq",
        settings(feeds).start_speed,
    )


def _labelled(feeds: Feeds) -> DataFrame:
    return scoring.hours_to_next_failure(
        features.window_features(feeds.highfreq_sensor()), feeds.log_raw(), hour_seconds=HOUR_SECONDS
    )


@query
def rul_score(feeds: Feeds) -> DataFrame:
    """Tree model for remaining life and classifier for failure, trained on three windows of four, saved, loaded,
    and applied to all windows of machines in the stable state."""
    labelled = _labelled(feeds)
    path = shared_path(feeds.spark, "models")
    scoring.save_model(scoring.fit_rul(labelled), f"{path}/rul")
    scoring.save_model(scoring.fit_failure(labelled, HORIZON_HOURS), f"{path}/failure")
    scored = scoring.score_rul(scoring.load_model(f"{path}/rul"), _stable(feeds))
    return scoring.score_failure(scoring.load_model(f"{path}/failure"), scored).select(
        "machineId", "window_start", "rul_value", "failure_probability", "risk_level",
        scoring.held_out().alias("held_out"),
    )


@query
def rul_label(feeds: Feeds) -> DataFrame:
    return scoring.hours_to_next_failure(
        features.window_features(feeds.highfreq_sensor()), feeds.log_raw()
    ).select("machineId", "window_start", "rul_hours")


def _linear(feeds: Feeds) -> DataFrame:
    return scoring.score_linear(scoring.linear_models(_labelled(feeds), HORIZON_HOURS), _stable(feeds))


@query
def rul_linear(feeds: Feeds) -> DataFrame:
    """Least-squares scores of windows in the stable state."""
    return _linear(feeds).select("machineId", "window_start", "rul_value", "failure_probability")


@query
def risk_level(feeds: Feeds) -> DataFrame:
    return _linear(feeds).select("machineId", "window_start", "rul_value", "risk_level")


@query
def rul_alerts(feeds: Feeds) -> DataFrame:
    return scoring.rul_alerts(_linear(feeds), 130.0, 0.6)


# the probability is that of failing within FAR_HOURS
SURVIVAL_STEP_HOURS, BINS, FAR_HOURS = 10.0, 50, 250.0


def _lives(feeds: Feeds) -> DataFrame:
    return survival.observed_lives(
        features.window_features(feeds.highfreq_sensor()), feeds.log_raw(), hour_seconds=HOUR_SECONDS
    )


@query
def rul_lives(feeds: Feeds) -> DataFrame:
    """Every window with its life, those without a later failure as censored."""
    return _lives(feeds).select("machineId", "window_start", "life_hours", "failed")


@query
def rul_survival(feeds: Feeds) -> DataFrame:
    """Kaplan-Meier curves of windows in the stable state and of the others."""
    stable = _stable(feeds).select("machineId", "window_start", F.lit("stable").alias("state"))
    lives = _lives(feeds).join(stable, ["machineId", "window_start"], "left")
    return survival.survival_curve(lives, F.coalesce("state", F.lit("other")), SURVIVAL_STEP_HOURS)


def _far_models(feeds: Feeds) -> DataFrame:
    return scoring.linear_models(_labelled(feeds), FAR_HOURS)


def _reliability(feeds: Feeds) -> DataFrame:
    """On windows held out of training whose fate within the horizon is known."""
    lives = _lives(feeds).filter(scoring.held_out() & (F.col("failed") | (F.col("life_hours") > FAR_HOURS)))
    scored = scoring.score_linear(_far_models(feeds), lives)
    return survival.reliability(scored, "failure_probability", F.col("failed") & (F.col("life_hours") <= FAR_HOURS), BINS)


@query
def failure_reliability(feeds: Feeds) -> DataFrame:
    """Observed failure rates by predicted probability, and their isotonic fit."""
    return _reliability(feeds)


@query
def rul_alerts_calibrated(feeds: Feeds) -> DataFrame:
    """Alerts under 48 hours, or over 85 % calibrated probability."""
    stable = scoring.score_linear(_far_models(feeds), _stable(feeds))
    scored = survival.with_calibrated(stable, _reliability(feeds), "failure_probability", "calibrated", BINS)
    return scoring.rul_alerts(scored.withColumn("failure_probability", F.col("calibrated")))


@query
def stable_windows(feeds: Feeds) -> DataFrame:
    """Windows that would be scored: machine stable at its last reading."""
    return _stable(feeds).select("machineId", "window_start")


def batch_queries() -> dict[str, Query]:
    return dict(_QUERIES)
