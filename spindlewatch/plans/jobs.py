"""The jobs, wired from operators: realtime engine, feature engine, change-data cleaner, scoring.

A job takes its parsed, watermarked inputs and one writer per output (see ``streaming.sinks``), so
that tables, topics or files can stand behind each. Every output is a streaming query of its own,
with its own checkpoint: a slow lake write does not hold up alerts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindlewatch.config import Settings
from spindlewatch.operators import alerts, cleaner, deviation, features, scoring, status, windows
from spindlewatch.streaming import sinks, transforms
from spindlewatch.streaming.watermarks import together

Writer = Callable[[DataFrame, int], None]

REALTIME_OUTPUTS = [
    "device_realtime_status", "realtime_status_window", "spike_alerts", "realtime_alerts", "alert_topic",
    "realtime_process_deviation", "change_record_status",
    "device_health", "sensor_detail_realtime", "device_log_realtime",
]


def _select_then(write: Writer, shape: Callable[[DataFrame], DataFrame]) -> Writer:
    return lambda batch, batch_id: write(shape(batch), batch_id)


def start_realtime_engine(
    sensor: DataFrame,
    log: DataFrame,
    changes: DataFrame,
    standards: DataFrame,
    writers: dict[str, Writer],
    checkpoint: str,
    settings: Settings | None = None,
    trigger: dict | None = None,
) -> list[StreamingQuery]:
    """Start the outputs named in ``writers`` (any of ``REALTIME_OUTPUTS``).

    The inputs carry no watermarks yet; ``seq`` is the arrival order within each feed. A silent change
    feed holds back none of the outputs.
    """
    s = settings or Settings.from_spark(sensor.sparkSession)
    delay = f"{s.watermark_seconds} seconds"
    unknown = set(writers) - set(REALTIME_OUTPUTS)
    if unknown:
        raise ValueError(f"no such outputs: {sorted(unknown)}")

    def ordered_status() -> DataFrame:
        return transforms.status_stream(sensor, changes, s.start_speed, delay)

    def every_window() -> DataFrame:
        """1m, 5m and 1h in one table, told apart by ``window_type``."""
        return windows.rolled_up_stream(sensor.withWatermark("timestamp", delay))

    def every_alert() -> DataFrame:
        return alerts.all_alerts(
            alerts.sensor_alerts(sensor, s.temperature_threshold, s.vibration_threshold),
            alerts.log_alerts(log, s.alert_codes),
        )

    def deviations() -> DataFrame:
        marked = sensor.withWatermark("timestamp", delay)
        readings = deviation.with_standards(marked, standards, s.default_current, s.default_speed)
        return deviation.sliding_deviation(
            deviation.deviating(deviation.with_deviation(readings), s.deviation_threshold)
        )

    started = []

    def start(name: str, rows: Callable[[], DataFrame], *outputs: tuple[str, Callable]) -> None:
        wanted = [_select_then(writers[out], shape) for out, shape in outputs if out in writers]
        if wanted:
            write = wanted[0] if len(wanted) == 1 else sinks.fan_out(*wanted)
            started.append(sinks.start_foreach(rows(), write, f"{checkpoint}/{name}", trigger))

    def same(batch: DataFrame) -> DataFrame:
        return batch

    start("status", ordered_status, ("device_realtime_status", lambda b: b.drop("seq")))
    start("windows", every_window, ("realtime_status_window", same))
    start(
        "spikes", lambda: transforms.filled_window_stream(sensor.withWatermark("timestamp", delay)),
        (
            "spike_alerts",
            lambda b: alerts.stamp_insert_time(transforms.spike_stream(b, s.vibration_spike_ratio)),
        ),
    )
    start(
        "alerts", every_alert,
        ("realtime_alerts", alerts.stamp_insert_time), ("alert_topic", alerts.alert_json),
    )
    start("deviation", deviations, ("realtime_process_deviation", same))
    start(
        "changes", lambda: status.valid_changes(changes).select("machine_id", "status", "start_time", "seq"),
        ("change_record_status", same),
    )
    start(
        "health",
        lambda: transforms.health_stream(
            *together((sensor, "timestamp"), (changes, "start_time")), s.health_min_update_seconds, s.start_speed
        ),
        ("device_health", same),
    )
    start(
        "lake_sensor", lambda: sinks.event_hour(sensor.drop("timestamp")), ("sensor_detail_realtime", same)
    )
    start(
        "lake_log", lambda: sinks.event_hour(alerts.log_severity(log).drop("timestamp")),
        ("device_log_realtime", same),
    )
    return started


def start_feature_engine(
    state: DataFrame,
    metrics: DataFrame,
    highfreq: DataFrame,
    write: Writer,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """22-field feature records as JSON lines in ``value``, to the feature topic's writer.

    The inputs carry no watermarks yet.
    """
    records = transforms.feature_record_stream(*together(*[(rows, "event_time") for rows in (state, metrics, highfreq)]))
    return sinks.start_foreach(
        records, _select_then(write, features.feature_json), f"{checkpoint}/features", trigger
    )


def cleaner_samples(spark: SparkSession) -> DataFrame:
    """One record each of a running, a standby, an alarmed and an offline machine."""
    rows = []
    for i, (state, connection, number, text) in enumerate(
        [("运行", "normal", 0, "无报警"), ("待机", "normal", 0, "无报警"),
         ("异常停机", "normal", 1021, "主轴过载"), ("未知", "lost", 0, "无报警")]
    ):
        named = {
            cleaner.CELL_DEVICE_IP: f"192.168.1.{201 + i}",
            cleaner.CELL_MACHINE_STATUS: state,
            cleaner.CELL_CONNECTION: connection,
            cleaner.CELL_ALARM: f'{{"AlmNo":{number},"AlmMsg":"{text}"}}',
            "切削时间": "495945",
        }
        rows.append((i + 1, str(101 + i), "".join(f'<col ColName="{k}">{v}</col>' for k, v in named.items())))
    samples = spark.createDataFrame(rows, "record_id long, machine_id string, ChangeData string")
    return samples.withColumn("record_time", F.timestamp_seconds(F.lit(1704067200) + F.col("record_id")))


def run_cleaner(records: DataFrame, output: str | None = None, column: str = "ChangeData") -> dict[str, str]:
    """Clean a table of XML records and write its four outputs under ``output``, or where the settings say."""
    output = output or Settings.from_spark(records.sparkSession).output_base_path
    if not output:
        raise ValueError("name an output folder, or set output_base_path")
    cleaned = cleaner.clean_change_data(records, column).withColumn("clean_time", F.current_timestamp())
    return cleaner.write_outputs(cleaned, output)


def run_scoring(
    windows: DataFrame, sensor: DataFrame, changes: DataFrame, models: str, output: str,
    hours: float = 48.0, probability: float = 0.85,
) -> dict[str, str]:
    """Remaining life, failure probability and risk of every window in the stable state, and the alerts they raise.

    ``models`` holds the saved ``rul`` and ``failure`` models; returns the paths written.
    """
    stable = scoring.in_stable_state(windows, sensor, changes)
    scored = scoring.score_rul(scoring.load_model(f"{models}/rul"), stable)
    scored = scoring.score_failure(scoring.load_model(f"{models}/failure"), scored)
    paths = {name: f"{output}/{name}" for name in ("rul_scores", "rul_alerts")}
    scored.write.mode("overwrite").parquet(paths["rul_scores"])
    # alerts come from the rows as written, so models are applied once
    written = windows.sparkSession.read.parquet(paths["rul_scores"])
    scoring.rul_alerts(written, hours, probability).write.mode("overwrite").parquet(paths["rul_alerts"])
    return paths
