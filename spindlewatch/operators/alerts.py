"""Threshold and error-code alerts, log severity, error surges and log templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindlewatch.functions import columns as fn
from spindlewatch.schemas import ALERT_COLUMNS

# Alert types and suggested actions.
HIGH_TEMPERATURE = "高温预警"
VIBRATION_FAULT = "振动异常"
SEVERE_ERROR_PREFIX = "严重错误: "
CHECK_DEVICE = "请立即检查设备"
CHECK_LOG = "请立即检查硬件日志"


def sensor_alerts(
    sensor: DataFrame, temperature: float = 80.0, vibration: float = 2.0
) -> DataFrame:
    """One alert per reading over a threshold; temperature comes first when both are."""
    hot = F.col("temperature") > temperature
    shaking = F.col("vibration_x") > vibration

    def by_cause(if_hot: Column, otherwise: Column) -> Column:
        return F.when(hot, if_hot).otherwise(otherwise)

    return sensor.filter(hot | shaking).select(
        F.col("timestamp").alias("alert_time"),
        "machine_id",
        by_cause(F.lit(HIGH_TEMPERATURE), F.lit(VIBRATION_FAULT)).alias("alert_type"),
        by_cause(F.col("temperature"), F.col("vibration_x")).alias("trigger_value"),
        by_cause(F.lit(temperature), F.lit(vibration)).alias("threshold_value"),
        F.lit(CHECK_DEVICE).alias("suggested_action"),
    )


def log_alerts(log: DataFrame, codes: Sequence[str] = ("999",)) -> DataFrame:
    return log.filter(F.col("error_code").isin(*codes)).select(
        F.col("timestamp").alias("alert_time"),
        "machine_id",
        F.concat(F.lit(SEVERE_ERROR_PREFIX), "error_code").alias("alert_type"),
        F.coalesce(F.col("error_code").try_cast("double"), F.lit(0.0)).alias("trigger_value"),
        F.lit(0.0).alias("threshold_value"),
        F.lit(CHECK_LOG).alias("suggested_action"),
    )


def all_alerts(*alerts: DataFrame) -> DataFrame:
    out = alerts[0]
    for other in alerts[1:]:
        out = out.unionByName(other)
    return out


def stamp_insert_time(alerts: DataFrame) -> DataFrame:
    """Seven-field alert row for the table sink; the time is that of the write."""
    return alerts.withColumn("insert_time", F.current_timestamp()).select(*ALERT_COLUMNS)


def alert_json(alerts: DataFrame) -> DataFrame:
    """Alerts as JSON lines in ``value``, without the insert time."""
    fields = [
        "machine_id", "alert_time", "alert_type", "trigger_value", "threshold_value",
        "suggested_action",
    ]
    options = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSS"}
    return alerts.select(F.to_json(F.struct(*fields), options).alias("value"))


def log_severity(log: DataFrame) -> DataFrame:
    return log.withColumn("severity", fn.log_severity("error_code"))


def error_surge(
    log: DataFrame, seconds: int = 60, preceding: int = 5, factor: float = 1.5, least: int = 3
) -> DataFrame:
    """Windows in which a code occurs ``factor`` times as often as in the mean of the windows before.

    The ``preceding`` adjacent windows count, silent ones as zero, but none from before the log began.
    A code that was silent in all of them surges with ``least`` lines. Ordered rows are windows per
    code, not log lines.
    """
    size = f"{seconds} seconds"
    counts = (
        log.groupBy(F.window("timestamp", size).alias("_w"), "error_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("window_start"), "error_code", "n")
    )
    begun = counts.agg(F.unix_seconds(F.min("window_start")).alias("_begun"))
    at = F.unix_seconds("window_start")
    w = W.partitionBy("error_code").orderBy(at).rangeBetween(-preceding * seconds, -seconds)
    before = F.least(F.lit(preceding), F.floor((at - begun.scalar()) / seconds))
    return (
        counts.withColumn("baseline", F.coalesce(F.sum("n").over(w), F.lit(0)) / F.nullif(before, F.lit(0)))
        .filter((F.col("n") >= factor * F.col("baseline")) & ((F.col("baseline") > 0) | (F.col("n") >= least)))
    )


def log_template(message: Column | str) -> Column:
    """Message with hexadecimal numbers masked as <hex> and decimal ones as <num>."""
    masked = F.regexp_replace(fn.col(message), "0x[0-9A-Fa-f]+", "<hex>")
    return F.regexp_replace(masked, "[0-9]+(\\.[0-9]+)?", "<num>")


def log_templates(log: DataFrame) -> DataFrame:
    return log.groupBy(log_template("error_msg").alias("template")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def rare_templates(log: DataFrame, max_share: float = 0.005) -> DataFrame:
    """Templates that make up at most ``max_share`` of all lines: candidates for unknown faults."""
    lines = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    return log_templates(log).filter(F.col("n") <= max_share * lines)
