"""Deviation of process parameters from per-machine standards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.functions import columns as fn

WINDOW_SECONDS = 30


def with_standards(
    sensor: DataFrame,
    standards: DataFrame,
    default_current: float = 30.0,
    default_speed: float = 3000.0,
) -> DataFrame:
    """Left lookup of ``standards(machine_id, current, speed)``, with defaults.

    A machine has one standard: of several rows the greatest (current, speed) counts, so readings are
    never multiplied. Reduce the dimension by ``latest_by_key`` first where it has an order.

    No broadcast hint: Spark broadcasts the dimension when its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins by shuffle, splitting hot machines.
    """
    one = standards.groupBy("machine_id").agg(F.max(F.struct("current", "speed")).alias("_s"))
    dim = one.select(
        "machine_id",
        F.col("_s.current").alias("std_current"),
        F.col("_s.speed").alias("std_speed"),
    )
    return (
        sensor.join(dim, "machine_id", "left")
        .withColumn("std_current", F.coalesce("std_current", F.lit(default_current)))
        .withColumn("std_speed", F.coalesce("std_speed", F.lit(default_speed)))
    )


def with_deviation(readings: DataFrame) -> DataFrame:
    return readings.withColumn(
        "current_dev", fn.deviation_ratio("current", "std_current")
    ).withColumn("speed_dev", fn.deviation_ratio("speed", "std_speed"))


def deviating(readings: DataFrame, threshold: float = 0.028) -> DataFrame:
    return readings.filter((F.col("current_dev") > threshold) | (F.col("speed_dev") > threshold))


def _record(windows: DataFrame, param: str = "current") -> DataFrame:
    return windows.select(
        F.col("_w.start").alias("record_time"),
        "machine_id",
        F.lit(param).alias("param_name"),
        F.col("max_actual").alias("actual_value"),
        F.col("max_std").alias("standard_value"),
        (F.col("max_dev") * 100).alias("deviation_ratio"),
        F.lit(WINDOW_SECONDS).alias("duration_seconds"),
    )


def _panes(readings: DataFrame, actual: str, std: str, dev: str) -> DataFrame:
    """Maxima per ten-second pane: each 30-second window is three panes, so readings are folded
    once instead of being copied into three windows."""
    return readings.groupBy(F.window("timestamp", "10 seconds").alias("_p"), "machine_id").agg(
        F.max(actual).alias("max_actual"), F.max(std).alias("max_std"), F.max(dev).alias("max_dev")
    )


def sliding_deviation(deviations: DataFrame) -> DataFrame:
    """30-second windows every 10 seconds over readings that deviate in current or speed; reports
    the current's maxima."""
    panes = _panes(deviations, "current", "std_current", "current_dev")
    windows = panes.groupBy(
        F.window(F.window_time("_p"), "30 seconds", "10 seconds").alias("_w"), "machine_id"
    ).agg(*[F.max(c).alias(c) for c in ("max_actual", "max_std", "max_dev")])
    return _record(windows)


def sliding_deviation_by_param(readings: DataFrame, threshold: float = 0.028) -> DataFrame:
    """Variant that filters and reports current and speed each on its own."""
    params = readings.select(
        "timestamp",
        "machine_id",
        F.expr(
            "stack(2, 'current', current, std_current, current_dev, 'speed', speed, std_speed, "
            "speed_dev) AS (param_name, actual, std, dev)"
        ),
    ).filter(F.col("dev") > threshold)
    panes = params.groupBy(
        F.window("timestamp", "10 seconds").alias("_p"), "machine_id", "param_name"
    ).agg(F.max("actual").alias("a"), F.max("std").alias("s"), F.max("dev").alias("d"))
    return (
        panes.groupBy(
            F.window(F.window_time("_p"), "30 seconds", "10 seconds").alias("_w"),
            "machine_id",
            "param_name",
        )
        .agg(F.max("a").alias("a"), F.max("s").alias("s"), F.max("d").alias("d"))
        .select(
            F.col("_w.start").alias("record_time"),
            "machine_id",
            "param_name",
            F.col("a").alias("actual_value"),
            F.col("s").alias("standard_value"),
            (F.col("d") * 100).alias("deviation_ratio"),
            F.lit(WINDOW_SECONDS).alias("duration_seconds"),
        )
    )


def sustained_deviation(readings: DataFrame, threshold: float = 0.10) -> DataFrame:
    """30-second tumbling windows whose smallest current deviation is over ``threshold``."""
    windows = (
        readings.groupBy(F.window("timestamp", "30 seconds").alias("_w"), "machine_id")
        .agg(
            F.max("current").alias("max_actual"),
            F.max("std_current").alias("max_std"),
            F.max("current_dev").alias("max_dev"),
            F.min("current_dev").alias("min_dev"),
        )
        .filter(F.col("min_dev") > threshold)
    )
    return _record(windows)


def top_deviations(records: DataFrame, limit: int = 5) -> DataFrame:
    order = [F.desc("deviation_ratio"), F.asc("record_time"), F.asc("machine_id")]
    return records.orderBy(*order).limit(limit)
