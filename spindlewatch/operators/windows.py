"""Tumbling-window metrics per machine, their roll-up, gap filling, spikes and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindlewatch.functions import columns as fn
from spindlewatch.operators.segments import running_max_before

GRANULARITIES = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour"}
SPIKE_ACTION = "请立即检查设备"
SPIKE_PREFIX = "振动突增:"

_MERGEABLE = ["n", "max_t", "min_t", "vib_sq", "cur_sum", "cur_sq"]


def _spread(bounds: Column) -> list[Column]:
    return [bounds["start"].alias("window_start"), bounds["end"].alias("window_end")]


def window_metrics(
    sensor: DataFrame, size: str = "1 minute", label: str = "1m", trend: bool = False
) -> DataFrame:
    """Metrics of one window size, straight from the readings.

    ``temp_slope`` is the temperature range; ``trend=True`` adds ``temp_trend``, the least-squares
    slope in degrees per second.
    """
    aggregates = [
        F.max("temperature").alias("max_temperature"),
        F.sqrt(F.avg(fn.squared_magnitude("vibration_x", "vibration_y", "vibration_z"))).alias(
            "avg_vib_rms"
        ),
        F.stddev_pop("current").alias("current_fluctuation"),
        (F.max("temperature") - F.min("temperature")).alias("temp_slope"),
    ]
    names = ["max_temperature", "avg_vib_rms", "current_fluctuation", "temp_slope"]
    readings = sensor.withColumn("_w", F.window("timestamp", size))
    if trend:
        # seconds since the window began keep the regression well-conditioned
        elapsed = (F.unix_micros("timestamp") - F.unix_micros("_w.start")) / 1e6
        aggregates.append(F.regr_slope("temperature", elapsed).alias("temp_trend"))
        names.append("temp_trend")
    return (
        readings.groupBy("_w", "machine_id")
        .agg(*aggregates)
        .select(*_spread(F.col("_w")), "machine_id", *names, F.lit(label).alias("window_type"))
    )


def simple_window(sensor: DataFrame, size: str = "1 minute") -> DataFrame:
    """Reduced variant: maximum temperature and mean x vibration."""
    return (
        sensor.groupBy(F.window("timestamp", size).alias("_w"), "machine_id")
        .agg(
            F.max("temperature").alias("max_temperature"),
            F.avg("vibration_x").alias("avg_vib_rms"),
        )
        .select(*_spread(F.col("_w")), "machine_id", "max_temperature", "avg_vib_rms")
    )


def window_sums(sensor: DataFrame, size: str = "1 minute", current_origin: float = 30.0) -> DataFrame:
    """Mergeable sums per window. Current is taken relative to a fixed origin near its level, so
    that the sum of squares does not cancel."""
    offset = F.col("current") - F.lit(current_origin)
    return sensor.groupBy(F.window("timestamp", size).alias("_w"), "machine_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("temperature").alias("max_t"),
        F.min("temperature").alias("min_t"),
        F.sum(fn.squared_magnitude("vibration_x", "vibration_y", "vibration_z")).alias("vib_sq"),
        F.sum(offset).alias("cur_sum"),
        F.sum(offset * offset).alias("cur_sq"),
    )


def _merge() -> list[Column]:
    extremes = {"max_t": F.max, "min_t": F.min}
    return [extremes.get(c, F.sum)(c).alias(c) for c in _MERGEABLE]


def roll_up(sums: DataFrame, size: str) -> DataFrame:
    """Merge window sums into windows of a larger size."""
    return sums.groupBy(F.window(F.window_time("_w"), size).alias("_w"), "machine_id").agg(*_merge())


def metrics_from_sums(sums: DataFrame, label: str | Column) -> DataFrame:
    mean = F.col("cur_sum") / F.col("n")
    variance = F.greatest(F.col("cur_sq") / F.col("n") - mean * mean, F.lit(0.0))
    return sums.select(
        *_spread(F.col("_w")),
        "machine_id",
        F.col("max_t").alias("max_temperature"),
        F.sqrt(F.col("vib_sq") / F.col("n")).alias("avg_vib_rms"),
        F.sqrt(variance).alias("current_fluctuation"),
        (F.col("max_t") - F.col("min_t")).alias("temp_slope"),
        (F.lit(label) if isinstance(label, str) else label).alias("window_type"),
    )


def rolled_up_metrics(sensor: DataFrame) -> DataFrame:
    """1m, 5m and 1h metrics as one table, from a single scan of the readings.

    Readings are shuffled once, as one-minute sums. Each minute is then counted into its window of
    every granularity, which moves a few rows per machine-minute only. (On a stream, chain
    ``roll_up`` instead: there the larger windows need the event time.)
    """
    minute = window_sums(sensor, GRANULARITIES["1m"])
    homes = [
        F.struct(F.lit(label).alias("label"), _window_of(F.col("_w.start"), size).alias("w"))
        for label, size in GRANULARITIES.items()
    ]
    merged = (
        minute.withColumn("_home", F.explode(F.array(*homes)))
        .groupBy(F.col("_home.label").alias("_label"), F.col("_home.w").alias("_w"), "machine_id")
        .agg(*_merge())
    )
    return metrics_from_sums(merged, F.col("_label"))


def rolled_up_stream(sensor: DataFrame) -> DataFrame:
    """The table of ``rolled_up_metrics`` from a watermarked stream: each granularity is merged from the one below."""
    minute = window_sums(sensor, GRANULARITIES["1m"])
    five = roll_up(minute, GRANULARITIES["5m"])
    hour = roll_up(five, GRANULARITIES["1h"])
    return union_windows(*(metrics_from_sums(w, label) for w, label in ((minute, "1m"), (five, "5m"), (hour, "1h"))))


def _window_of(start: Column, size: str) -> Column:
    """The tumbling window a smaller window's start falls into."""
    micros = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {size})")
    begin = F.floor(F.unix_micros(start) / micros).cast("bigint") * micros
    return F.struct(
        F.timestamp_micros(begin).alias("start"), F.timestamp_micros(begin + micros).alias("end")
    )


def union_windows(*windows: DataFrame) -> DataFrame:
    out = windows[0]
    for other in windows[1:]:
        out = out.unionByName(other)
    return out


def fill_held(
    metrics: DataFrame, min_gap: int = 1, max_gap: int = 5, keys: tuple[str, ...] = ("machine_id",)
) -> DataFrame:
    """Hold-last fill: a window ending more than ``min_gap`` and at most ``max_gap`` whole seconds
    after the previous one takes over its three measures; ``filled`` marks it. Fills chain.

    Rows per machine here are windows, so their number grows with time and not with readings.
    """
    w = W.partitionBy(*keys).orderBy("window_end")
    gap = F.floor(
        (F.unix_micros("window_end") - F.lag(F.unix_micros("window_end")).over(w)) / 1_000_000
    )
    held = ["max_temperature", "avg_vib_rms", "current_fluctuation"]
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    flagged = metrics.withColumn(
        "filled", F.coalesce((gap > min_gap) & (gap <= max_gap), F.lit(False))
    )
    own = F.when(~F.col("filled"), F.struct(*held))
    return flagged.withColumn("_held", F.last(own, ignorenulls=True).over(upto)).select(
        *[F.col(f"_held.{c}").alias(c) if c in held else F.col(c) for c in metrics.columns],
        "filled",
    )


def vibration_spikes(metrics: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Alerts for windows whose vibration differs from the previous window's by ``ratio`` or more."""
    w = W.partitionBy("machine_id").orderBy("window_end")
    change = F.abs(F.col("avg_vib_rms") - F.col("_prev")) / F.col("_prev")
    return (
        metrics.withColumn("_prev", F.lag("avg_vib_rms").over(w))
        .filter("_prev > 0")
        .withColumn("_change", change)
        .filter(F.col("_change") >= ratio)
        .select(*spike_alert_columns(F.col("_change")))
    )


def spike_alert_columns(change: Column) -> list:
    return [
        F.col("window_end").alias("alert_time"),
        F.col("machine_id"),
        fn.percent_label(SPIKE_PREFIX, change).alias("alert_type"),
        F.col("avg_vib_rms").alias("trigger_value"),
        F.lit(0.0).alias("threshold_value"),
        F.lit(SPIKE_ACTION).alias("suggested_action"),
    ]


def interpolate_gaps(
    sensor: DataFrame,
    columns: list[str],
    order: str = "seq",
    step_seconds: int = 1,
    max_gap_seconds: int = 5,
    block_seconds: int = 3600,
) -> DataFrame:
    """Linear interpolation in gaps longer than a step and no longer than ``max_gap_seconds``:
    one row per missing step, strictly inside the gap.

    A gap of more than one second lies between the last reading of one second and the first of a
    later one, so readings are reduced to those two per machine-second before any ordering. Seconds
    are grouped in blocks of ``block_seconds``; the seconds near a block's end also go to the next
    block, since a fillable gap can cross it. A group therefore never exceeds
    ``block_seconds + max_gap_seconds + 1`` rows.
    """
    if step_seconds < 1:
        raise ValueError("step_seconds must be at least 1")
    micros = F.unix_micros("timestamp")
    point = F.struct(micros.alias("t"), F.col(order).alias("o"), *columns)
    seconds = sensor.groupBy("machine_id", F.floor(micros / 1_000_000).cast("bigint").alias("_s")).agg(
        F.min(point).alias("_first"), F.max(point).alias("_last")
    )
    home = F.floor(F.col("_s") / block_seconds).cast("bigint")
    reach = F.floor((F.col("_s") + max_gap_seconds + 1) / block_seconds).cast("bigint")
    w = W.partitionBy("machine_id", "_block").orderBy("_s")
    gaps = (
        seconds.withColumn("_home", home)
        .withColumn("_block", F.explode(F.sequence("_home", reach)))
        .withColumn("_before", F.lag("_last").over(w))
        .filter("_block = _home")
        .withColumn("_gap", F.col("_first.t") - F.col("_before.t"))
        .filter(
            (F.col("_gap") > step_seconds * 1_000_000) & (F.col("_gap") <= max_gap_seconds * 1_000_000)
        )
    )
    # k-th step after the earlier reading, up to but not on the later one
    steps = F.floor((F.col("_gap") - 1) / (step_seconds * 1_000_000)).cast("int")
    share = F.col("_k") * (step_seconds * 1_000_000) / F.col("_gap")
    return gaps.withColumn("_k", F.explode(F.sequence(F.lit(1), steps))).select(
        "machine_id",
        F.timestamp_micros(F.col("_before.t") + F.col("_k") * (step_seconds * 1_000_000)).alias(
            "timestamp"
        ),
        *[
            (F.col(f"_before.{c}") + (F.col(f"_first.{c}") - F.col(f"_before.{c}")) * share).alias(c)
            for c in columns
        ],
    )


def drop_late(
    df: DataFrame, time_column: str, order: str, lateness_seconds: int, span: int
) -> DataFrame:
    """Batch lateness filter in arrival order: keep rows whose event time is no more than
    ``lateness_seconds`` behind the latest event time that arrived before them."""
    timed = df.withColumn("_t", F.unix_micros(time_column))
    seen = running_max_before(timed, order, "_t", "_seen", span)
    on_time = F.col("_seen").isNull() | (F.col("_t") >= F.col("_seen") - lateness_seconds * 1_000_000)
    return seen.filter(on_time).drop("_t", "_seen")
