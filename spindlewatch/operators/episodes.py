"""Sustained deviation as episodes: unbroken runs of readings over a threshold, with their true length.

A fixed window misses an episode that lies across its boundary and cannot say how long one lasted. Here an episode is a
maximal run of consecutive readings of a machine that deviate in one parameter, with no silence of more than
``max_gap_seconds`` inside; it lasts from its first reading to its last. No machine is sorted in one task: readings are
cut into time segments, every segment finds its own runs, and only runs at a segment's edge, or long enough to be reported by themselves, go on
to be chained (a number bounded by elapsed time, not by readings). Results do not depend on the span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindlewatch.operators.segments import SEGMENT, segment_window, with_segment

#: Values of an episode: how two parts of one are put together.
MEASURES = ("actual", "std", "dev")
NO_LIMIT = 1 << 62


def by_param(readings: DataFrame, threshold: float) -> DataFrame:
    """One row per reading and parameter (current, speed), with ``over``: whether it deviates by more than ``threshold``."""
    return readings.select(
        "timestamp", "seq", "machine_id",
        F.expr(
            "stack(2, 'current', current, std_current, current_dev, 'speed', speed, std_speed, speed_dev) "
            "AS (param_name, actual, std, dev)"
        ),
    ).withColumn("over", F.coalesce(F.col("dev") > threshold, F.lit(False)))


def gap_micros(max_gap_seconds: float | None) -> int:
    return NO_LIMIT if max_gap_seconds is None else int(max_gap_seconds * 1_000_000)


def episode_record(episodes: DataFrame) -> DataFrame:
    """The report columns from ``start_us``, ``end_us`` and the maxima of an episode."""
    return episodes.select(
        F.timestamp_micros("start_us").alias("record_time"),
        F.timestamp_micros("end_us").alias("end_time"),
        "machine_id", "param_name",
        F.col("actual").alias("actual_value"),
        F.col("std").alias("standard_value"),
        (F.col("dev") * 100).alias("deviation_ratio"),
        ((F.col("end_us") - F.col("start_us")) / 1_000_000).alias("duration_seconds"),
        "n_readings", "still_open",
    )


def deviation_episodes(
    readings: DataFrame,
    threshold: float = 0.10,
    least_seconds: float = 30,
    max_gap_seconds: float | None = None,
    span: int = 3600,
) -> DataFrame:
    """Episodes of at least ``least_seconds``, by parameter; ``still_open`` if the machine's last reading belongs to it.

    Readings are ordered by (timestamp, seq). A missing deviation counts as none and ends an episode.
    """
    key = ["machine_id", "param_name"]
    gap, least = gap_micros(max_gap_seconds), int(least_seconds * 1_000_000)
    rows = with_segment(by_param(readings, threshold), "timestamp", span).withColumn("us", F.unix_micros("timestamp"))
    w = segment_window(key, ["timestamp", "seq"])
    marked = rows.withColumns({
        "_before": F.lag("over").over(w), "_before_us": F.lag("us").over(w), "_last": F.lead("us").over(w).isNull(),
    })
    starts = F.col("_before").isNull() | (F.col("over") != F.col("_before")) | (F.col("us") - F.col("_before_us") > gap)
    runs = (
        marked.withColumn("_run", F.sum(starts.cast("bigint")).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*key, SEGMENT, "_run")
        .agg(
            F.min("us").alias("start_us"), F.max("us").alias("end_us"), *[F.max(m).alias(m) for m in MEASURES],
            F.count(F.lit(1)).alias("n_readings"), F.max("over").alias("over"),
            F.max(F.col("_before").isNull()).alias("_left"), F.max("_last").alias("_right"),
        )
        .filter(F.col("_left") | F.col("_right") | (F.col("over") & (F.col("end_us") - F.col("start_us") >= least)))
    )
    # a run at a segment's beginning follows the last run of the segment before it, which is at an edge as well
    chain = W.partitionBy(*key).orderBy(SEGMENT, "_run")
    continues = (
        F.col("_left") & F.col("over") & F.lag("over").over(chain)
        & (F.col("start_us") - F.lag("end_us").over(chain) <= gap)
    )
    return episode_record(
        runs.withColumn("_new", (~F.coalesce(continues, F.lit(False))).cast("bigint"))
        .withColumn("_final", F.lead("_run").over(chain).isNull())
        .withColumn("_episode", F.sum("_new").over(chain.rowsBetween(W.unboundedPreceding, 0)))
        .filter("over")
        .groupBy(*key, "_episode")
        .agg(
            F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), *[F.max(m).alias(m) for m in MEASURES],
            F.sum("n_readings").alias("n_readings"), F.max("_final").alias("still_open"),
        )
        .filter(F.col("end_us") - F.col("start_us") >= least)
    )
