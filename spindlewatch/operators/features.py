"""Seven window features per machine-minute and the 22-field feature record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindlewatch.functions import columns as fn
from spindlewatch.functions.alarm_codes import UNKNOWN_ALARM_PREFIX, alarm_dictionary
from spindlewatch.operators import segments
from spindlewatch.operators.asof import asof_left
from spindlewatch.schemas import FEATURE_FIELDS, FEATURE_RECORD, WINDOW_FEATURES


def window_features(
    readings: DataFrame, time_column: str = "event_time", size: str = "1 minute"
) -> DataFrame:
    """The features of each machine and window, all from built-in (partially aggregated) moments.

    ``fft_peak`` is the largest absolute x vibration, as its definition rms * (peak / rms) reduces to.
    """
    vx = F.abs(F.col("vibration_x"))
    rms = F.sqrt(F.avg(vx * vx))
    variance = F.var_pop("temperature")
    kurtosis = F.when(variance > 1e-9, F.coalesce(F.kurtosis("temperature"), F.lit(0.0))).otherwise(0.0)
    return (
        readings.groupBy(F.window(time_column, size).alias("_w"), "machineId")
        .agg(
            fn.round_half_up(variance, 2).alias("var_temp"),
            fn.round_half_up(kurtosis, 2).alias("kurtosis_temp"),
            fn.round_half_up(F.when(rms > 1e-6, F.max(vx)).otherwise(0.0), 3).alias("fft_peak"),
            fn.round_half_up(F.avg("spindle_load"), 1).alias("avg_spindle_load"),
            fn.round_half_up(F.max("spindle_load"), 1).alias("max_spindle_load"),
            fn.round_half_up(F.avg((F.col("is_running") == 1).cast("double")), 4).alias(
                "running_ratio"
            ),
            fn.round_half_up(F.avg("feed_rate"), 0).alias("avg_feed_rate"),
        )
        .select(
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "machineId",
            *WINDOW_FEATURES,
        )
    )


# --- pairing of state and metrics records -------------------------------------------------------

STATE, METRICS = 0, 1


def merged_feed(state: DataFrame, metrics: DataFrame, order: str | list[str]) -> DataFrame:
    """Both low-frequency feeds as one sequence with a struct per side."""
    orders = segments.order_columns(order)
    s_cols = [c for c in state.columns if c not in ("machineId", *orders)]
    m_cols = [c for c in metrics.columns if c not in ("machineId", *orders)]
    left = state.select("machineId", *orders, F.lit(STATE).alias("side"), F.struct(*s_cols).alias("state"))
    right = metrics.select(
        "machineId", *orders, F.lit(METRICS).alias("side"), F.struct(*m_cols).alias("metrics")
    )
    return left.unionByName(right, allowMissingColumns=True)


def _runs(events: DataFrame, order: list[str]) -> DataFrame:
    """Number the runs of equal side in each segment and flag repeats within a run."""
    w = segments.segment_window(["machineId"], order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    repeat = F.coalesce(F.col("side") == F.lag("side").over(w), F.lit(False))
    return events.withColumn("_repeat", repeat).withColumn(
        "_run", F.sum(F.when(F.col("_repeat"), 0).otherwise(1)).over(upto)
    )


def _inherited(events: DataFrame, order: list[str]) -> DataFrame:
    """Per segment, the record left waiting by the segments before it, as a row of that segment.

    Only one summary row per machine and segment is scanned. A segment's effect is fixed by itself
    when it holds a repeat or opens with the side the previous one closed with; otherwise all of it
    alternates, and only the number of its records counts. What waits after a segment is its last record.
    """
    record = [c for c in events.columns if c not in ("machineId", segments.SEGMENT)]
    summary = (
        _runs(events, order)
        .groupBy("machineId", segments.SEGMENT)
        .agg(
            F.max("_run").alias("n"),
            F.max(F.when(F.col("_repeat"), F.col("_run"))).alias("r"),
            F.max(F.when((F.col("_run") == 1), F.col("side"))).alias("first_side"),
            F.max_by(F.struct(*record), F.struct(*order)).alias("last"),
        )
    )
    last_side = F.pmod(F.col("first_side") + F.col("n") - 1, F.lit(2))
    w = W.partitionBy("machineId").orderBy(segments.SEGMENT)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    pinned = F.when(F.col("r").isNotNull(), F.pmod(F.col("n") - F.col("r"), F.lit(2)) == 0).when(
        F.lag("_last_side").over(w) == F.col("first_side"), F.pmod(F.col("n") - 1, F.lit(2)) == 0
    )
    scanned = (
        summary.withColumn("_last_side", last_side)
        .withColumn("_pinned", pinned)
        .withColumn("_upto", F.sum("n").over(upto))
        .withColumn(
            "_anchor",
            F.when(F.col("_pinned").isNotNull(), F.struct(F.col("_pinned").alias("waits"), "_upto")),
        )
        .withColumn("_anchor", F.last("_anchor", ignorenulls=True).over(before))
        .withColumn("_previous", F.lag("last").over(w))
        .withColumn("_gone", F.lag("_upto").over(w))
    )
    since = F.col("_gone") - F.coalesce(F.col("_anchor._upto"), F.lit(0))
    waits = F.when(F.col("_anchor.waits"), F.pmod(since, F.lit(2)) == 0).otherwise(
        F.pmod(since, F.lit(2)) == 1
    )
    return scanned.filter(F.col("_previous").isNotNull() & waits).select(
        "machineId", segments.SEGMENT, "_previous.*"
    )


def pair_latest(
    state: DataFrame, metrics: DataFrame, order: str | list[str] = "seq", span: int = 3600
) -> DataFrame:
    """Consume-once pairing per machine: a record meets the newest unmatched one of the other side;
    a newer record replaces an unmatched one of its own side.

    ``order`` names what both feeds are merged by, an event time first where there is one: numbers
    given by two feeds are not comparable. At equal values of the first a state record comes before
    a metrics record. The pair carries the order columns of its later record.

    After run ``k`` of equal sides a record waits iff the run has two or more records or none
    waited before it. With ``r`` the last run of two or more, that is ``k - r`` even, or ``k`` odd
    if there is no such run. A pair then forms at each run start that finds a record waiting.
    Segments of the sequence are handled apart; the record a segment inherits is prepended to it.
    """
    first, *rest = segments.order_columns(order)
    merged = [first, "side", *rest]
    events = segments.with_segment(merged_feed(state, metrics, [first, *rest]), first, span)
    runs = _runs(events.unionByName(_inherited(events, merged)), merged)
    w = segments.segment_window(["machineId"], merged)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    k = F.col("_run") - 1
    waiting = F.when(F.col("_r").isNotNull(), F.pmod(k - F.col("_r"), F.lit(2)) == 0).otherwise(
        F.pmod(k, F.lit(2)) == 1
    )
    return (
        runs.withColumn("_r", F.max(F.when(F.col("_repeat"), F.col("_run"))).over(before))
        .withColumn("_state", F.coalesce("state", F.lag("state").over(w)))
        .withColumn("_metrics", F.coalesce("metrics", F.lag("metrics").over(w)))
        .filter((F.col("_run") > 1) & ~F.col("_repeat") & waiting)
        .select(
            "machineId", first, *rest, F.col("_state").alias("state"), F.col("_metrics").alias("metrics")
        )
    )


def low_frequency_record(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """The low-frequency fields of each pair plus its alarm code."""
    s, m = "state", "metrics"
    return pairs.select(
        *keep,
        "machineId",
        *[f"{s}.{c}" for c in ("duration_seconds", "is_running", "is_standby", "is_offline")],
        *[f"{m}.{c}" for c in ("cutting_time", "cycle_time", "total_parts", "spindle_load")],
        *[f"{m}.{c}" for c in ("cumulative_runtime", "cumulative_parts")],
        f"{s}.cumulative_alarms",
        *[f"{m}.{c}" for c in ("avg_spindle_load_10", "avg_cutting_time_10")],
        f"{s}.isAlarm",
    )


def translate_alarm(records: DataFrame, code: str = "isAlarm", name: str = "alarmMessage") -> DataFrame:
    """Add the dictionary message of an alarm code; '' without a code."""
    dictionary = F.broadcast(alarm_dictionary(records.sparkSession))
    has_code = F.coalesce(F.col(code), F.lit("")) != ""
    message = F.when(
        has_code, F.coalesce("message", F.concat(F.lit(UNKNOWN_ALARM_PREFIX), F.col(code)))
    ).otherwise("")
    return (
        records.join(dictionary, F.col(code) == F.col("code"), "left")
        .withColumn(name, message)
        .drop("code", "message")
    )


def attach_features(records: DataFrame, features: DataFrame, time_column: str) -> DataFrame:
    """Fill the seven ``*_win`` fields with the latest window closed by the record's time, else 0."""
    found = asof_left(
        records, features, "machineId", time_column, "window_end", WINDOW_FEATURES
    )
    return fill_window_fields(found)


def fill_window_fields(found: DataFrame) -> DataFrame:
    others = [c for c in found.columns if c not in WINDOW_FEATURES]
    return found.select(
        *others,
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(name) for c, name in FEATURE_FIELDS.items()],
    )


def feature_records(
    state: DataFrame, metrics: DataFrame, features: DataFrame, order: list[str], span: int = 3600
) -> DataFrame:
    """Pairs, translated and enriched. ``order`` is the event time of both feeds and what follows it; a
    pair's time is that of its later record."""
    time_of, *rest = order
    pairs = pair_latest(state, metrics, order, span)
    timed = low_frequency_record(pairs, order)
    return attach_features(translate_alarm(timed), features, time_of).select(*rest, *FEATURE_RECORD)


def feature_json(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct(*FEATURE_RECORD)).alias("value"))


def trailing_ten(metrics: DataFrame, order: str | list[str] = "seq", span: int = 3600) -> DataFrame:
    """Means over the last ten records per machine, to one decimal."""
    names = {"avg_spindle_load_10": "spindle_load", "avg_cutting_time_10": "cutting_time"}
    bare = metrics.drop(*names)
    out = segments.trailing_means(bare, ["machineId"], order, names, 10, span)
    for name in names:
        out = out.withColumn(name, fn.round_half_up(name, 1))
    return out


def running_totals(
    records: DataFrame, sums: dict, order: str | list[str] = "seq", span: int = 3600
) -> DataFrame:
    return segments.running_sums(records, ["machineId"], order, sums, span)
