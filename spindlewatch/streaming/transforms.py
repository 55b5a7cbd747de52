"""Stream forms of the operators that need ordered state; the rest run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewatch.operators import features, status, windows
from spindlewatch.schemas import FEATURE_RECORD, WINDOW_FEATURES
from spindlewatch.streaming import processors as p

#: Values that a window takes over from the one before a short gap.
HELD = ["max_temperature", "avg_vib_rms", "current_fluctuation"]


def _schema(df: DataFrame, columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])


def asof_stream(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    values: list[str],
    order: str,
    salts: int = 1,
    delay: str | None = None,
) -> DataFrame:
    """As-of left lookup between two streams.

    With ``delay`` the inputs have no watermark yet and get one together, so that a silent right side
    does not hold back the left one; without, they share a watermark already (``watermarks.together``).
    A machine's rows pass one task, whose memory stays bounded, and no row is copied. Where right rows are few beside left ones, ``salts``
    spreads the left rows of a key over that many state partitions, at the price of as many copies of each right row in shuffle and state.
    """
    salt = F.pmod(F.xxhash64(order), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0)
    kept = [c for c in left.columns if c not in (key, left_time)]
    lefts = left.select(
        F.col(left_time).alias(p.TIME), key, F.lit(1).cast("tinyint").alias(p.SIDE), F.col(order).cast("bigint").alias(p.RANK),
        salt.alias("key_salt"), p.packed(left, kept).alias(p.PAYLOAD),
    )
    rights = right.select(
        F.col(right_time).alias(p.TIME), key, F.lit(0).cast("tinyint").alias(p.SIDE), F.col(order).cast("bigint").alias(p.RANK),
        copies.alias("key_salt"), p.packed(right, values).alias(p.PAYLOAD),
    )
    both = lefts.unionByName(rights)
    if delay:
        both = both.withWatermark(p.TIME, delay)
    # at equal times a right row counts before a left one
    both = both.withColumn(p.RANK, F.col(p.SIDE).cast("bigint") * (1 << 62) + F.col(p.RANK)).withColumn(p.US, F.unix_micros(p.TIME))
    found = p.run_vector(both, [key, "key_salt"], p.LatestValue([key, "key_salt"]), ["left", "right"])
    own = [c for c in kept if c not in values]
    return found.select(
        key, F.col(p.TIME).alias(left_time), *p.unpacked("left", _schema(left, own)), *p.unpacked("right", _schema(right, values))
    )


def status_stream(
    sensor: DataFrame, changes: DataFrame, start_speed: float = 1000.0, delay: str | None = None
) -> DataFrame:
    """Machine status of each reading; '' before the machine's first change. For ``delay`` see ``asof_stream``."""
    found = asof_stream(
        sensor, status.valid_changes(changes), "machine_id", "timestamp", "start_time", ["status"], "seq", delay=delay
    )
    found = found.withColumn("status", F.coalesce("status", F.lit("")))
    return status.status_record(found, start_speed, ["seq"])


def pair_sides(
    state: DataFrame, metrics: DataFrame, order: str, time_column: str
) -> tuple[DataFrame, dict[int, T.StructType]]:
    """Both sides in one stream of packed records, and the columns packed of each side."""
    shared = ["machineId", time_column]
    held = {features.STATE: state, features.METRICS: metrics}
    schemas = {side: _schema(rows, [c for c in rows.columns if c not in shared]) for side, rows in held.items()}
    sides = [
        rows.select(
            "machineId", F.col(time_column).alias(p.TIME), F.lit(side).cast("tinyint").alias(p.SIDE),
            # as in the batch form: by time, then side, then number
            (F.lit(side).cast("bigint") * (1 << 62) + F.col(order)).alias(p.RANK), p.packed(rows, schemas[side].fieldNames()).alias(p.PAYLOAD),
            F.unix_micros(time_column).alias(p.US),
        )
        for side, rows in held.items()
    ]
    return sides[0].unionByName(sides[1]), schemas


def pair_columns(paired: DataFrame, schemas: dict[int, T.StructType], order: str, time_column: str) -> DataFrame:
    """Pairs of packed texts (``left`` a state, ``right`` a metrics record, ``last`` the later side) as ``pair_latest`` gives them."""
    names = {features.STATE: ("left", "state"), features.METRICS: ("right", "metrics")}
    wide = paired.select(
        "machineId", F.col(p.TIME).alias(time_column), "last",
        *[F.struct(*p.unpacked(text, schemas[side])).alias(name) for side, (text, name) in names.items()],
    )
    # the pair's number is that of the later record
    number = F.when(F.col("last") == str(features.STATE), F.col("state")[order]).otherwise(F.col("metrics")[order])
    return wide.select("machineId", number.alias(order), time_column, *[
        F.struct(*[F.col(name)[c].alias(c) for c in schemas[side].fieldNames() if c != order]).alias(name)
        for side, (_, name) in names.items()
    ])


def pair_stream(
    state: DataFrame, metrics: DataFrame, order: str, time_column: str, delay: str | None = None
) -> DataFrame:
    """Consume-once pairing of two streams; ``time_column`` is the later record's time. For ``delay`` see ``asof_stream``.

    A machine's records pass one task in order; ``pair_segments`` has the form that splits them.
    """
    both, schemas = pair_sides(state, metrics, order, time_column)
    if delay:
        both = both.withWatermark(p.TIME, delay)
    paired = p.run_vector(both, ["machineId"], p.LatestPairing(["machineId"]), ["left", "right", "last"])
    return pair_columns(paired, schemas, order, time_column)


def feature_record_stream(
    state: DataFrame, metrics: DataFrame, highfreq: DataFrame, order: str = "seq", time_column: str = "event_time"
) -> DataFrame:
    """22-field records: pairs, translated, with the latest closed window's features. The three streams
    share a watermark (``watermarks.together``)."""
    pairs = pair_stream(state, metrics, order, time_column)
    records = features.translate_alarm(
        features.low_frequency_record(pairs, [order, time_column])
    )
    windowed = features.window_features(highfreq).select(
        "machineId", F.col("window_end").alias("closed_at"), F.lit(0).cast("bigint").alias(order),
        *WINDOW_FEATURES,
    )
    found = asof_stream(
        records, windowed, "machineId", time_column, "closed_at", WINDOW_FEATURES, order
    )
    return features.fill_window_fields(found).select(order, *FEATURE_RECORD)


def filled_window_stream(
    sensor: DataFrame, size: str = "1 minute", label: str = "1m", min_gap: int = 1, max_gap: int = 5
) -> DataFrame:
    """Closed windows with gap fill, each with the vibration of the window before it."""
    closed = windows.window_metrics(sensor, size, label)
    kept = [c for c in closed.columns if c != "machine_id"]
    rows = closed.select(
        "machine_id", F.col("window_end").alias(p.TIME), F.unix_micros("window_end").alias(p.US), F.lit(0).cast("bigint").alias(p.RANK),
        F.lit(0).cast("tinyint").alias(p.SIDE), p.packed(closed, kept).alias(p.PAYLOAD),
    )
    found = p.run_vector(rows, ["machine_id"], p.HoldAndSpike(["machine_id"], min_gap, max_gap), ["left", "right", "before"])
    own = dict(zip(kept, p.unpacked("left", _schema(closed, kept)), strict=True))
    held = dict(zip(HELD, p.unpacked("right", _schema(closed, HELD)), strict=True))
    previous = p.unpacked("before", _schema(closed, ["avg_vib_rms"]))[0].alias("previous_vib_rms")
    return found.select(*[F.col(c) if c == "machine_id" else {**own, **held}[c] for c in closed.columns], previous)


def spike_stream(filled: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Spike alerts from ``filled_window_stream``."""
    previous = F.col("previous_vib_rms")
    change = F.abs(F.col("avg_vib_rms") - previous) / previous
    return (
        filled.filter(previous > 0)
        .withColumn("_change", change)
        .filter(F.col("_change") >= ratio)
        .select(*windows.spike_alert_columns(F.col("_change")))
    )


def interpolate_stream(
    sensor: DataFrame, columns: list[str], order: str = "seq", step_seconds: int = 1, max_gap_seconds: int = 5
) -> DataFrame:
    """Readings between the given ones across gaps of up to ``max_gap_seconds``, of a stream watermarked on ``timestamp``;
    missing values count as 0, as the parsers give them."""
    readings = sensor.select(
        "machine_id", F.col("timestamp").alias(p.TIME), (F.unix_millis("timestamp") * 1000).alias(p.US),
        F.coalesce(F.col(order).cast("bigint"), F.lit(-1)).alias(p.RANK), F.lit(0).cast("tinyint").alias(p.SIDE), F.lit("").alias(p.PAYLOAD),
        F.unix_micros("timestamp").alias("at_us"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns],
    )
    output = T.StructType([T.StructField("us", T.LongType()), *_schema(readings, columns)])
    processor = p.Interpolate(["machine_id"], columns, step_seconds * 1_000_000, max_gap_seconds * 1_000_000)
    # rows come out between readings, some before the watermark: they carry no event time for operators above
    found = p.run_vector(readings, ["machine_id"], processor, output)
    return found.select("machine_id", F.timestamp_micros("us").alias("timestamp"), *columns)


def throttle_stream(
    rows: DataFrame, time_column: str, columns: list[str], order: str = "seq", interval: int = 60
) -> DataFrame:
    """Rows let through by the throttle, with ``columns``, of a stream watermarked on ``time_column``."""
    kept = [order, *columns]
    taken = rows.select(
        "machine_id", F.col(time_column).alias(p.TIME), F.unix_micros(time_column).alias(p.US), F.col(order).cast("bigint").alias(p.RANK),
        F.lit(1).cast("tinyint").alias(p.SIDE), p.packed(rows, kept).alias(p.PAYLOAD),
    )
    passed = p.run_vector(taken, ["machine_id"], p.Throttle(["machine_id"], interval), ["left"])
    unpacked = dict(zip(kept, p.unpacked("left", _schema(rows, kept)), strict=True))
    return passed.select("machine_id", unpacked[order], F.col(p.TIME).alias(time_column), *[unpacked[c] for c in columns])


def health_stream(
    sensor: DataFrame, changes: DataFrame, interval: int = 60, start_speed: float = 1000.0
) -> DataFrame:
    """Throttled health snapshot: readings are throttled first, and only those let through go on to
    the status lookup. The two streams share a watermark (``watermarks.together``)."""
    readings = throttle_stream(
        sensor, "timestamp", ["temperature", "vibration_x", "speed"], "seq", interval
    )
    return status_stream(readings, changes, start_speed).select(
        "machine_id", "update_time", "machine_status", "health_score"
    )
