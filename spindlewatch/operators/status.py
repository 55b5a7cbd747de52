"""Machine state, health score and the throttled health snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.functions import columns as fn
from spindlewatch.operators.asof import asof_left

STATUS_COLUMNS = [
    "machine_id", "update_time", "machine_status", "current_temperature",
    "current_vibration_rms", "health_score",
]


def valid_changes(changes: DataFrame) -> DataFrame:
    return changes.filter("machine_id IS NOT NULL AND status IS NOT NULL")


def with_change_status(sensor: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Add ``status``: the latest change status at the time of the reading, '' before the first."""
    found = asof_left(
        sensor, valid_changes(changes), "machine_id", "timestamp", "start_time", ["status"], order
    )
    return found.withColumn("status", F.coalesce("status", F.lit("")))


def status_record(
    sensor: DataFrame, start_speed: float = 1000.0, keep: Sequence[str] = ()
) -> DataFrame:
    """Status projection of readings that carry ``status``; ``keep`` names columns to pass through.

    ``current_vibration_rms`` is the raw x vibration, as the feed's consumers expect.
    """
    state = fn.machine_state("status", "speed", start_speed)
    return sensor.withColumn("machine_status", state).select(
        *keep,
        "machine_id",
        F.col("timestamp").alias("update_time"),
        "machine_status",
        F.col("temperature").alias("current_temperature"),
        F.col("vibration_x").alias("current_vibration_rms"),
        fn.health_score("machine_status").alias("health_score"),
    )


def machine_status(
    sensor: DataFrame, changes: DataFrame, order: str = "seq", start_speed: float = 1000.0
) -> DataFrame:
    return status_record(with_change_status(sensor, changes, order), start_speed, [order])


#: Blocks put together at a time on the way up and down.
FAN = 24


def _first_from(word: Column, x: Column) -> Column:
    """The set seconds of a word (start, mask) from second ``x`` on, as a mask."""
    shift = F.least(F.greatest(x - word["start"], F.lit(0)), F.lit(63)).cast("int")
    return word["mask"].bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), shift))


def _let_through(word: Column, x: Column) -> Column:
    """The first set second of a word from second ``x`` on; null if there is none."""
    rest = _first_from(word, x)
    return F.when(rest != 0, word["start"] + F.bit_count(rest.bitwiseAND(-rest) - 1))


def _next(word: Column, x: Column, interval: int) -> Column:
    return F.coalesce(_let_through(word, x) + interval, x)


def _composed(parts: str, begin: Column, end: Column, length: int, interval: int) -> Column:
    """For each delay 0 .. interval - 1 at ``begin`` the delay at ``end``, through parts (number, step) of ``length`` seconds."""

    def through(delay):
        behind = F.aggregate(parts, begin + delay, lambda x, part: _behind(part, x, length))
        return F.greatest(behind - end, F.lit(0)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(interval - 1)), through)


def _behind(part: Column, x: Column, length: int) -> Column:
    delay = F.greatest(x - part["number"] * length, F.lit(0)).cast("int")
    return (part["number"] + 1) * length + F.get(part["step"], delay)


def _entries(parts: Column | str, x: Column, length: int) -> Column:
    """(number, from) of each part: the second from which a row may pass when the part begins."""
    state = F.struct(x.alias("x"), F.array().cast("array<struct<number: bigint, from: bigint>>").alias("out"))
    return F.aggregate(
        parts, state,
        lambda s, part: F.struct(
            _behind(part, s["x"], length).alias("x"),
            F.array_append(s["out"], F.struct(part["number"].alias("number"), s["x"].alias("from"))).alias("out"),
        ),
        lambda s: s["out"],
    )


def throttle_seconds(df: DataFrame, time_column: str, interval: int = 60) -> DataFrame:
    """Greedy throttle per machine: the first record, then the first one ``interval`` whole seconds
    or more after the last one let through. Returns (machine_id, second).

    Records are folded map-side into masks of occupied seconds, words of at most a minute in which at most one record can
    pass. All a stretch of time needs to know is how long the record let through before still holds others back: a
    delay of 0 .. interval - 1 seconds. A block of words is therefore a function from delay to delay. Blocks are computed
    apart from each other, composed to groups of ``FAN``, and only these are chained per machine (one short array a day at the default);
    then the delays go back down, and every block lets its seconds through by itself.
    """
    second = F.floor(F.unix_micros(time_column) / 1_000_000).cast("bigint")
    seconds = df.select("machine_id", second.alias("second")).filter("second IS NOT NULL")
    if interval <= 1:
        return seconds.distinct()
    word = min(60, interval)
    length = word * -(-max(60 * word, interval) // word)
    start = F.floor(F.col("second") / word).cast("bigint") * word
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("second") - start).cast("int"))
    words = seconds.groupBy("machine_id", start.alias("start")).agg(F.bit_or(bit).alias("mask"))
    number = F.floor(F.col("start") / length).cast("bigint")
    blocks = words.groupBy("machine_id", number.alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("start", "mask"))).alias("words")
    )

    def block_step(delay):
        at = F.col("number") * length
        behind = F.aggregate("words", at + delay, lambda x, w: _next(w, x, interval))
        return F.greatest(behind - at - length, F.lit(0)).cast("int")

    stepped = blocks.withColumn("step", F.transform(F.sequence(F.lit(0), F.lit(interval - 1)), block_step))
    wide = FAN * length
    groups = (
        stepped.groupBy("machine_id", F.floor(F.col("number") / FAN).cast("bigint").alias("group"))
        .agg(F.array_sort(F.collect_list(F.struct("number", "step"))).alias("parts"))
    )
    begin = F.col("group") * wide
    chained = (
        groups.select("machine_id", F.col("group").alias("number"), _composed("parts", begin, begin + wide, length, interval).alias("step"))
        .groupBy("machine_id").agg(F.array_sort(F.collect_list(F.struct("number", "step"))).alias("parts"))
        .select("machine_id", F.inline(_entries("parts", F.element_at("parts", 1)["number"] * wide, wide)).alias("group", "from"))
    )
    entered = groups.join(chained, ["machine_id", "group"]).select(
        "machine_id", F.inline(_entries("parts", F.col("from"), length)).alias("number", "from")
    )
    none = F.array().cast("array<bigint>")

    def pass_one(s, w):
        hit = _let_through(w, s["x"])
        return F.struct(
            F.coalesce(hit + interval, s["x"]).alias("x"), F.when(hit.isNotNull(), F.array_append(s["out"], hit)).otherwise(s["out"]).alias("out")
        )

    passed = F.aggregate("words", F.struct(F.col("from").alias("x"), none.alias("out")), pass_one, lambda s: s["out"])
    return blocks.join(entered, ["machine_id", "number"]).select("machine_id", F.explode(passed).alias("second"))


def throttled_rows(df: DataFrame, time_column: str, order: str, interval: int = 60) -> DataFrame:
    """Whole rows at the throttled updates: the first row of each second let through."""
    second = F.floor(F.unix_micros(time_column) / 1_000_000).cast("bigint")
    hits = throttle_seconds(df, time_column, interval)
    first = F.min_by(F.struct(*df.columns), F.struct(time_column, order))
    return (
        df.withColumn("second", second)
        .join(hits, ["machine_id", "second"])
        .groupBy("machine_id", "second")
        .agg(first.alias("_first"))
        .select("_first.*")
    )


def throttled_health(
    sensor: DataFrame, changes: DataFrame, order: str = "seq", interval: int = 60, start_speed: float = 1000.0
) -> DataFrame:
    """The health snapshot at each throttled update. Which readings are let through depends on
    their times alone, so status is looked up only for those few."""
    readings = throttled_rows(sensor, "timestamp", order, interval)
    return machine_status(readings, changes, order, start_speed).select(
        "machine_id", "update_time", "machine_status", "health_score"
    )
