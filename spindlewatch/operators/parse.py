"""Text feeds to typed rows, with a quarantine for lines that cannot be read.

Every parser takes a batch or streaming DataFrame with a string column ``value`` and passes the
other columns through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewatch import schemas
from spindlewatch.functions import columns as fn

_CORRUPT = "_corrupt_record"
# one or two digits for each part but the year, and up to nine of a fraction
TIME_FORMAT = "yyyy-M-d H:m:s[.SSSSSSSSS]"


def _once(c: Column) -> Column:
    """Value computed in its own step: exploding a one-element array keeps the optimizer from
    repeating an expensive expression at every use."""
    return F.explode(F.array(c))


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Add ``_raw`` (fields as text), ``_num`` (numbers, null if absent or unreadable), ``_bad``.

    Fields are read as text first: a typed ``from_json`` loses quoted numbers and decimals in
    integer fields.
    """
    text_schema = T.StructType(
        [T.StructField(f.name, T.StringType()) for f in schema]
        + [T.StructField(_CORRUPT, T.StringType())]
    )
    raw = F.from_json("value", text_schema, {"columnNameOfCorruptRecord": _CORRUPT})
    numeric = [f for f in schema if not isinstance(f.dataType, T.StringType)]
    numbers = F.struct(
        *[fn.number_or_null(F.col(f"_raw.{f.name}"), f.dataType.simpleString()).alias(f.name) for f in numeric]
    )
    # an empty or blank line parses to a null struct
    bad = F.col("_raw").isNull() | F.col(f"_raw.{_CORRUPT}").isNotNull()
    for f in numeric:
        bad |= F.col(f"_num.{f.name}").isNull() & _present(F.col(f"_raw.{f.name}"))
    return (
        lines.select("*", _once(raw).alias("_raw"))
        .select("*", _once(numbers).alias("_num"))
        .withColumn("_bad", F.coalesce(bad, F.lit(True)))
    )


def _present(text: Column) -> Column:
    """An empty or ``null`` text counts as a missing field."""
    return text.isNotNull() & ~F.trim(text).isin("", "null")


def _field(f: T.StructField, missing: str) -> Column:
    if isinstance(f.dataType, T.StringType):
        return F.col(f"_raw.{f.name}").alias(f.name)
    value = F.col(f"_num.{f.name}")
    if missing == "zero":
        value = F.coalesce(value, F.lit(0).cast(f.dataType))
    return value.alias(f.name)


def parse_json(
    lines: DataFrame, schema: T.StructType, missing: str = "zero"
) -> DataFrame:
    """Readable lines as typed columns; ``missing`` is ``'zero'`` or ``'null'`` for numbers."""
    if missing not in ("zero", "null"):
        raise ValueError(f"missing must be 'zero' or 'null', not {missing!r}")
    keep = [c for c in lines.columns if c != "value"]
    good = _parsed(lines, schema).filter(~F.col("_bad"))
    return good.select(*keep, *[_field(f, missing) for f in schema])


def quarantine(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The lines ``parse_json`` leaves out, unchanged."""
    return _parsed(lines, schema).filter("_bad").select(*lines.columns)


def with_timestamp(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", fn.epoch_ms_to_timestamp("ts"))


def parse_sensor_raw(lines: DataFrame, missing: str = "zero") -> DataFrame:
    return with_timestamp(parse_json(lines, schemas.SENSOR_RAW, missing))


def parse_log_raw(lines: DataFrame, missing: str = "zero") -> DataFrame:
    return with_timestamp(parse_json(lines, schemas.LOG_RAW, missing))


def parse_device_state(lines: DataFrame, missing: str = "zero") -> DataFrame:
    parsed = parse_json(lines, schemas.DEVICE_STATE, missing)
    return parsed.withColumn("isAlarm", F.coalesce("isAlarm", F.lit("")))


def parse_sensor_metrics(lines: DataFrame, missing: str = "zero") -> DataFrame:
    return parse_json(lines, schemas.SENSOR_METRICS, missing)


def parse_highfreq_sensor(lines: DataFrame, missing: str = "zero") -> DataFrame:
    """The timestamp stays text in the record; ``event_time`` holds it parsed."""
    parsed = parse_json(lines, schemas.HIGHFREQ_SENSOR, missing)
    return parsed.withColumn("event_time", F.col("timestamp").try_cast("timestamp"))


def parse_change_record(lines: DataFrame) -> DataFrame:
    """Comma line: field 1 machine, 3 status, 4 and 5 times; anything short or unparsable drops."""
    parts = F.split("value", ",", -1)
    keep = [c for c in lines.columns if c != "value"]

    def time_at(i: int) -> Column:
        return F.try_to_timestamp(F.get(parts, F.lit(i)), F.lit(TIME_FORMAT))

    return lines.select(
        *keep,
        F.get(parts, F.lit(1)).alias("machine_id"),
        F.get(parts, F.lit(3)).alias("status"),
        time_at(4).alias("start_time"),
        time_at(5).alias("end_time"),
    ).filter("start_time IS NOT NULL AND end_time IS NOT NULL")


def tag_feed(lines: DataFrame, topic_type: str) -> DataFrame:
    return lines.withColumn("topic_type", F.lit(topic_type))
