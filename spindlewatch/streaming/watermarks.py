"""Watermarks of streams that are used together.

A query's watermark is the least of its watermark nodes'. If two feeds carry one each, a feed that falls silent, as sparse
ones do, holds back everything. Feeds that are joined or merged therefore share one watermark on the union of their times:
it follows the newest record of any feed. What it costs: a feed that lags behind the others by more than the delay has its late
records dropped, so the delay (``watermark_seconds``) must cover the lag between feeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.config import Settings


def delay_of(rows: DataFrame) -> str:
    return f"{Settings.from_spark(rows.sparkSession).watermark_seconds} seconds"


def marked(rows: DataFrame, column: str) -> DataFrame:
    """A stream with a watermark of its own."""
    return rows.withWatermark(column, delay_of(rows))


def together(*feeds: tuple[DataFrame, str]) -> list[DataFrame]:
    """Streams (rows, time column) as they are, all with the one watermark of their union.

    For feeds that pass through operators of their own before they meet; feeds that meet at once are
    better united first, which reads each only once.
    """
    tagged = [
        rows.select(
            F.col(column).alias("_time"), F.lit(i).alias("_feed"),
            F.struct(*[c for c in rows.columns if c != column]).alias(f"_row{i}"),
        )
        for i, (rows, column) in enumerate(feeds)
    ]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    union = union.withWatermark("_time", delay_of(union))
    out = []
    for i, (rows, column) in enumerate(feeds):
        # the time is part of the condition: else the filter would move below the union and undo it
        own = union.filter(F.when(F.col("_time").isNotNull(), F.col("_feed")) == i)
        out.append(
            own.select(*[F.col("_time").alias(c) if c == column else F.col(f"_row{i}.`{c}`").alias(c) for c in rows.columns])
        )
    return out
