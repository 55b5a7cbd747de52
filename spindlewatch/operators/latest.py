"""Latest row per key, and merging an offline table with realtime rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key, the last in ``order``.

    The rank filter is pushed below the shuffle as a per-task group limit, so copies of one
    hot key are thinned to one row per task before they move.
    """
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def newest_by_key(df: DataFrame, keys: Sequence[str], time: str, order: str) -> DataFrame:
    """``latest_by_key`` for few keys over many rows: one hash aggregate finds each key's newest
    time, and only rows of that time are ranked. Nothing large is sorted or shuffled: the peaks are
    few enough for Spark to broadcast (it measures them and otherwise shuffles)."""
    peaks = df.groupBy(*keys).agg(F.max(time).alias(time))
    return latest_by_key(df.join(peaks, [*keys, time], "left_semi"), keys, [order])


def last_value_by_key(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Narrow form of ``latest_by_key``: the last value of one column per key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def merge_offline_realtime(
    offline: DataFrame, realtime: DataFrame, keys: Sequence[str], order: Sequence[str], time: str | None = None
) -> DataFrame:
    """Both tables as one, a realtime row replacing the offline row of the same key.

    The offline table holds one row per key, as upserts keep it; of several realtime rows the last in ``order`` counts. Offline
    rows are neither shuffled nor sorted as a whole: with ``time``, one of the keys, those outside the span of realtime times pass
    straight through (the range filter reaches the scan), and only the rest meet the realtime keys, in an anti join.
    """
    newest = latest_by_key(realtime, keys, order).withColumn("source", F.lit("realtime"))
    tagged = offline.withColumn("source", F.lit("offline"))
    parts = [newest]
    near = tagged
    if time is not None:
        span = realtime.agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
        inside = F.col(time).between(span.select("_from").scalar(), span.select("_to").scalar())
        near = tagged.filter(inside)
        parts.append(tagged.filter(~F.coalesce(inside, F.lit(False))))
    parts.append(near.join(newest.select(*keys), [*keys], "left_anti"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def latest_rows(df: DataFrame, order: Sequence, limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)
