"""As-of left lookup: each row takes the latest right-hand row not after it.

Both sides go into one union, cut into segments of ``span`` seconds per key, and a window inside each segment carries the last
right value forward: one shuffle and one sort, the left side read once, and no list in a cell. What a segment
needs from before it is one carry row, put in front of it with the union. Carry rows come from the right side alone: the last
value of each segment is copied to the silent ones behind it, within a block of ``BLOCK`` segments, and values from earlier
blocks are looked up in one small row per key. A hot key is thus spread over its segments, a segment with any number of
changes is sorted like other rows, and a wrong time far away costs no more than a block. Results do not depend on the span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 3600
BLOCK = 1024
_CARRY, _RIGHT, _LEFT = 0, 1, 2


def _segment(time: Column | str, span: int) -> Column:
    return F.floor(F.unix_micros(time) / F.lit(span * 1_000_000)).cast("bigint")


def _block(segment: str) -> Column:
    return F.floor(F.col(segment) / F.lit(BLOCK)).cast("bigint")


def asof_left(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    values: list[str],
    right_order: str | None = None,
    span: int = SPAN,
) -> DataFrame:
    """``left`` plus the columns ``values`` of the latest ``right`` row with time <= left time.

    Among right rows of equal key and time the largest ``right_order`` wins. Values are null where
    no right row exists yet, and for left rows without a key or time.
    """
    value = F.struct(*values)
    rank = F.col(right_order) if right_order else value
    changes = (
        right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull())
        .groupBy(F.col(key).alias("_k"), F.col(right_time).alias("_t"))
        .agg(F.max_by(value, rank).alias("_v"))
        .withColumn("_seg", _segment("_t", span))
    )
    ends = changes.groupBy("_k", "_seg").agg(F.max_by("_v", "_t").alias("_v"))
    blocks = ends.groupBy("_k", _block("_seg").alias("_b")).agg(F.max_by("_v", "_seg").alias("_v"))
    earlier = blocks.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_b", "_v"))).alias("_earlier"))

    following = F.lead("_seg").over(W.partitionBy("_k", "_b").orderBy("_seg"))
    upto = F.coalesce(following, (F.col("_b") + 1) * BLOCK - 1)
    carry = (
        ends.withColumn("_b", _block("_seg")).withColumn("_upto", upto).filter(F.col("_upto") > F.col("_seg"))
        .select("_k", F.explode(F.sequence(F.col("_seg") + 1, F.col("_upto"))).alias("_seg"), "_v")
    )
    row = F.struct(*[F.col(c) for c in left.columns])
    lefts = left.select(
        F.col(key).alias("_k"), _segment(left_time, span).alias("_seg"), F.col(left_time).alias("_t"), F.lit(_LEFT).alias("_side"), row.alias("_row")
    )
    rights = changes.select("_k", "_seg", "_t", F.lit(_RIGHT).alias("_side"), "_v")
    carries = carry.select(
        "_k", "_seg", F.timestamp_micros(F.col("_seg") * (span * 1_000_000)).alias("_t"), F.lit(_CARRY).alias("_side"), "_v"
    )
    both = lefts.unionByName(rights, allowMissingColumns=True).unionByName(carries, allowMissingColumns=True)
    so_far = W.partitionBy("_k", "_seg").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(so_far)).filter(F.col("_side") == _LEFT)
    before = F.filter("_earlier", lambda e: e["_b"] < _block("_seg"))
    out = found.select("_k", "_seg", "_row", "_found").join(earlier, "_k", "left").withColumn(
        "_found", F.coalesce("_found", F.try_element_at(before, F.lit(-1))["_v"])
    )
    return out.select(
        *[F.col("_row")[c].alias(c) for c in left.columns], *[F.col("_found")[v].alias(v) for v in values]
    )
