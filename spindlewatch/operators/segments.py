"""Ordered computations per machine without one task per machine.

A machine may own a third of all rows, so nothing here sorts all rows of a machine in one task. The
rows of every machine are cut into segments by the first column of the order: ``span`` seconds of a
time, or ``span`` numbers of a sequence. Each segment is computed on its own; what it needs from the
rows before it (a running total, the last few rows) comes from one small summary per machine and
segment, scanned per machine. Results do not depend on ``span``. Everything is a plain lazy plan: no
sampling, no counting beforehand, no materialised intermediate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = "_segment"


def order_columns(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def with_segment(df: DataFrame, order: str | Sequence[str], span: int) -> DataFrame:
    """Add ``SEGMENT``: which ``span`` seconds (or numbers) the first order column falls into."""
    first = order_columns(order)[0]
    at = F.col(first)
    if isinstance(df.schema[first].dataType, T.TimestampType):
        at = F.unix_micros(first) / 1_000_000
    return df.withColumn(SEGMENT, _segment_of(at, span))


def _segment_of(at: Column, span: int) -> Column:
    return F.floor(at / F.lit(span)).cast("bigint")


def segment_window(keys: Sequence[str], order: str | Sequence[str]):
    return W.partitionBy(*keys, SEGMENT).orderBy(*order_columns(order))


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], sums: dict[str, Column], span: int
) -> DataFrame:
    """Add inclusive running sums ``{name: column}`` per key in ``order``."""
    seg = with_segment(df, order, span)
    for name, column in sums.items():
        seg = seg.withColumn(f"_in_{name}", column)
    before = W.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        seg.groupBy(*keys, SEGMENT)
        .agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums])
        .select(*keys, SEGMENT, *[F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in sums])
    )
    upto = segment_window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    inner = seg
    for name in sums:
        inner = inner.withColumn(name, F.sum(f"_in_{name}").over(upto))
    joined = inner.join(carry, [*keys, SEGMENT], "left")
    return joined.select(
        *df.columns,
        *[(F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def preceding_rows(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], columns: Sequence[str], n: int
) -> DataFrame:
    """For every segment, copies of the ``n`` rows before its first row (all of them, if fewer).

    ``df`` carries ``SEGMENT`` already. Only the last ``n`` rows of each segment are looked at: the
    rank limit is applied before the shuffle, so few rows move.
    """
    orders = order_columns(order)
    back = W.partitionBy(*keys, SEGMENT).orderBy(*[F.desc(c) for c in orders])
    tails = (
        df.select(*keys, SEGMENT, *orders, *columns)
        .withColumn("_back", F.row_number().over(back))
        .filter(F.col("_back") <= n)
    )
    w = W.partitionBy(*keys).orderBy(SEGMENT, *orders)
    return (
        tails.withColumn("_previous", F.lag(SEGMENT).over(w))
        .withColumn(
            "_halo", F.collect_list(F.struct(*orders, *columns)).over(w.rowsBetween(-n, -1))
        )
        .filter(F.col("_previous") < F.col(SEGMENT))
        .select(*keys, SEGMENT, F.inline("_halo"))
    )


def trailing_means(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    means: dict[str, str],
    rows: int,
    span: int,
) -> DataFrame:
    """Add means ``{name: column}`` over the current and the ``rows - 1`` rows before it."""
    seg = with_segment(df, order, span)
    columns = list(dict.fromkeys(means.values()))
    halo = preceding_rows(seg, keys, order, columns, rows - 1)
    both = seg.withColumn("_own", F.lit(True)).unionByName(
        halo.withColumn("_own", F.lit(False)), allowMissingColumns=True
    )
    w = segment_window(keys, order).rowsBetween(-(rows - 1), 0)
    for name, column in means.items():
        both = both.withColumn(name, F.avg(column).over(w))
    return both.filter("_own").select(*df.columns, *means)


#: Segments of the whole table whose summaries meet in one task, before blocks of them do.
BLOCK_SEGMENTS = 4096


def running_max_before(df: DataFrame, order: str, column: str, name: str, span: int) -> DataFrame:
    """Add the maximum of ``column`` over all rows before the current one, over the whole table.

    The maximum so far is carried over segments within a block, and over blocks; only one row for each
    ``span * BLOCK_SEGMENTS`` rows of the table meets in a single task.
    """
    seg = df.withColumn(SEGMENT, _segment_of(F.col(order), span))
    sums = seg.groupBy(SEGMENT).agg(F.max(column).alias("_max")).withColumn("_block", _segment_of(F.col(SEGMENT), BLOCK_SEGMENTS))
    inner = W.partitionBy("_block").orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    outer = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        sums.groupBy("_block").agg(F.max("_max").alias("_max"))
        .select("_block", F.max("_max").over(outer).alias("_before"))
    )
    carry = (
        sums.select("_block", SEGMENT, F.max("_max").over(inner).alias("_within")).join(blocks, "_block")
        .select(SEGMENT, F.greatest("_within", "_before").alias("_carry"))
    )
    inside = W.partitionBy(SEGMENT).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    joined = seg.withColumn("_inside", F.max(column).over(inside)).join(carry, SEGMENT, "left")
    return joined.select(*df.columns, F.greatest("_inside", "_carry").alias(name))
