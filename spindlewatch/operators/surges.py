"""Change points in the rate of an error code, by cumulative sums.

The sum S(t) = max(0, S(t-1) + n(t) - drift) forgets nothing too early and nothing too late: it rises as long as a code occurs more
often than its mean by ``slack`` standard deviations of a Poisson count, and a surge is reported while it is above ``limit`` of
them. The recurrence has a closed form, C(t) - min(0, C(0) .. C(t)) with C the plain running sum, so it is two window functions. Only
windows with lines are rows; a silent one takes a drift off C, and the minimum is always reached just before a
window with lines. Ordered rows are a code's windows, whose number is bounded by elapsed time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_counts(log: DataFrame, seconds: int) -> DataFrame:
    return (
        log.groupBy(F.window("timestamp", f"{seconds} seconds").alias("_w"), "error_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("window_start"), "error_code", "n")
    )


def cusum_surges(log: DataFrame, seconds: int = 60, slack: float = 0.5, limit: float = 4.0) -> DataFrame:
    """Windows of a surge: n, ``score`` (the sum), ``score_limit``, and ``began``, the window in which the sum left zero.

    A code's mean is over all windows from the log's first to its last.
    """
    counts = window_counts(log, seconds)
    at = F.unix_seconds("window_start")
    ends = counts.agg(F.min(at).alias("first"), F.max(at).alias("last"))
    first, last = ends.select("first").scalar(), ends.select("last").scalar()
    by_code = W.partitionBy("error_code")
    upto = by_code.orderBy("window_start").rowsBetween(W.unboundedPreceding, 0)
    mean = F.sum("n").over(by_code) / ((last - first) / seconds + 1)
    number = ((at - first) / seconds).cast("bigint")
    summed = (
        counts.withColumn("_mean", mean).withColumn("_drift", F.col("_mean") + F.sqrt("_mean") * slack).withColumn("_t", number)
        .withColumn("_upto", F.sum("n").over(upto))
        .withColumn("_before", F.col("_upto") - F.col("n") - F.col("_drift") * F.col("_t"))
        .withColumn("_after", F.col("_upto") - F.col("_drift") * (F.col("_t") + 1))
        .withColumn("_low", F.least(F.lit(0.0), F.min("_before").over(upto)))
    )
    low = F.when(F.col("_before") <= F.col("_low"), F.col("window_start"))
    began = F.coalesce(F.last(low, ignorenulls=True).over(upto), F.first("window_start").over(upto))
    return (
        summed.withColumn("began", began)
        .withColumn("score", F.col("_after") - F.least("_low", "_after"))
        .withColumn("score_limit", F.sqrt("_mean") * limit)
        .filter("score > score_limit")
        .select("window_start", "error_code", "n", "score", "score_limit", "began")
    )
