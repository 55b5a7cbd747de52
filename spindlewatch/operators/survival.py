"""Remaining life with windows that have not failed yet, and calibrated failure probabilities.

A window without a later failure says that the machine has lived at least until the log's end. Leaving such windows out, as labels
by the next failure do, trains on the unhealthy ones only; here they are censored observations.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindlewatch.operators.scoring import hours_to_next_failure, training_rows
from spindlewatch.schemas import WINDOW_FEATURES


def observed_lives(
    features: DataFrame, log: DataFrame, code: str = "999", hour_seconds: float = 3600.0
) -> DataFrame:
    """Every window with ``life_hours`` from its end: to the machine's next failure (``failed``), or to the log's last line."""
    key = ["machineId", "window_start"]
    failed = hours_to_next_failure(features, log, code, "life_hours", hour_seconds).select(*key, "life_hours")
    last = log.agg(F.unix_micros(F.max("timestamp")).alias("_last")).scalar()
    rest = F.greatest(F.lit(0.0), (last - F.unix_micros("window_end")) / (hour_seconds * 1e6))
    return (
        features.join(failed, key, "left")
        .withColumn("failed", F.col("life_hours").isNotNull())
        .withColumn("life_hours", F.coalesce("life_hours", rest))
    )


def survival_curve(lives: DataFrame, group: Column, step_hours: float) -> DataFrame:
    """Kaplan-Meier curve per group: ``after_hours``, at_risk, failures, censored, ``survival`` behind that time.

    Lives are counted in steps of ``step_hours`` first (failures of a step come before its censorings), so the ordered rows of a group
    are steps.
    """
    steps = (
        lives.groupBy(group.alias("grp"), (F.floor(F.col("life_hours") / step_hours) * F.lit(float(step_hours))).alias("after_hours"))
        .agg(F.count_if("failed").alias("failures"), F.count_if(~F.col("failed")).alias("censored"))
    )
    by = W.partitionBy("grp").orderBy("after_hours")
    rest = by.rowsBetween(0, W.unboundedFollowing)
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    at_risk = F.sum(F.col("failures") + F.col("censored")).over(rest)
    kept = F.when(F.col("failures") < F.col("at_risk"), F.log(1 - F.col("failures") / F.col("at_risk")))
    none_left = F.max(F.col("failures") == F.col("at_risk")).over(upto)
    return (
        steps.withColumn("at_risk", at_risk)
        .withColumn("survival", F.when(none_left, 0.0).otherwise(F.exp(F.sum(kept).over(upto))))
        .select("grp", "after_hours", "at_risk", "failures", "censored", "survival")
    )


def fit_lives(lives: DataFrame) -> PipelineModel:
    """Accelerated-failure-time regression on the training windows, censored ones included; lives of zero count as a tenth of a second."""
    rows = training_rows(lives).withColumns({
        "_life": F.greatest(F.col("life_hours"), F.lit(0.1 / 3600)), "_seen": F.col("failed").cast("double"),
    })
    return Pipeline(stages=[
        VectorAssembler(inputCols=WINDOW_FEATURES, outputCol="_features"),
        AFTSurvivalRegression(featuresCol="_features", labelCol="_life", censorCol="_seen", predictionCol="rul_value"),
    ]).fit(rows)


def reliability(scored: DataFrame, score: str, fails: Column, bins: int = 20) -> DataFrame:
    """One row per bin of the score (0 to 1): n, mean score, observed rate, and ``calibrated``, the isotonic fit of the rates.

    The fit is the one of pooling adjacent violators, in its closed form: for bin i the largest, over first bins j <= i, of the least,
    over last bins k >= i, mean from j to k. At most ``bins`` rows are gathered.
    """
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    rows = scored.filter(F.col(score).isNotNull()).groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fails).alias("failures"), F.avg(score).alias("mean_score")
    )
    all_rows = rows.agg(F.array_sort(F.collect_list(F.struct("bin", "n", "failures", "mean_score"))).alias("b"))

    def total(j, k, what):
        part = F.slice("b", j + 1, k - j + 1)
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x[what])

    size = F.size("b")

    def fitted(i):
        def least(j):
            return F.array_min(F.transform(F.sequence(i, size - 1), lambda k: total(j, k, "failures") / total(j, k, "n")))

        return F.array_max(F.transform(F.sequence(F.lit(0), i), least))

    solved = all_rows.filter(size > 0).select(
        F.inline(F.transform("b", lambda x, i: F.struct(
            x["bin"].alias("bin"), x["n"].alias("n"), x["failures"].alias("failures"), x["mean_score"].alias("mean_score"), fitted(i).alias("calibrated"),
        )))
    )
    return solved.select("bin", "n", "failures", "mean_score", (F.col("failures") / F.col("n")).alias("observed_rate"), "calibrated")


def with_calibrated(scored: DataFrame, table: DataFrame, score: str, name: str, bins: int = 20) -> DataFrame:
    """``name``: the calibrated value of the score's bin, or of the next lower bin that the table has (else the next higher)."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    known = table.agg(F.array_sort(F.collect_list(F.struct("bin", "calibrated"))).alias("t")).scalar()
    below = F.filter("_known", lambda x: x["bin"] <= place)
    value = F.coalesce(F.try_element_at(below, F.lit(-1))["calibrated"], F.try_element_at("_known", F.lit(1))["calibrated"])
    return scored.withColumn("_known", known).withColumn(name, value).drop("_known")


def brier(scored: DataFrame, score: str, fails: Column) -> Column:
    """Mean squared distance of a probability from what happened; smaller is better."""
    return F.avg(F.pow(F.col(score) - F.when(fails, 1.0).otherwise(0.0), F.lit(2.0)))
