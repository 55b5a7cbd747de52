"""Remaining-useful-life scoring of window features, and the risk rules on its result."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindlewatch.functions import columns as fn
from spindlewatch.operators.status import with_change_status
from spindlewatch.schemas import WINDOW_FEATURES

RUL_ALERT = "RUL预警"
RUL_ACTION = "请立即检查设备"


def hours_to_next_failure(
    features: DataFrame, log: DataFrame, code: str = "999", label: str = "rul_hours", hour_seconds: float = 3600.0
) -> DataFrame:
    """Training label: hours from the end of each window to the machine's next ``code`` error.
    ``hour_seconds`` scales the clock of feeds that run faster than real time.

    Errors are folded to the first one per machine-minute, so the ordered rows of a machine
    are minutes; windows with no later error are left out.
    """
    failures = (
        log.filter(F.col("error_code") == code)
        .groupBy(
            F.col("machine_id").cast("int").alias("machineId"),
            F.date_trunc("minute", "timestamp").alias("window_start"),
        )
        .agg(F.min("timestamp").alias("_failure"))
    )
    later = W.partitionBy("machineId").orderBy(F.desc("window_start")).rowsBetween(
        W.unboundedPreceding, -1
    )
    joined = features.join(failures, ["machineId", "window_start"], "full").withColumn(
        "_next", F.last("_failure", ignorenulls=True).over(later)
    )
    hours = (F.unix_micros("_next") - F.unix_micros("window_end")) / (hour_seconds * 1e6)
    return joined.filter("window_end IS NOT NULL AND _next IS NOT NULL").select(
        *features.columns, hours.alias(label)
    )


#: Of so many consecutive windows, the last one is held out of training.
HOLD_OUT = 4


def held_out(window_start: str = "window_start"):
    """Whether a window is kept from training, by its minute."""
    return F.pmod(F.floor(F.unix_seconds(window_start) / 60), F.lit(HOLD_OUT)) == HOLD_OUT - 1


def training_rows(labelled: DataFrame) -> DataFrame:
    return labelled.filter(~held_out())


def linear_models(
    labelled: DataFrame, horizon: float, rul_feature: str = "var_temp", failure_feature: str = "fft_peak", label: str = "rul_hours"
) -> DataFrame:
    """Least-squares lines, one row: remaining life over one feature, and failure within ``horizon`` hours over another."""
    fails = F.when(F.col(label) <= horizon, 1.0).otherwise(0.0)
    return training_rows(labelled).agg(
        F.regr_slope(label, rul_feature).alias("rul_slope"), F.regr_intercept(label, rul_feature).alias("rul_base"),
        F.regr_slope(fails, failure_feature).alias("failure_slope"), F.regr_intercept(fails, failure_feature).alias("failure_base"),
    )


def score_linear(
    models: DataFrame, features: DataFrame, rul_feature: str = "var_temp", failure_feature: str = "fft_peak"
) -> DataFrame:
    """Windows with ``rul_value`` (not below 0), ``failure_probability`` (0 to 1) and ``risk_level`` by ``linear_models``."""

    def line(name: str, feature: str):
        return models.select(f"{name}_base").scalar() + models.select(f"{name}_slope").scalar() * F.col(feature)

    return features.withColumns(
        {
            "rul_value": F.greatest(F.lit(0.0), line("rul", rul_feature)),
            "failure_probability": F.least(F.lit(1.0), F.greatest(F.lit(0.0), line("failure", failure_feature))),
        }
    ).withColumn("risk_level", fn.risk_level("rul_value"))


def fit_failure(labelled: DataFrame, horizon: float, label: str = "rul_hours") -> PipelineModel:
    """Classifier of failure within ``horizon`` hours, on training rows; both classes must occur."""
    rows = training_rows(labelled).withColumn("_fails", F.when(F.col(label) <= horizon, 1.0).otherwise(0.0))
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=WINDOW_FEATURES, outputCol="_failure_features"),
            LogisticRegression(
                featuresCol="_failure_features", labelCol="_fails", probabilityCol="_probability",
                rawPredictionCol="_raw", predictionCol="_fails_predicted", regParam=0.01,
            ),
        ]
    ).fit(rows)


def score_failure(model: PipelineModel, windows: DataFrame) -> DataFrame:
    scored = model.transform(windows)
    probability = vector_to_array("_probability")[1]
    return scored.select(*windows.columns, probability.alias("failure_probability"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_rul(labelled: DataFrame, label: str = "rul_hours", trees: int = 10, depth: int = 3) -> PipelineModel:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=WINDOW_FEATURES, outputCol="_features"),
            GBTRegressor(
                featuresCol="_features", labelCol=label, predictionCol="rul_value",
                maxIter=trees, maxDepth=depth, seed=7,
            ),
        ]
    ).fit(training_rows(labelled))


def score_rul(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Windows with ``rul_value`` (not below 0) and ``risk_level``."""
    scored = model.transform(features).withColumn("rul_value", F.greatest(F.lit(0.0), "rul_value"))
    return scored.select(*features.columns, "rul_value", fn.risk_level("rul_value").alias("risk_level"))


def in_stable_state(
    features: DataFrame, sensor: DataFrame, changes: DataFrame, order: str = "seq", start_speed: float = 1000.0
) -> DataFrame:
    """Feature windows whose machine was in the stable state at its last reading of the window.

    Readings are folded to the last per machine-minute before their status is looked up.
    """
    used = F.struct(*[c for c in sensor.columns if c != "machine_id"])
    last = (
        sensor.groupBy("machine_id", F.date_trunc("minute", "timestamp").alias("window_start"))
        .agg(F.max_by(used, F.struct("timestamp", order)).alias("_last"))
        .select("machine_id", "window_start", "_last.*")
    )
    state = fn.machine_state("status", "speed", start_speed)
    stable = (
        with_change_status(last, changes, order)
        .filter(state == fn.STATE_STABLE)
        .select(F.col("machine_id").cast("int").alias("machineId"), "window_start")
    )
    return features.join(stable, ["machineId", "window_start"], "left_semi")


def rul_alerts(scored: DataFrame, hours: float = 48.0, probability: float = 0.85) -> DataFrame:
    """Rows under the hour limit, or over the failure probability where that column exists."""
    due = F.col("rul_value") < hours
    if "failure_probability" in scored.columns:
        due |= F.col("failure_probability") > probability
    return scored.filter(due).select(
        F.col("window_end").alias("alert_time"),
        F.col("machineId").cast("string").alias("machine_id"),
        F.lit(RUL_ALERT).alias("alert_type"),
        F.col("rul_value").alias("trigger_value"),
        F.lit(hours).alias("threshold_value"),
        F.lit(RUL_ACTION).alias("suggested_action"),
    )
