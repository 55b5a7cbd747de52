"""Scalar column expressions; all of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States, scores, severities and texts shown to operators.
STATUS_WARNING = "预警"
STATE_STOPPED = "异常停机"
STATE_STARTING = "启动中"
STATE_STABLE = "稳定运行"
HEALTH_SCORES = {STATE_STABLE: 100.0, STATE_STARTING: 80.0}
HEALTH_SCORE_OTHER = 60.0
SEVERITIES = {"999": "Critical", "500": "High"}
SEVERITY_OTHER = "Normal"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, table: dict, otherwise) -> Column:
    """CASE over a handful of constants; a null key takes the default."""
    out = F
    for value, result in table.items():
        out = out.when(key == value, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def round_half_up(c: Column | str, digits: int) -> Column:
    """Round with ties toward plus infinity (``round`` breaks negative ties the other way)."""
    scale = float(10**digits)
    return F.floor(col(c) * scale + 0.5).cast("double") / scale


def epoch_ms_to_timestamp(c: Column | str) -> Column:
    return F.timestamp_millis(col(c))


def squared_magnitude(x: str, y: str, z: str) -> Column:
    return sum((F.col(c) * F.col(c) for c in (y, z)), F.col(x) * F.col(x))


def machine_state(status: Column | str, speed: Column | str, start_speed: float = 1000.0) -> Column:
    return (
        F.when(col(status) == STATUS_WARNING, STATE_STOPPED)
        .when(col(speed) < start_speed, STATE_STARTING)
        .otherwise(STATE_STABLE)
    )


def health_score(state: Column | str) -> Column:
    return lookup(col(state), HEALTH_SCORES, HEALTH_SCORE_OTHER)


def log_severity(code: Column | str) -> Column:
    return lookup(col(code), SEVERITIES, SEVERITY_OTHER)


def deviation_ratio(actual: Column | str, standard: Column | str) -> Column:
    """``|actual - standard| / standard``; null for a zero standard."""
    return F.try_divide(F.abs(col(actual) - col(standard)), col(standard))


def percent_label(prefix: str, ratio: Column) -> Column:
    # the doubled percent sign is part of the label
    return F.format_string(prefix + "%.2f%%%%", ratio * 100)


def number_or_null(text: Column, data_type: str) -> Column:
    """Number held in JSON text, quoted or not; integers are truncated from decimals."""
    as_double = text.try_cast("double")
    if data_type == "double":
        return as_double
    truncated = as_double.try_cast(data_type)
    # a double holds every int exactly, but not every bigint
    return truncated if data_type == "int" else F.coalesce(text.try_cast(data_type), truncated)


def clean_number(text: Column | str, digits: int = 2) -> Column:
    """Strip everything but digits, point and minus; what does not parse becomes 0.0."""
    stripped = F.regexp_replace(col(text), r"[^0-9.\-]", "")
    return round_half_up(F.coalesce(stripped.try_cast("double"), F.lit(0.0)), digits)


def stability_status(
    temperature: Column | str,
    fluctuation: Column | str,
    max_temperature: float = 80.0,
    max_fluctuation: float = 5.0,
) -> Column:
    return F.when(
        (col(temperature) <= max_temperature) & (col(fluctuation) <= max_fluctuation), "STABLE"
    ).otherwise("WARNING")


def risk_level(rul_hours: Column | str, high: float = 48.0, medium: float = 168.0) -> Column:
    return (
        F.when(col(rul_hours) < high, "High")
        .when(col(rul_hours) < medium, "Medium")
        .otherwise("Low")
    )
