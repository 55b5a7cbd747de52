"""Explicit schemas of every feed and result (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    """Schema from ``name type`` pairs; needs no running session, unlike ``fromDDL``."""
    pairs = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SENSOR_RAW = _struct(
    "machine_id string, ts bigint, temperature double, vibration_x double, vibration_y double, "
    "vibration_z double, current double, noise double, speed double"
)
LOG_RAW = _struct(
    "machine_id string, ts bigint, error_code string, error_msg string, stack_trace string"
)
CHANGE_RECORD = _struct(
    "machine_id string, status string, start_time timestamp, end_time timestamp"
)
DEVICE_STATE = _struct(
    "machineId int, duration_seconds double, is_running int, is_standby int, is_offline int, "
    "isAlarm string, cumulative_alarms int"
)
SENSOR_METRICS = _struct(
    "machineId int, cutting_time double, cycle_time double, spindle_load double, feed_rate int, "
    "spindle_speed int, total_parts int, cumulative_runtime double, cumulative_parts int, "
    "avg_spindle_load_10 double, avg_cutting_time_10 double"
)
HIGHFREQ_SENSOR = _struct(
    "machineId int, timestamp string, temperature double, vibration_x double, "
    "vibration_y double, vibration_z double, spindle_load double, feed_rate int, "
    "spindle_speed int, is_running int"
)

WINDOW_METRICS = _struct(
    "window_start timestamp, window_end timestamp, machine_id string, max_temperature double, "
    "avg_vib_rms double, current_fluctuation double, temp_slope double, window_type string"
)
ALERT_COLUMNS = [
    "alert_time", "machine_id", "alert_type", "trigger_value", "threshold_value",
    "suggested_action", "insert_time",
]
WINDOW_FEATURES = [
    "var_temp", "kurtosis_temp", "fft_peak", "avg_spindle_load", "max_spindle_load",
    "running_ratio", "avg_feed_rate",
]
LOW_FREQUENCY_FIELDS = [
    "machineId", "duration_seconds", "is_running", "is_standby", "is_offline", "cutting_time",
    "cycle_time", "total_parts", "spindle_load", "cumulative_runtime", "cumulative_parts",
    "cumulative_alarms", "avg_spindle_load_10", "avg_cutting_time_10",
]
# window feature -> name in the 22-field record
FEATURE_FIELDS = {
    "var_temp": "var_temp",
    "kurtosis_temp": "kurtosis_temp",
    "fft_peak": "fft_peak",
    "avg_spindle_load": "avg_spindle_load_win",
    "max_spindle_load": "max_spindle_load_win",
    "running_ratio": "running_ratio",
    "avg_feed_rate": "avg_feed_rate",
}
FEATURE_RECORD = [*LOW_FREQUENCY_FIELDS, *FEATURE_FIELDS.values(), "alarmMessage"]
