"""Operator parameters, read from ``spark.conf`` with typed defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.spindlewatch."


def _parse(text: str, default):
    """Typed value of a setting; text that does not parse falls back to the default."""
    if isinstance(default, bool):
        return {"true": True, "false": False}.get(text.strip().lower(), default)
    if isinstance(default, tuple):
        return tuple(part.strip() for part in text.split(",") if part.strip()) or default
    if isinstance(default, (int, float)):
        try:
            return type(default)(text.strip())
        except ValueError:
            return default
    return text


@dataclass(frozen=True)
class Settings:
    temperature_threshold: float = 80.0
    vibration_threshold: float = 2.0
    vibration_spike_ratio: float = 0.2
    alert_codes: tuple[str, ...] = ("999",)
    deviation_threshold: float = 0.028
    sustained_deviation: float = 0.10
    sustained_seconds: int = 30
    episode_max_gap_seconds: int = 15
    default_current: float = 30.0
    default_speed: float = 3000.0
    start_speed: float = 1000.0
    interpolation_max_gap_seconds: int = 5
    interpolation_step_seconds: int = 1
    max_allowed_lateness_seconds: int = 30
    watermark_seconds: int = 5
    health_min_update_seconds: int = 60
    missing: str = "zero"
    kafka_brokers: str = "localhost:9092"
    alert_topic: str = "alert_topic"
    feature_topic: str = "Feature_log"
    output_base_path: str = ""
    # seconds of one machine's records that one task has to order; see operators/segments.py
    segment_seconds: int = 3600
    # rows of the whole table per segment of the lateness filter
    arrival_span: int = 250_000

    @classmethod
    def from_spark(cls, spark: SparkSession) -> Settings:
        values = {}
        for field in fields(cls):
            text = spark.conf.get(PREFIX + field.name, None)
            if text is not None:
                values[field.name] = _parse(text, field.default)
        return cls(**values)


def secret(name: str) -> str | None:
    """Credentials come from the environment only, never from files in the repository."""
    return os.environ.get(name)
