"""Machine-telemetry analytics as Spark DataFrame functions."""
