"""Error surges on a stream: counts by window from Spark's aggregation, the windows before from a small state per code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewatch.streaming import processors as p


class SurgeBaseline(p.OrderedReplay):
    """Each closed window with the mean of the windows before it; memory is the counts of the last ones, silent ones left out."""

    def __init__(self, row_schema, order, output: T.StructType, seconds: int, preceding: int, begun_s: int):
        super().__init__(row_schema, order)
        self.output = output.fieldNames()
        self.seconds, self.preceding, self.begun_s = seconds, preceding, begun_s

    def step(self, memory, row):
        start = row["start_s"]
        known = [(s, n) for s, n in (zip(*memory, strict=True) if memory else ()) if s >= start - self.preceding * self.seconds]
        before = min(self.preceding, (start - self.begun_s) // self.seconds)
        baseline = sum(n for _, n in known) / before if before > 0 else None
        known.append((start, row["n"]))
        return tuple(list(c) for c in zip(*known, strict=True)), self.emit({**row, "baseline": baseline})


def error_surge_stream(
    log: DataFrame, begun_s: int, seconds: int = 60, preceding: int = 5, factor: float = 1.5, least: int = 3
) -> DataFrame:
    """``alerts.error_surge`` for a stream watermarked on ``timestamp``; a window is judged when the watermark has passed it.

    ``begun_s`` is the start of the log's first window in epoch seconds: earlier windows do not count as silent.
    """
    counts = log.groupBy(F.window("timestamp", f"{seconds} seconds").alias("_w"), "error_code").agg(F.count(F.lit(1)).alias("n"))
    closed = counts.select(
        "error_code", F.window_time("_w").alias("closed_at"), F.unix_seconds("_w.start").alias("start_s"), F.unix_millis("_w.end").alias("end_ms"),
        F.unix_millis("_w.end").alias(p.TIME_MS), "n",
    )
    schema = T.StructType([T.StructField(c, closed.schema[c].dataType) for c in closed.columns])
    output = T.StructType([
        T.StructField("error_code", T.StringType()), T.StructField("start_s", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("baseline", T.DoubleType()),
    ])
    judged = p.run_rows(closed, "closed_at", ["error_code"], SurgeBaseline(schema, "end_ms", output, seconds, preceding, begun_s), output)
    surging = (F.col("n") >= factor * F.col("baseline")) & ((F.col("baseline") > 0) | (F.col("n") >= least))
    return judged.filter(surging).select(F.timestamp_seconds("start_s").alias("window_start"), "error_code", "n", "baseline")
