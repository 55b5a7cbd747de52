"""Deviation episodes on a stream: readings are gathered into short panes by Spark, and one small state chains the panes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewatch.operators.episodes import MEASURES, by_param, episode_record, gap_micros
from spindlewatch.streaming import processors as p

_ARRAYS = ("us", "over", *MEASURES)


class Episodes(p.OrderedReplay):
    """Chains panes of a machine's parameter; memory is the open episode: start, end, maxima, readings, whether reported."""

    def __init__(self, row_schema, order, output: T.StructType, gap: int, least: int):
        super().__init__(row_schema, order)
        self.output, self.gap, self.least = output.fieldNames(), gap, least

    def _record(self, row, run, still_open: bool) -> list:
        start, end, *measures, n, _ = run
        if end - start < self.least:
            return []
        return self.emit({
            **row, "start_us": start, "end_us": end, "n_readings": n, "still_open": still_open, **dict(zip(MEASURES, measures, strict=True)),
        })

    def _runs(self, row) -> list[tuple]:
        """(first, behind last, run) of the pane's deviating stretches."""
        us, over = np.asarray(row["us"], np.int64), np.asarray(row["over"], bool)
        new = np.concatenate([[True], (over[1:] != over[:-1]) | (np.diff(us) > self.gap)])
        first = np.flatnonzero(new)
        behind = np.append(first[1:], len(us))
        tops = [np.fmax.reduceat(np.array(row[m], np.float64), first) for m in MEASURES]
        return [
            (int(a), int(b), (int(us[a]), int(us[b - 1]), *[float(t[i]) for t in tops], int(b - a), False))
            for i, (a, b) in enumerate(zip(first, behind, strict=True)) if over[a]
        ]

    def step(self, memory, row):
        out, runs, size = [], self._runs(row), len(row["us"])
        if memory and runs and runs[0][0] == 0 and runs[0][2][0] - memory[1] <= self.gap:
            _, behind, run = runs[0]
            tops = [float(np.fmax(a, b)) for a, b in zip(memory[2:-2], run[2:-2], strict=True)]
            runs[0] = (0, behind, (memory[0], run[1], *tops, memory[-2] + run[-2], memory[-1]))
        elif memory:
            out += self._record(row, memory, False)
        memory = None
        for _, behind, run in runs:
            if behind < size:
                out += self._record(row, run, False)
                continue
            if not run[-1]:
                early = self._record(row, run, True)
                out += early
                run = (*run[:-1], bool(early))
            memory = run
        return memory, out


def episode_stream(
    readings: DataFrame, threshold: float = 0.10, least_seconds: float = 30, max_gap_seconds: float | None = None,
    pane: str = "10 seconds",
) -> DataFrame:
    """Episodes of a stream watermarked on ``timestamp``: once when one reaches ``least_seconds`` (``still_open``), once when it has ended.

    Spark's window aggregation gathers a pane's readings of a machine and parameter; the state takes one row a pane and folds it
    with array operations. A pane is looked at when the watermark has passed it.
    """
    rows = by_param(readings, threshold).withColumn("us", F.unix_micros("timestamp"))
    each = F.struct("us", "seq", *[c for c in _ARRAYS if c != "us"])
    panes = rows.groupBy(F.window("timestamp", pane).alias("_w"), "machine_id", "param_name").agg(
        F.array_sort(F.collect_list(each)).alias("_all")
    )
    closed = panes.select(
        "machine_id", "param_name", F.window_time("_w").alias("closed_at"), F.unix_millis("_w.end").alias("end_ms"), F.unix_millis("_w.end").alias(p.TIME_MS),
        *[F.col("_all")[c].alias(c) for c in _ARRAYS],
    )
    schema = T.StructType([T.StructField(c, closed.schema[c].dataType) for c in closed.columns])
    output = T.StructType(
        [T.StructField(c, T.StringType()) for c in ("machine_id", "param_name")]
        + [T.StructField(c, T.LongType()) for c in ("start_us", "end_us", "n_readings")]
        + [T.StructField(m, T.DoubleType()) for m in MEASURES]
        + [T.StructField("still_open", T.BooleanType())]
    )
    processor = Episodes(schema, "end_ms", output, gap_micros(max_gap_seconds), int(least_seconds * 1_000_000))
    return episode_record(p.run_rows(closed, "closed_at", ["machine_id", "param_name"], processor, output))
