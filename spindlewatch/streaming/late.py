"""Late records of a stream as an output of their own.

Operators behind a watermark drop what comes too late, without a trace. ``late_router`` stands ahead of them: by the rule of the
watermark (a record is late if it is more than the allowed lateness behind the newest record of all earlier
micro-batches) it writes every record to one of two tables, so that on-time and late rows together are the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.streaming.sinks import BATCH_COLUMN, batch_folder_writer

ON_TIME, LATE, NEWEST = "on_time", "late", "newest"


def late_router(path: str, feed: str, time_column: str, lateness_seconds: int) -> Callable[[DataFrame, int], None]:
    """Writer of ``path/on_time``, ``path/late`` (with ``feed``) and ``path/newest``, a row a micro-batch.

    A replayed micro-batch sees the same earlier ones and overwrites its own folders, so nothing is counted twice.
    """
    writers = {name: batch_folder_writer(f"{path}/{name}") for name in (ON_TIME, LATE, NEWEST)}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id > 0:
            known = spark.read.schema(f"newest_us bigint, {BATCH_COLUMN} bigint").parquet(f"{path}/{NEWEST}")
            before = known.filter(F.col(BATCH_COLUMN) < batch_id).agg(F.max("newest_us")).first()[0]
        at = F.unix_micros(time_column)
        late = F.lit(False) if before is None else F.coalesce(at < before - lateness_seconds * 1_000_000, F.lit(False))
        batch.persist()
        try:
            writers[ON_TIME](batch.filter(~late), batch_id)
            writers[LATE](batch.filter(late).withColumn("feed", F.lit(feed)), batch_id)
            writers[NEWEST](batch.agg(F.max(at).alias("newest_us")), batch_id)
        finally:
            batch.unpersist()

    return write


def late_counts(late: DataFrame, time_column: str, size: str = "1 minute") -> DataFrame:
    """Late rows by feed and window of their event time."""
    return late.groupBy("feed", F.window(time_column, size).alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(
        "feed", F.col("_w.start").alias("window_start"), "n"
    )
