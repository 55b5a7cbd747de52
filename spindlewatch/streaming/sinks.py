"""Sinks: tables, keyed upserts, JDBC and Kafka, each written once per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindlewatch.config import Settings, secret
from spindlewatch.operators.latest import latest_by_key

BATCH_COLUMN = "batch_id"


def start_append(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, fmt: str = "parquet"
) -> StreamingQuery:
    """Append rows to a file table; the file sink's log makes replays exactly-once."""
    return (
        rows.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start(path)
    )


def start_foreach(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    output_mode: str = "append",
) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(write)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def drain(rows: DataFrame, path: str) -> DataFrame:
    """Run a stream over everything available now and read its table back."""
    spark = rows.sparkSession
    start_append(rows, f"{path}/table", f"{path}/checkpoint", {"availableNow": True}).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/table")


def batch_folder_writer(path: str, fmt: str = "parquet", **options) -> Callable[[DataFrame, int], None]:
    """Writer of one folder per micro-batch: a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).options(**options).save(f"{path}/{BATCH_COLUMN}={batch_id}")

    return write


def fan_out(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several writers on one micro-batch, which is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for writer in writers:
                writer(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def jdbc_options(url: str, table: str, driver: str, batch_size: int = 100) -> dict[str, str]:
    """Options of a JDBC sink; user and password come from the environment."""
    options = {"url": url, "dbtable": table, "driver": driver, "batchsize": str(batch_size)}
    for key, name in (("user", "SPINDLEWATCH_JDBC_USER"), ("password", "SPINDLEWATCH_JDBC_PASSWORD")):
        if secret(name):
            options[key] = secret(name)
    return options


# table -> (columns, rows per JDBC batch)
STATUS_TABLES = {
    "device_realtime_status": (
        ["machine_id", "update_time", "machine_status", "current_temperature",
         "current_vibration_rms", "health_score"],
        100,
    ),
    "realtime_status_window": (
        ["window_start", "window_end", "machine_id", "max_temperature", "avg_vib_rms",
         "current_fluctuation", "temp_slope", "window_type"],
        100,
    ),
    "realtime_alerts": (
        ["alert_time", "machine_id", "alert_type", "trigger_value", "threshold_value",
         "suggested_action", "insert_time"],
        10,
    ),
    # spikes go to the same table as the other alerts, from a query of their own
    "spike_alerts": (
        ["alert_time", "machine_id", "alert_type", "trigger_value", "threshold_value",
         "suggested_action", "insert_time"],
        10,
    ),
    "device_health": (["machine_id", "update_time", "machine_status", "health_score"], 100),
    "change_record_status": (["machine_id", "status", "start_time"], 100),
    "realtime_process_deviation": (
        ["record_time", "machine_id", "param_name", "actual_value", "standard_value",
         "deviation_ratio", "duration_seconds"],
        100,
    ),
}


#: Outputs whose table is called otherwise.
TABLE_OF = {"spike_alerts": "realtime_alerts"}


def jdbc_writer(url: str, output: str, driver: str) -> Callable[[DataFrame, int], None]:
    columns, batch_size = STATUS_TABLES[output]
    options = jdbc_options(url, TABLE_OF.get(output, output), driver, batch_size)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(*columns).write.format("jdbc").options(**options).mode("append").save()

    return write


def kafka_writer(brokers: str, topic: str) -> Callable[[DataFrame, int], None]:
    """Writer of the string column ``value`` to a topic (at least once)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.select("value")
            .write.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("topic", topic)
            .save()
        )

    return write


def alert_topic_writer(spark: SparkSession) -> Callable[[DataFrame, int], None]:
    """Writer of alert lines to the topic that the settings name."""
    s = Settings.from_spark(spark)
    return kafka_writer(s.kafka_brokers, s.alert_topic)


def feature_topic_writer(spark: SparkSession) -> Callable[[DataFrame, int], None]:
    """Writer of feature lines to the topic that the settings name."""
    s = Settings.from_spark(spark)
    return kafka_writer(s.kafka_brokers, s.feature_topic)


#: Where the raw lines of each feed go: to its topic only, or to landing files as well.
ROUTES = {
    "sensor": ("topic", "files"), "log": ("topic", "files"), "change": ("topic", "files"),
    "state": ("topic",), "metrics": ("topic",), "highfreq": ("topic",),
}


def landing_writer(feed: str, writers: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """Writer of a feed's tagged lines to the targets of its route; ``writers`` has one for each target."""
    return fan_out(*[writers[target] for target in ROUTES[feed]])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def touched_partitions(batch: DataFrame, partition: str | Sequence[str]) -> Column:
    """Partition filter for a batch. Only its distinct partition values (hours, buckets) come to the
    driver, no more than the table's file listing holds there anyway."""
    parts = _names(partition)
    values = batch.select(*parts).distinct().collect()
    if len(parts) == 1:
        return F.col(parts[0]).isin([row[0] for row in values])
    any_of = F.lit(False)
    for row in values:
        both = F.lit(True)
        for name, value in zip(parts, row, strict=True):
            both &= F.col(name).eqNullSafe(value)
        any_of |= both
    return any_of


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


STAGED = "_staged"


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _apply_staged(batch: DataFrame, path: str, partition: str | Sequence[str]) -> None:
    """Put the staged partitions into their places, then forget the stage; may be repeated at any point."""
    spark, staged = batch.sparkSession, f"{path}/{STAGED}"
    (
        spark.read.schema(batch.schema).parquet(staged)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_names(partition))
        .parquet(path)
    )
    _delete(spark, staged)


def upsert_files(
    batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], partition: str | Sequence[str]
) -> None:
    """Merge rows by key into a partitioned parquet table; of equal keys the last in ``order`` stays.

    Only partitions the batch touches are read and replaced. ``partition`` must be a function of the
    keys. Merged partitions are first written whole to a hidden folder beside the table, and only a
    complete stage replaces anything. A run that dies while old files are being replaced is finished
    by the next call from that stage, so no stored row is lost, and running the same batch again leaves the
    table as it is.
    """
    spark, staged = batch.sparkSession, f"{path}/{STAGED}"
    if _exists(spark, f"{staged}/_SUCCESS"):
        _apply_staged(batch, path, partition)
    merged = batch
    if _exists(spark, path):
        stored = spark.read.schema(batch.schema).parquet(path)
        merged = stored.filter(touched_partitions(batch, partition)).unionByName(batch)
    latest_by_key(merged, keys, order).write.mode("overwrite").partitionBy(*_names(partition)).parquet(staged)
    _apply_staged(batch, path, partition)


def upsert_writer(
    path: str, keys: Sequence[str], order: Sequence[str], partition: str | Sequence[str]
) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert_files(batch, path, keys, order, partition)

    # the batch is read for its partitions and for its rows
    return fan_out(write)


def keyed_store_writer(
    path: str, key: str, order: Sequence[str], buckets: int = 16
) -> Callable[[DataFrame, int], None]:
    """Latest row per key, kept as a parquet table of hash buckets (a key-value store's job)."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    write = upsert_writer(path, [key], order, "bucket")
    return lambda batch, batch_id: write(batch.withColumn("bucket", bucket), batch_id)


def merge_statement(table: str, keys: Sequence[str], columns: Sequence[str], source: str) -> str:
    """MERGE for a table format that supports it; the source must be unique by key."""
    on = " AND ".join(f"t.`{k}` = s.`{k}`" for k in keys)
    update = ", ".join(f"t.`{c}` = s.`{c}`" for c in columns if c not in keys)
    names = ", ".join(f"`{c}`" for c in columns)
    values = ", ".join(f"s.`{c}`" for c in columns)
    return (
        f"MERGE INTO {table} t USING {source} s ON {on} "
        f"WHEN MATCHED THEN UPDATE SET {update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
    )


def event_day(rows: DataFrame, ts_ms: str = "ts") -> DataFrame:
    """Add the partition column ``day`` of a lake table keyed by (machine_id, ts)."""
    return rows.withColumn("day", F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd"))


HOURLY = ["day", "hour"]


def event_hour(rows: DataFrame, ts_ms: str = "ts") -> DataFrame:
    """Add the partition columns ``HOURLY``: a micro-batch then rewrites the hours it touches, not days."""
    return event_day(rows, ts_ms).withColumn("hour", F.hour(F.timestamp_millis(ts_ms)))
