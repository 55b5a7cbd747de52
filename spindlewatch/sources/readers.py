"""Readers for topics, landed text files and JDBC tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindlewatch.config import Settings
from spindlewatch.operators import parse
from spindlewatch.streaming.sinks import jdbc_options


def kafka_options(
    brokers: str, topic: str, starting: str = "latest", per_trigger: int | None = None, fail_on_data_loss: bool = True
) -> dict:
    """Options of a topic reader. Offsets the broker no longer has end the query unless told to be skipped."""
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def topic_lines(
    spark: SparkSession, brokers: str, topic: str, starting: str = "latest", per_trigger: int | None = None,
    fail_on_data_loss: bool = True,
) -> DataFrame:
    """A topic as text lines in ``value``, with its partition and offset."""
    raw = (
        spark.readStream.format("kafka")
        .options(**kafka_options(brokers, topic, starting, per_trigger, fail_on_data_loss))
        .load()
    )
    return raw.selectExpr("CAST(value AS STRING) AS value", "partition", "offset AS seq")


def file_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Text files appearing in a folder as a stream of lines in ``value``."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


# the typed feeds; brokers and the treatment of missing numbers come from the settings unless given


def sensor_stream(spark: SparkSession, brokers: str | None = None, topic: str = "sensor_raw") -> DataFrame:
    s = Settings.from_spark(spark)
    return parse.parse_sensor_raw(topic_lines(spark, brokers or s.kafka_brokers, topic), s.missing)


def log_stream(spark: SparkSession, brokers: str | None = None, topic: str = "log_raw") -> DataFrame:
    s = Settings.from_spark(spark)
    return parse.parse_log_raw(topic_lines(spark, brokers or s.kafka_brokers, topic), s.missing)


def change_stream(spark: SparkSession, brokers: str | None = None, topic: str = "ChangeRecord") -> DataFrame:
    s = Settings.from_spark(spark)
    return parse.parse_change_record(topic_lines(spark, brokers or s.kafka_brokers, topic))


def change_table(
    spark: SparkSession,
    url: str,
    table: str,
    driver: str,
    id_column: str,
    bounds: tuple[int, int],
    partitions: int,
) -> DataFrame:
    """A table of XML change records over JDBC, read in parallel ranges of ``id_column``."""
    options = jdbc_options(url, table, driver)
    options.pop("batchsize")
    return (
        spark.read.format("jdbc")
        .options(**options)
        .option("partitionColumn", id_column)
        .option("lowerBound", bounds[0])
        .option("upperBound", bounds[1])
        .option("numPartitions", partitions)
        .load()
    )
