"""The telemetry feeds as DataFrames: typed rows, and the text lines devices would send."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.functions import columns as fn
from spindlewatch.operators import cleaner
from spindlewatch.sources import fixture_exprs as fx

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


class Feeds:
    """Feeds over one data folder; ``streaming=True`` reads ``events`` as a file stream."""

    def __init__(
        self, spark: SparkSession, folder: str, streaming: bool = False, files_per_trigger: int | None = None
    ):
        self.spark, self.folder, self.streaming = spark, folder.rstrip("/"), streaming
        self.files_per_trigger = files_per_trigger

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        if not self.streaming:
            return self.table("events")
        reader = self.spark.readStream.schema(EVENTS_SCHEMA)
        if self.files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.files_per_trigger)
        return reader.parquet(f"{self.folder}/events*.parquet")

    def _feed(self, expressions: dict[str, str], where: str | None = None) -> DataFrame:
        base = self.events().selectExpr(*fx.select_list(fx.BASE, "`"))
        if where:
            base = base.filter(where)
        return base.selectExpr(*fx.select_list(expressions, "`"))

    def sensor_raw(self, where: str | None = None) -> DataFrame:
        return self._feed(fx.SENSOR_RAW, where).withColumn("timestamp", fn.epoch_ms_to_timestamp("ts"))

    def log_raw(self) -> DataFrame:
        return self._feed(fx.LOG_RAW).withColumn("timestamp", fn.epoch_ms_to_timestamp("ts"))

    def log_texts(self) -> DataFrame:
        """Log lines with variable words that are no numbers."""
        return self._feed(fx.LOG_TEXT).withColumn("timestamp", fn.epoch_ms_to_timestamp("ts"))

    def change_rows(self) -> DataFrame:
        return self._feed(fx.CHANGE_RECORD)

    def changes(self) -> DataFrame:
        """Change records that are well formed, as parsed rows."""
        return (
            self.change_rows()
            .filter("flaw = ''")
            .select(
                "seq",
                "machine_id",
                "status",
                F.timestamp_seconds("start_s").alias("start_time"),
                F.timestamp_seconds("end_s").alias("end_time"),
            )
        )

    def device_state(self, every: bool = False) -> DataFrame:
        """The state side of the merged feeds, or the feed of every event."""
        return self._feed(fx.DEVICE_STATE, None if every else fx.STATE_FILTER)

    def sensor_metrics(self, every: bool = False) -> DataFrame:
        return self._feed(fx.SENSOR_METRICS, None if every else fx.METRICS_FILTER)

    def highfreq_sensor(self) -> DataFrame:
        return self._feed(fx.HIGHFREQ_SENSOR).withColumn("event_time", fn.epoch_ms_to_timestamp("ts"))

    def standards(self) -> DataFrame:
        return self.table("nation").selectExpr(*fx.select_list(fx.STANDARDS, "`"))

    def arrivals(self) -> DataFrame:
        return self._feed(fx.ARRIVALS).withColumn("event_time", fn.epoch_ms_to_timestamp("event_ms"))

    # --- text lines -----------------------------------------------------------------------------

    @staticmethod
    def _lines(rows: DataFrame, payload) -> DataFrame:
        """JSON per row in ``value``; some lines arrive cut off."""
        whole = F.to_json(payload)
        cut_off = F.col("seq") % fx.MALFORMED_EVERY == 0
        return rows.select("seq", F.when(cut_off, F.substring(whole, 1, 40)).otherwise(whole).alias("value"))

    def sensor_lines(self) -> DataFrame:
        """One number comes quoted, and noise is missing from some lines."""
        rows = self._feed(fx.SENSOR_RAW)
        columns = [c for c in fx.SENSOR_RAW if c not in ("seq", "vibration_z", "noise")]
        payload = F.struct(
            *columns,
            F.col("vibration_z").cast("string").alias("vibration_z"),
            F.when(F.col("seq") % 10 != 0, F.col("noise")).alias("noise"),
        )
        return self._lines(rows, payload)

    def log_lines(self) -> DataFrame:
        rows = self._feed(fx.LOG_RAW)
        return self._lines(rows, F.struct(*[c for c in fx.LOG_RAW if c != "seq"]))

    def change_lines(self) -> DataFrame:
        stamp = "yyyy-MM-dd HH:mm:ss"
        start = F.date_format(F.timestamp_seconds("start_s"), stamp)
        end = F.date_format(F.timestamp_seconds("end_s"), stamp)
        short = "yyyy-M-d HH:mm:ss"
        short_start = F.concat(F.date_format(F.timestamp_seconds("start_s"), short), F.lit(".000000000"))
        short_end = F.date_format(F.timestamp_seconds("end_s"), short)
        head = [F.col("seq").cast("string"), F.col("machine_id"), F.lit("30"), F.col("status")]
        line = (
            F.when(F.col("flaw") == "short", F.concat_ws(",", *head))
            # the other spelling of times that devices send
            .when((F.col("flaw") == "") & (F.col("seq") % 2 == 0), F.concat_ws(",", *head, short_start, short_end, F.lit("60")))
            .when(F.col("flaw") == "time", F.concat_ws(",", *head, F.lit("n/a"), end))
            .otherwise(F.concat_ws(",", *head, start, end, F.lit("60")))
        )
        return self.change_rows().select("seq", line.alias("value"))

    def device_state_lines(self) -> DataFrame:
        rows = self.device_state(every=True)
        return self._lines(rows, F.struct(*[c for c in fx.DEVICE_STATE if c not in ("seq", "ts")]))

    def sensor_metrics_lines(self) -> DataFrame:
        rows = self.sensor_metrics(every=True)
        return self._lines(rows, F.struct(*[c for c in fx.SENSOR_METRICS if c not in ("seq", "ts")]))

    def highfreq_lines(self) -> DataFrame:
        rows = self.highfreq_sensor().withColumn(
            "timestamp", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS")
        )
        columns = [c for c in fx.HIGHFREQ_SENSOR if c not in ("seq", "ts", "machineId")]
        return self._lines(rows, F.struct("machineId", "timestamp", *columns))

    def change_data(self, flawed: bool = False) -> DataFrame:
        """XML fragments; load and times carry units, the feed cell is absent where zero.

        With ``flawed``, some are cut off and some missing.
        """
        rows = self._feed(fx.CHANGE_DATA)

        def cell(name: str, text):
            return F.concat(F.lit(f'<col ColName="{name}">'), text, F.lit("</col>"))

        def number(column: str, unit: str = ""):
            return F.concat(F.col(column).cast("string"), F.lit(unit))

        names = cleaner.NUMERIC_CELLS
        alarm = F.to_json(F.struct(F.col("alarm_no").alias("AlmNo"), F.col("alarm_msg").alias("AlmMsg")))
        load = F.concat((F.col("load_tenths") / 10).cast("string"), F.lit("%"))
        xml = F.concat(
            cell(cleaner.CELL_DEVICE_IP, F.col("device_ip")),
            cell(cleaner.CELL_MACHINE_STATUS, F.col("status")),
            cell(cleaner.CELL_CONNECTION, F.col("connection")),
            cell(cleaner.CELL_ALARM, alarm),
            cell(names["durationSeconds"], number("run_time", "秒")),
            cell(names["cuttingTime"], number("cut_time", " s")),
            cell(names["cycleTime"], number("cycle_time")),
            cell(names["spindleLoad"], load),
            cell(names["totalParts"], number("total_parts", "个")),
            cell(names["cumRuntime"], number("power_time")),
            cell(names["cumParts"], number("parts")),
            cell(names["spindleSpeed"], number("spindle_speed", "RPM")),
            F.when(F.col("feed") > 0, cell(names["feedSpeed"], number("feed"))).otherwise(""),
        )
        if flawed:
            cut = F.col("record_id") % fx.MALFORMED_EVERY
            xml = F.when(cut == 0, F.substring(xml, 1, 40)).when(cut != 1, xml)
        return rows.select(
            "record_id", "machine_id", fn.epoch_ms_to_timestamp("record_time").alias("record_time"),
            xml.alias("ChangeData"),
        )
