"""Registered streaming queries: each drains the file stream of ``events`` and returns its table.

Results are those of closed windows and of records the final watermark has passed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.config import Settings
from spindlewatch.operators import alerts, deviation, features, parse, windows
from spindlewatch.plans.registry import Query, plain, timed
from spindlewatch.session import configure, shared_path
from spindlewatch.sources.feeds import Feeds
from spindlewatch.streaming import episode_stream, late, pair_segments, sinks, surge_stream, transforms
from spindlewatch.streaming.watermarks import delay_of, marked, together

_QUERIES: dict[str, Query] = {}


def stream_query(build: Callable[[Feeds], DataFrame]) -> Callable[[Feeds], DataFrame]:
    """``build`` returns a streaming DataFrame, which is drained, or a batch one, taken as it is."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = build(Feeds(configure(spark), folder, streaming=True))
        if out.isStreaming:
            out = sinks.drain(out, shared_path(spark, build.__name__))
        return plain(out)

    run.__doc__ = build.__doc__
    _QUERIES[build.__name__] = run
    return build


def _sensor(feeds: Feeds) -> DataFrame:
    return marked(feeds.sensor_raw(), "timestamp")


@stream_query
def stream_windows(feeds: Feeds) -> DataFrame:
    return windows.window_metrics(_sensor(feeds))


@stream_query
def stream_rollup(feeds: Feeds) -> DataFrame:
    """1m, 5m and 1h windows, each merged from the sums of the one below."""
    return windows.rolled_up_stream(_sensor(feeds))


@stream_query
def stream_deviation(feeds: Feeds) -> DataFrame:
    s = Settings.from_spark(feeds.spark)
    readings = deviation.with_deviation(deviation.with_standards(_sensor(feeds), feeds.standards()))
    return deviation.sliding_deviation(deviation.deviating(readings, s.deviation_threshold))


@stream_query
def stream_sustained(feeds: Feeds) -> DataFrame:
    s = Settings.from_spark(feeds.spark)
    readings = deviation.with_deviation(deviation.with_standards(_sensor(feeds), feeds.standards()))
    return deviation.sustained_deviation(readings, s.sustained_deviation)


@stream_query
def stream_episodes(feeds: Feeds) -> DataFrame:
    """Deviations of 20 seconds and more that have ended."""
    s = Settings.from_spark(feeds.spark)
    readings = deviation.with_deviation(deviation.with_standards(_sensor(feeds), feeds.standards()))
    found = episode_stream.episode_stream(readings, s.sustained_deviation, 20, s.episode_max_gap_seconds)
    return found.filter(~F.col("still_open"))


@stream_query
def stream_interpolate(feeds: Feeds) -> DataFrame:
    s = Settings.from_spark(feeds.spark)
    return transforms.interpolate_stream(
        _sensor(feeds), ["temperature", "vibration_x", "current"], "seq",
        s.interpolation_step_seconds, s.interpolation_max_gap_seconds,
    )


@stream_query
def stream_late(feeds: Feeds) -> DataFrame:
    """Windows over records that may be as late as the settings allow, some of them 45 seconds behind."""
    late = f"{Settings.from_spark(feeds.spark).max_allowed_lateness_seconds} seconds"
    arrivals = feeds.arrivals().withWatermark("event_time", late)
    return arrivals.groupBy(F.window("event_time", "1 minute").alias("_w"), "machine_id").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("_w.start").alias("window_start"), "machine_id", "n")


LATE_RUNS = 4


@stream_query
def late_rows(feeds: Feeds) -> DataFrame:
    """All arrivals with the table each was routed to; the stream runs once for every quarter that arrives."""
    path = shared_path(feeds.spark, "late")
    arrivals = Feeds(feeds.spark, feeds.folder).arrivals()
    end = arrivals.agg((F.max("seq") + 1).alias("end")).scalar()
    write = late.late_router(f"{path}/routed", "arrivals", "event_time", Settings.from_spark(feeds.spark).max_allowed_lateness_seconds)
    rows = feeds.spark.readStream.schema(arrivals.schema).parquet(f"{path}/arrived/*")
    for i in range(LATE_RUNS):
        arrivals.filter(F.floor(F.col("seq") * LATE_RUNS / end) == i).write.parquet(f"{path}/arrived/{i}")
        sinks.start_foreach(rows, write, f"{path}/checkpoint", {"availableNow": True}).awaitTermination()
    columns = ["seq", "machine_id", "event_time"]
    routed = [
        feeds.spark.read.parquet(f"{path}/routed/{name}").select(*columns, F.lit(name).alias("routed_to")) for name in (late.ON_TIME, late.LATE)
    ]
    return alerts.all_alerts(*routed)


@stream_query
def stream_error_surge(feeds: Feeds) -> DataFrame:
    begun = Feeds(feeds.spark, feeds.folder).log_raw().agg(F.unix_seconds(F.min(F.window("timestamp", "10 seconds")["start"]))).first()[0]
    return surge_stream.error_surge_stream(marked(feeds.log_raw(), "timestamp"), begun, 10)


@stream_query
def stream_spike(feeds: Feeds) -> DataFrame:
    return transforms.spike_stream(transforms.filled_window_stream(_sensor(feeds)))


@stream_query
def stream_gap_fill(feeds: Feeds) -> DataFrame:
    filled = transforms.filled_window_stream(_sensor(feeds), "3 seconds", "3s")
    return filled.drop("previous_vib_rms")


@stream_query
def stream_features(feeds: Feeds) -> DataFrame:
    return features.window_features(marked(feeds.highfreq_sensor(), "event_time"))


@stream_query
def stream_pairs(feeds: Feeds) -> DataFrame:
    state, metrics = timed(feeds.device_state()), timed(feeds.sensor_metrics())
    pairs = transforms.pair_stream(state, metrics, "seq", "event_time", delay_of(state))
    return features.low_frequency_record(pairs, ["seq"])


@stream_query
def stream_pairs_split(feeds: Feeds) -> DataFrame:
    """The same pairs by segments of ten seconds, which any task can work out."""
    state, metrics = timed(feeds.device_state()), timed(feeds.sensor_metrics())
    pairs = pair_segments.pair_stream_by_segment(state, metrics, "seq", "event_time", "10 seconds", delay_of(state))
    return features.low_frequency_record(pairs, ["seq"])


@stream_query
def stream_feature_records(feeds: Feeds) -> DataFrame:
    inputs = timed(feeds.device_state()), timed(feeds.sensor_metrics()), feeds.highfreq_sensor()
    return transforms.feature_record_stream(*together(*[(rows, "event_time") for rows in inputs]))


@stream_query
def stream_status(feeds: Feeds) -> DataFrame:
    sensor = feeds.sensor_raw()
    return transforms.status_stream(sensor, feeds.changes(), delay=delay_of(sensor))


@stream_query
def stream_health(feeds: Feeds) -> DataFrame:
    return transforms.health_stream(*together((feeds.sensor_raw(), "timestamp"), (feeds.changes(), "start_time")))


@stream_query
def stream_alerts(feeds: Feeds) -> DataFrame:
    return alerts.all_alerts(
        alerts.sensor_alerts(feeds.sensor_raw()), alerts.log_alerts(feeds.log_raw())
    )


@stream_query
def lake_sensor_upsert(feeds: Feeds) -> DataFrame:
    """Sensor detail upserted by (machine_id, ts), one micro-batch after another."""
    path = shared_path(feeds.spark, "lake_sensor")
    rows = sinks.event_hour(feeds.sensor_raw().drop("timestamp"))
    write = sinks.upsert_writer(f"{path}/table", ["machine_id", "ts"], ["seq"], sinks.HOURLY)
    sinks.start_foreach(rows, write, f"{path}/checkpoint", {"availableNow": True}).awaitTermination()
    return feeds.spark.read.schema(rows.schema).parquet(f"{path}/table").drop("day", "hour", "seq")


@stream_query
def lake_log_upsert(feeds: Feeds) -> DataFrame:
    path = shared_path(feeds.spark, "lake_log")
    rows = sinks.event_hour(alerts.log_severity(feeds.log_raw()).drop("timestamp"))
    write = sinks.upsert_writer(f"{path}/table", ["machine_id", "ts"], ["seq"], sinks.HOURLY)
    sinks.start_foreach(rows, write, f"{path}/checkpoint", {"availableNow": True}).awaitTermination()
    return feeds.spark.read.schema(rows.schema).parquet(f"{path}/table").drop("day", "hour", "seq")


@stream_query
def raw_landing(feeds: Feeds) -> DataFrame:
    """Raw lines of all feeds to the targets of their routes: tagged lines for the topics, plain text files."""
    path = shared_path(feeds.spark, "landing")
    lines = {
        "sensor": feeds.sensor_lines(), "log": feeds.log_lines(), "change": feeds.change_lines(),
        "state": feeds.device_state_lines(), "metrics": feeds.sensor_metrics_lines(), "highfreq": feeds.highfreq_lines(),
    }
    landed = []
    for feed, rows in lines.items():
        files = sinks.batch_folder_writer(f"{path}/{feed}/files", "text")
        writers = {
            "topic": sinks.batch_folder_writer(f"{path}/{feed}/topic"),
            "files": lambda batch, batch_id, files=files: files(batch.select("value"), batch_id),
        }
        write = sinks.landing_writer(feed, writers)
        tagged = parse.tag_feed(rows, feed)
        sinks.start_foreach(tagged, write, f"{path}/{feed}/checkpoint", {"availableNow": True}).awaitTermination()
        for target in sinks.ROUTES[feed]:
            found = feeds.spark.read.parquet(f"{path}/{feed}/topic") if target == "topic" else feeds.spark.read.text(f"{path}/{feed}/files")
            landed.append(found.select(F.lit(feed).alias("topic_type"), F.lit(target).alias("target"), "value"))
    cut_off = F.sum((~F.col("value").endswith("}") & (F.col("topic_type") != "change")).cast("bigint"))
    return alerts.all_alerts(*landed).groupBy("topic_type", "target").agg(
        F.count(F.lit(1)).alias("n"), cut_off.alias("n_cut_off")
    )


def stream_queries() -> dict[str, Query]:
    return dict(_QUERIES)
