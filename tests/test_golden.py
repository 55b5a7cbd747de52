"""Known inputs with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from spindlewatch.functions import columns as fn
from spindlewatch.operators import alerts, cleaner, deviation, features, parse, status

SENSOR = (
    '{{"machine_id":"{m}","ts":1775300000000,"temperature":{t},"vibration_x":0.5,"vibration_y":0.5,'
    '"vibration_z":0.5,"current":{c},"speed":{s}}}'
)


def sensor(spark, m="101", t=45.0, c=30.0, s=3000.0):
    lines = spark.createDataFrame([(1, SENSOR.format(m=m, t=t, c=c, s=s))], "seq long, value string")
    return parse.parse_sensor_raw(lines)


def no_changes(spark):
    return spark.createDataFrame(
        [], "seq long, machine_id string, status string, start_time timestamp, end_time timestamp"
    )


def test_high_temperature_alert(spark):
    (row,) = alerts.sensor_alerts(sensor(spark, t=85.5)).collect()
    assert (row.alert_type, row.trigger_value, row.threshold_value) == ("高温预警", 85.5, 80.0)
    assert row.suggested_action == "请立即检查设备"
    assert row.machine_id == "101"


def test_temperature_comes_before_vibration(spark):
    both = sensor(spark, t=85.5).withColumn("vibration_x", F.lit(3.0))
    (row,) = alerts.sensor_alerts(both).collect()
    assert row.alert_type == "高温预警"
    assert alerts.sensor_alerts(sensor(spark, t=80.0)).count() == 0


def test_log_999_alert_with_other_message_key(spark):
    line = '{"machine_id":"103","ts":1775300000000,"error_code":"999","error_message":"x","stack_trace":"y"}'
    log = parse.parse_log_raw(spark.createDataFrame([(line,)], "value string"))
    assert log.first().error_msg is None
    (row,) = alerts.log_alerts(log).collect()
    assert (row.alert_type, row.suggested_action) == ("严重错误: 999", "请立即检查硬件日志")
    assert row.trigger_value == 999.0


@pytest.mark.parametrize(
    ("speed", "temperature", "state", "score"),
    [(500.0, 45.0, "启动中", 80.0), (3000.0, 100.0, "稳定运行", 100.0)],
)
def test_state_and_health(spark, speed, temperature, state, score):
    rows = status.machine_status(sensor(spark, "104", temperature, s=speed), no_changes(spark))
    row = rows.first()
    assert (row.machine_status, row.health_score) == (state, score)


def test_warning_status_stops_machine(spark):
    change = spark.createDataFrame(
        [("1,104,30,预警,2026-04-04 10:00:00,2026-04-04 10:05:00,300",)], "value string"
    )
    changes = parse.parse_change_record(change).withColumn("seq", F.lit(1))
    row = status.machine_status(sensor(spark, "104", s=500.0), changes).first()
    assert (row.machine_status, row.health_score) == ("异常停机", 60.0)


def test_current_deviation(spark):
    standards = spark.createDataFrame([], "machine_id string, current double, speed double")
    readings = deviation.with_deviation(deviation.with_standards(sensor(spark, "105", c=35.0), standards))
    assert readings.first().current_dev == pytest.approx(1 / 6)
    rows = deviation.sliding_deviation(deviation.deviating(readings)).collect()
    assert len(rows) == 3  # the reading lies in three sliding windows
    assert rows[0].deviation_ratio == pytest.approx(16.67, abs=0.01)
    assert rows[0].duration_seconds == 30


def test_reported_deviation_percent(spark):
    df = spark.createDataFrame([(94.97, 45.0), (1.0, 0.0)], "a double, s double")
    first, zero = [r[0] for r in df.select(fn.deviation_ratio("a", "s") * 100).collect()]
    assert first == pytest.approx(111.04, abs=0.01)
    assert zero is None


def test_risk_levels(spark):
    df = spark.createDataFrame([(45.12,), (170.88,), (185.42,), (100.0,)], "rul double")
    got = [r[0] for r in df.select(fn.risk_level("rul")).collect()]
    assert got == ["High", "Low", "Low", "Medium"]


def test_round_half_up(spark):
    df = spark.createDataFrame([(-0.125,), (0.125,), (2.5,), (-2.5,)], "x double")
    got = df.select(fn.round_half_up("x", 2), fn.round_half_up("x", 0)).collect()
    assert [r[0] for r in got] == [-0.12, 0.13, 2.5, -2.5]
    assert [r[1] for r in got][2:] == [3.0, -2.0]


def test_percent_label(spark):
    df = spark.createDataFrame([(0.23456,)], "x double")
    assert df.select(fn.percent_label("振动突增:", F.col("x"))).first()[0] == "振动突增:23.46%%"


def cells(**named):
    return "".join(f'<col ColName="{k}">{v}</col>' for k, v in named.items())


def test_cleaner_four_states(spark):
    rows = [
        (1, cells(设备IP="192.168.1.201", 切削时间="495945", 循环时间="613424", 主轴负载="0", 机器状态="运行",
                  连接状态="normal", 报警信息='{"AlmNo":0,"AlmMsg":"无报警"}')),
        (2, cells(机器状态="MDI", 连接状态="normal", 主轴负载="12.345%", 进给速度="abc")),
        (3, cells(机器状态="异常停机", 连接状态="normal", 报警信息='{"AlmNo":1021,"AlmMsg":"主轴过载"}')),
        (4, cells(机器状态="未知", 连接状态="lost")),
    ]
    df = spark.createDataFrame(rows, "record_id int, ChangeData string")
    got = {r.record_id: r for r in cleaner.clean_change_data(df).collect()}
    flags = {i: (r.isRunning, r.isStandby, r.isOffline, r.isAlarm) for i, r in got.items()}
    assert flags == {
        1: (1.0, 0.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0, 1.0), 4: (0.0, 0.0, 1.0, 0.0),
    }
    assert (got[1].cuttingTime, got[1].device_ip, got[1].alarm_message) == (495945.0, "192.168.1.201", "无报警")
    assert (got[2].spindleLoad, got[2].avgSpindleLoad, got[2].feedSpeed) == (12.35, 12.35, 0.0)
    assert got[3].alarm_code == "1021"


def test_cleaner_repeated_and_broken_cells(spark):
    rows = [(1, cells(机器状态="运行") + cells(机器状态="待机")), (2, "<col ColName="), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "record_id int, ChangeData string")
    got = {r.record_id: r for r in cleaner.clean_change_data(df).collect()}
    assert got[1].machine_status == "运行"
    assert len(got) == 4 and got[2].isRunning == 0.0 and got[4].cuttingTime == 0.0


def test_output_column_counts():
    counts = {name: len(columns) for name, (_, columns) in cleaner.OUTPUTS.items()}
    assert counts == {
        "cleaned_full_csv": 22, "device_metrics_csv": 12, "device_state_csv": 11, "json_backup": 22,
    }


def test_alarm_messages(spark):
    df = spark.createDataFrame([("0x01001",), ("0xABC",), ("",), (None,)], "isAlarm string")
    got = [r.alarmMessage for r in features.translate_alarm(df).collect()]
    assert sorted(got) == sorted(
        ["OP10 工位：卡料或供料不畅，振动盘频率异常", "未知错误码: 0xABC", "", ""]
    )


def test_constant_temperature_has_no_kurtosis(spark):
    at = datetime.datetime(2026, 1, 1, 0, 0, 5)
    rows = [(1, at, 50.0, 0.0, 2.0, 10, 1), (1, at, 50.0, 0.0, 4.0, 15, 0)]
    df = spark.createDataFrame(
        rows,
        "machineId int, event_time timestamp, temperature double, vibration_x double, "
        "spindle_load double, feed_rate int, is_running int",
    )
    row = features.window_features(df).first()
    assert (row.var_temp, row.kurtosis_temp, row.fft_peak) == (0.0, 0.0, 0.0)
    assert (row.avg_spindle_load, row.max_spindle_load, row.running_ratio) == (3.0, 4.0, 0.5)
    assert row.avg_feed_rate == 13.0


def test_one_reading_has_no_fluctuation(spark):
    from spindlewatch.operators import windows

    one = sensor(spark)
    row = windows.window_metrics(one).first()
    assert (row.current_fluctuation, row.temp_slope) == (0.0, 0.0)
    rolled = windows.rolled_up_metrics(one).collect()
    assert {r.window_type for r in rolled} == {"1m", "5m", "1h"}
    assert all(r.current_fluctuation == 0.0 for r in rolled)


def test_pattern_and_xml_parser_agree(spark):
    """Fragments the pattern must leave to the XML parser, next to one it may read."""
    rows = [
        (1, cells(a="1", b="x y")),
        (2, cells(a="1 &lt; 2 &amp; 3")),
        (3, '<col ColName="a"><![CDATA[7]]></col>' + cells(b="8")),
        (4, "<!-- note -->" + cells(a="9")),
        (5, "<col ColName='a'>10</col>"),
        (6, cells(a="11") + cells(a="12")),
        (7, '<col ColName="a"/>' + cells(b="13")),
    ]
    df = spark.createDataFrame(rows, "record_id int, ChangeData string")
    parsed = cleaner.parse_cells(df).select("record_id", cleaner.cell_map("cells"))
    got = {r[0]: r[1] for r in parsed.collect()}
    assert got[1] == {"a": "1", "b": "x y"}
    assert got[2] == {"a": "1 < 2 & 3"}
    assert got[3]["b"] == "8" and got[3]["a"] == "7"
    assert got[4] == {"a": "9"}
    assert got[5] == {"a": "10"}
    assert got[6] == {"a": "11"}
    assert got[7]["b"] == "13"
