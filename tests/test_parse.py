from spindlewatch import schemas
from spindlewatch.operators import parse


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq int, value string")


def test_lines_of_every_kind(spark):
    df = lines(
        spark,
        '{"machineId":7,"duration_seconds":1.5,"is_running":1,"isAlarm":"0x1","cumulative_alarms":3}',
        '{"machineId":"8","duration_seconds":"2.5","is_running":"1.0","isAlarm":null}',
        '{"machineId":9,"duration_seconds":"","is_running":null}',
        '{"machineId":10,"duration_seconds":"fast"}',
        '{"machineId":11,"dur',
        "",
        "   ",
        None,
        "not json",
        "[1,2]",
    )
    good = {r.seq: r for r in parse.parse_device_state(df).collect()}
    assert set(good) >= {0, 1, 2}
    assert (good[0].machineId, good[0].is_standby, good[0].isAlarm) == (7, 0, "0x1")
    assert (good[1].machineId, good[1].duration_seconds, good[1].is_running, good[1].isAlarm) == (8, 2.5, 1, "")
    assert (good[2].duration_seconds, good[2].is_running) == (0.0, 0)
    bad = {r.seq for r in parse.quarantine(df, schemas.DEVICE_STATE).collect()}
    assert {3, 4, 5, 6, 7, 8} <= bad
    assert not bad & set(good)
    assert bad | set(good) == set(range(10))


def test_missing_as_null(spark):
    df = lines(spark, '{"machine_id":"1","ts":5}')
    row = parse.parse_sensor_raw(df, missing="null").first()
    assert row.temperature is None
    assert row.ts == 5
    assert parse.parse_sensor_raw(df).first().temperature == 0.0


def test_large_epoch_keeps_every_digit(spark):
    df = lines(spark, '{"machine_id":"1","ts":9007199254740993}')
    assert parse.parse_json(df, schemas.SENSOR_RAW).first().ts == 9007199254740993


def test_change_lines(spark):
    df = lines(
        spark,
        "a,116,30,预警,2026-01-01 00:00:01,2026-01-01 00:00:02,9",
        "a,116,30,预警,2026-01-01 00:00:01.250,2026-01-01 00:00:02",
        "a,116,30,预警",
        "a,116,30,预警,bad,2026-01-01 00:00:02",
        "a,116,30,预警,2026-01-01 00:00:01,",
        "",
    )
    rows = parse.parse_change_record(df).orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1]
    assert (rows[0].machine_id, rows[0].status) == ("116", "预警")
    assert rows[1].start_time.microsecond == 250000


def test_tag(spark):
    assert parse.tag_feed(lines(spark, "x"), "sensor").first().topic_type == "sensor"
