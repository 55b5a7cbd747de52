"""Telemetry feeds as expressions over the given tables.

The expressions are plain SQL that Spark and DuckDB read alike, so the feeds of a query and of its
check are the same rows. ``events`` drives every feed; its id sets a dense clock (one record per
0.3 s from 2024-01-01 UTC), because the real times are too sparse for one-minute windows.
"""

from __future__ import annotations

START_MS = 1704067200000
STEP_MS = 300
MALFORMED_EVERY = 97

BASE = {
    "seq": "event_id",
    "event_type": "event_type",
    "value": "value",
    "user_id": "user_id",
    "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
    "ts": f"{START_MS} + event_id * {STEP_MS}",
}


def _block(n: int) -> str:
    return f"CAST(FLOOR(seq / {n}) AS BIGINT)"


def _d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


_MACHINE = "CAST(101 + user_id % 9 AS STRING)"
_MACHINE_INT = "CAST(101 + user_id % 9 AS INT)"
_TEMPERATURE = f"40 + value * {_d(0.4)}"
_VIBRATION_X = (
    f"({_d(0.5)} + k / 50) * CASE WHEN {_block(200)} % 5 = 3 THEN {_d(1.6)} ELSE {_d(1)} END"
)
_VIBRATION_Y = f"{_d(0.4)} + (seq % 7) * {_d(0.1)}"
_VIBRATION_Z = f"{_d(0.3)} + (seq % 5) * {_d(0.2)}"
_SPEED = "CAST(CASE WHEN event_type = 'signup' THEN 500 + k ELSE 2900 + k * 2 END AS DOUBLE)"

SENSOR_RAW = {
    "seq": "seq",
    "machine_id": _MACHINE,
    "ts": "ts",
    "temperature": _TEMPERATURE,
    "vibration_x": _VIBRATION_X,
    "vibration_y": _VIBRATION_Y,
    "vibration_z": _VIBRATION_Z,
    "current": (
        f"30 + (seq % 41 - 20) * {_d(0.1)} + "
        f"CASE WHEN {_block(100)} % 7 = 5 THEN {_d(8)} ELSE {_d(0)} END"
    ),
    "noise": f"50 + k * {_d(0.3)}",
    "speed": _SPEED,
}

LOG_RAW = {
    "seq": "seq",
    "machine_id": _MACHINE,
    "ts": "ts",
    "error_code": (
        # 777 is new and comes in bursts with silent windows between
        f"CASE WHEN {_block(150)} % 9 = 7 AND event_type = 'signup' THEN '777' ELSE "
        "CASE event_type WHEN 'error' THEN '999' WHEN 'purchase' THEN '500' ELSE '200' END END"
    ),
    "error_msg": (
        "CASE event_type "
        "WHEN 'error' THEN concat('spindle fault at block ', CAST(seq AS STRING), ' addr 0x00', "
        "CAST(k AS STRING), 'AF') "
        "WHEN 'purchase' THEN concat('coolant flow ', CAST(k AS STRING), '.5 below limit') "
        "WHEN 'signup' THEN concat('operator ', CAST(user_id AS STRING), ' logged in') "
        "WHEN 'view' THEN CASE WHEN k = 77 THEN concat('unmapped opcode 0x', CAST(k AS STRING), 'F') "
        "ELSE concat('probe ', CAST(seq AS STRING), ' read') END "
        "ELSE concat('cycle ', CAST(seq AS STRING), ' ok') END"
    ),
    "stack_trace": "concat('at unit', CAST(k % 5 AS STRING))",
}

_NAME = "concat('op-', chr(97 + k % 26), chr(CAST(97 + seq % 26 AS INT)))"
# messages with variable words that are no numbers, and one pattern that comes up in bursts with silence between
LOG_TEXT = {
    "seq": "seq",
    "machine_id": _MACHINE,
    "ts": "ts",
    "error_msg": (
        "CASE event_type "
        f"WHEN 'error' THEN concat('axis ', CASE k % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END, ' overload reported by ', {_NAME}) "
        "WHEN 'purchase' THEN concat('coolant pump ', CASE k % 2 WHEN 0 THEN 'left' ELSE 'right' END, ' pressure ', "
        "CASE WHEN k < 50 THEN 'low' ELSE 'high' END, ' at ', CAST(k AS STRING), '.5 bar') "
        f"WHEN 'signup' THEN CASE WHEN {_block(300)} % 4 = 2 THEN concat('servo bus desync seen by ', {_NAME}, ' near 0x', CAST(k AS STRING), 'F') "
        f"ELSE concat('user ', {_NAME}, ' opened program part-', chr(97 + k % 20), '.nc') END "
        "WHEN 'view' THEN concat('probe cycle finished in zone ', chr(97 + k % 20), ' status ok') "
        "ELSE CASE WHEN k = 7 THEN '' ELSE 'heartbeat ok' END END"
    ),
}

# one change per event; times are whole seconds, as in the feed's format
CHANGE_RECORD = {
    "seq": "seq",
    "machine_id": _MACHINE,
    "status": "CASE WHEN k % 3 = 0 THEN '预警' ELSE '运行' END",
    "start_s": "CAST(FLOOR(ts / 1000) AS BIGINT)",
    "end_s": "CAST(FLOOR(ts / 1000) AS BIGINT) + 60",
    # what is wrong with the line: too few fields, or a time that is none
    "flaw": "CASE WHEN k % 10 = 9 THEN 'short' WHEN k % 10 = 8 THEN 'time' ELSE '' END",
}

STATE_FILTER = "event_type IN ('click', 'view')"
DEVICE_STATE = {
    "seq": "seq",
    "ts": "ts",
    "machineId": _MACHINE_INT,
    "duration_seconds": f"value * {_d(10)}",
    "is_running": "CAST(CASE WHEN k < 50 THEN 1 ELSE 0 END AS INT)",
    "is_standby": "CAST(CASE WHEN k >= 50 AND k < 97 THEN 1 ELSE 0 END AS INT)",
    "is_offline": "CAST(CASE WHEN k >= 97 THEN 1 ELSE 0 END AS INT)",
    "isAlarm": (
        "CASE WHEN k % 10 = 3 THEN CASE seq % 5 WHEN 0 THEN '0x01001' WHEN 1 THEN '0x03004' "
        "WHEN 2 THEN '0x000E1' WHEN 3 THEN '0x17B02' ELSE '0x1200D' END "
        "WHEN k % 50 = 1 THEN '0xFFFFF' ELSE '' END"
    ),
    "cumulative_alarms": "k",
}

# where the two feeds are merged, every event is on one side; on their own, each feed has all events
METRICS_FILTER = "COALESCE(event_type, '') NOT IN ('click', 'view')"
SENSOR_METRICS = {
    # a numbering of its own, as another topic's offsets are
    "seq": "-seq",
    "ts": "ts",
    "machineId": _MACHINE_INT,
    "cutting_time": f"value * {_d(3)}",
    "cycle_time": f"value * {_d(3)} + 5",
    "spindle_load": f"1 + k * {_d(0.31)}",
    "feed_rate": "CAST(35 + k * 330 AS INT)",
    "spindle_speed": "CAST(144 + k * 30 AS INT)",
    "total_parts": "CAST(seq % 1000 AS INT)",
    "cumulative_runtime": f"seq * {_d(0.5)}",
    "cumulative_parts": "CAST(seq % 700 AS INT)",
    "avg_spindle_load_10": f"2 + k * {_d(0.25)}",
    "avg_cutting_time_10": f"value * {_d(2)}",
}

HIGHFREQ_SENSOR = {
    "seq": "seq",
    "ts": "ts",
    "machineId": _MACHINE_INT,
    "temperature": _TEMPERATURE,
    "vibration_x": _VIBRATION_X,
    "vibration_y": _VIBRATION_Y,
    "vibration_z": _VIBRATION_Z,
    "spindle_load": f"1 + k * {_d(0.31)}",
    "feed_rate": "CAST(35 + k * 330 AS INT)",
    "spindle_speed": "CAST(144 + k * 30 AS INT)",
    "is_running": f"CAST(CASE WHEN {_SPEED} >= 1000 THEN 1 ELSE 0 END AS INT)",
}

CHANGE_DATA = {
    "record_id": "seq",
    "machine_id": _MACHINE,
    "record_time": "ts",
    "device_ip": "concat('192.168.1.', CAST(user_id % 250 AS STRING))",
    "status": (
        "CASE k % 6 WHEN 0 THEN '运行' WHEN 1 THEN 'AUTO' WHEN 2 THEN '待机' WHEN 3 THEN 'MDI' "
        "WHEN 4 THEN '异常停机' ELSE '自动运行' END"
    ),
    "connection": "CASE WHEN event_type = 'view' THEN 'lost' ELSE 'normal' END",
    "alarm_no": "CASE WHEN event_type = 'error' THEN 1000 + k ELSE 0 END",
    "alarm_msg": "CASE WHEN event_type = 'error' THEN concat('故障', CAST(k AS STRING)) ELSE '无报警' END",
    "run_time": "770000 + k",
    "cut_time": "495000 + seq % 1000",
    "cycle_time": "613000 + seq % 777",
    "load_tenths": "k * 3",
    "total_parts": "7000 + k",
    "power_time": "1772000 + k",
    "parts": "3000 + seq % 500",
    "spindle_speed": "k * 30",
    "feed": "k * 330",
}

# std_params from the nation table: every second machine, so that defaults apply to the rest
STANDARDS = {
    "machine_id": "CAST(101 + n_nationkey * 2 AS STRING)",
    "current": f"CASE WHEN n_nationkey = 0 THEN {_d(45)} ELSE 29 + n_nationkey * {_d(0.5)} END",
    "speed": f"2900 + n_nationkey * {_d(20)}",
}

# rows by arrival (seq), some of them 45 s behind
ARRIVALS = {
    "seq": "seq",
    "machine_id": _MACHINE,
    "event_ms": "ts - CASE WHEN k % 8 = 7 THEN 45000 WHEN k % 8 = 6 THEN 20000 ELSE 0 END",
}

# two overlapping editions of the sensor table for the offline/realtime merge
OFFLINE_FILTER = "event_type <> 'click'"
REALTIME_FILTER = "event_type IN ('click', 'error', 'view')"


def select_list(expressions: dict[str, str], quote: str) -> list[str]:
    return [f"{e} AS {quote}{name}{quote}" for name, e in expressions.items()]
