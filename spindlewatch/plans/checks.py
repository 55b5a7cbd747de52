"""The same results in DuckDB SQL, over the same tables.

Feeds come from the shared expressions in ``fixture_exprs``; everything computed from them is
written here on its own, without segments, cells or roll-ups.
"""

from __future__ import annotations

from spindlewatch.functions.alarm_codes import ALARM_MESSAGES, UNKNOWN_ALARM_PREFIX
from spindlewatch.operators.cleaner import EXTENSION_FIELDS, OUTPUTS
from spindlewatch.plans.registry import BINS, DIGITS, FAR_HOURS, HORIZON_HOURS, HOUR_SECONDS, SURVIVAL_STEP_HOURS
from spindlewatch.sources import fixture_exprs as fx


def _select(expressions: dict[str, str], source: str, extra: str = "", where: str | None = None) -> str:
    items = ", ".join(fx.select_list(expressions, '"'))
    return f"SELECT {items}{extra} FROM {source}" + (f" WHERE {where}" if where else "")


_DICTIONARY = ", ".join(f"('{code}', '{text}')" for code, text in ALARM_MESSAGES.items())
_AT = ', epoch_ms(ts) AS "timestamp"'

# common table expressions by name, each with the names it needs
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "base": (_select(fx.BASE, "events"), ()),
    "sensor": (f"SELECT *{_AT} FROM ({_select(fx.SENSOR_RAW, 'base')})", ("base",)),
    "logs": (f"SELECT *{_AT} FROM ({_select(fx.LOG_RAW, 'base')})", ("base",)),
    "change_rows": (_select(fx.CHANGE_RECORD, "base"), ("base",)),
    "changes": (
        "SELECT seq, machine_id, status, epoch_ms(start_s * 1000) AS start_time, "
        "epoch_ms(end_s * 1000) AS end_time FROM change_rows WHERE flaw = ''",
        ("change_rows",),
    ),
    "state": (_select(fx.DEVICE_STATE, "base", where=fx.STATE_FILTER), ("base",)),
    "metrics": (_select(fx.SENSOR_METRICS, "base", where=fx.METRICS_FILTER), ("base",)),
    "all_state": (_select(fx.DEVICE_STATE, "base"), ("base",)),
    "all_metrics": (_select(fx.SENSOR_METRICS, "base"), ("base",)),
    "highfreq": (_select(fx.HIGHFREQ_SENSOR, "base"), ("base",)),
    "cells": (_select(fx.CHANGE_DATA, "base"), ("base",)),
    "standards": (_select(fx.STANDARDS, "nation"), ()),
    "arrivals": (_select(fx.ARRIVALS, "base"), ("base",)),
    "quarters": ("SELECT *, seq * 4 // (SELECT max(seq) + 1 FROM arrivals) AS part FROM arrivals", ("arrivals",)),
    "quarter_ends": ("SELECT part, max(event_ms) AS newest FROM quarters GROUP BY part", ("quarters",)),
    "dictionary": (f"SELECT * FROM (VALUES {_DICTIONARY}) AS t(code, message)", ()),
    "sensor_status": (
        """SELECT s.*, COALESCE(c.status, '') AS status FROM sensor s ASOF LEFT JOIN (
             SELECT machine_id, start_time, arg_max(status, seq) AS status FROM changes
             WHERE machine_id IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2) c
           ON s.machine_id = c.machine_id AND s."timestamp" >= c.start_time""",
        ("sensor", "changes"),
    ),
    "statuses": (
        """SELECT seq, machine_id, "timestamp" AS update_time, machine_status,
             temperature AS current_temperature, vibration_x AS current_vibration_rms,
             CASE machine_status WHEN '稳定运行' THEN 100.0 WHEN '启动中' THEN 80.0 ELSE 60.0 END::DOUBLE
               AS health_score
           FROM (SELECT *, CASE WHEN status = '预警' THEN '异常停机' WHEN speed < 1000 THEN '启动中'
                   ELSE '稳定运行' END AS machine_status FROM sensor_status)""",
        ("sensor_status",),
    ),
    "sensor_alerts": (
        """SELECT "timestamp" AS alert_time, machine_id,
             CASE WHEN temperature > 80 THEN '高温预警' ELSE '振动异常' END AS alert_type,
             CASE WHEN temperature > 80 THEN temperature ELSE vibration_x END AS trigger_value,
             CASE WHEN temperature > 80 THEN 80.0 ELSE 2.0 END::DOUBLE AS threshold_value,
             '请立即检查设备' AS suggested_action
           FROM sensor WHERE temperature > 80 OR vibration_x > 2""",
        ("sensor",),
    ),
    "log_alerts": (
        """SELECT "timestamp" AS alert_time, machine_id, '严重错误: 999' AS alert_type,
             999.0::DOUBLE AS trigger_value, 0.0::DOUBLE AS threshold_value,
             '请立即检查硬件日志' AS suggested_action FROM logs WHERE error_code = '999'""",
        ("logs",),
    ),
    "deviations": (
        """SELECT s.*, COALESCE(p."current", 30.0) AS std_current, COALESCE(p.speed, 3000.0) AS std_speed,
             abs(s."current" - std_current) / std_current AS current_dev,
             abs(s.speed - std_speed) / std_speed AS speed_dev
           FROM sensor s LEFT JOIN standards p ON s.machine_id = p.machine_id""",
        ("sensor", "standards"),
    ),
    "sliding_slots": ("SELECT unnest([0, 10000, 20000]) AS back", ()),
    "sustained": (
        """SELECT epoch_ms(ts - ts % 30000) AS record_time, machine_id, 'current' AS param_name,
             max("current") AS actual_value, max(std_current) AS standard_value,
             max(current_dev) * 100 AS deviation_ratio, 30::INT AS duration_seconds
           FROM deviations GROUP BY ts - ts % 30000, machine_id HAVING min(current_dev) > 0.10""",
        ("deviations",),
    ),
    "deviations_by_param": (
        """SELECT ts, seq, machine_id, 'current' AS param_name, "current" AS actual, std_current AS std, current_dev AS dev FROM deviations
           UNION ALL SELECT ts, seq, machine_id, 'speed', speed, std_speed, speed_dev FROM deviations""",
        ("deviations",),
    ),
    "log_texts": (_select(fx.LOG_TEXT, "base"), ("base",)),
    "surge_counts": (
        """SELECT (ts - ts % 10000) // 1000 AS s, epoch_ms(ts - ts % 10000) AS window_start, error_code, count(*) AS n
           FROM logs GROUP BY 1, 2, 3""",
        ("logs",),
    ),
    "features": (
        """SELECT epoch_ms(ts - ts % 60000) AS window_start, epoch_ms(ts - ts % 60000 + 60000) AS window_end,
             "machineId",
             floor(var_pop(temperature) * 100 + 0.5) / 100 AS var_temp,
             floor(CASE WHEN var_pop(temperature) > 1e-9 THEN COALESCE(kurtosis_pop(temperature), 0)
               ELSE 0 END * 100 + 0.5) / 100 AS kurtosis_temp,
             floor(CASE WHEN sqrt(avg(vibration_x * vibration_x)) > 1e-6 THEN max(abs(vibration_x))
               ELSE 0 END * 1000 + 0.5) / 1000 AS fft_peak,
             floor(avg(spindle_load) * 10 + 0.5) / 10 AS avg_spindle_load,
             floor(max(spindle_load) * 10 + 0.5) / 10 AS max_spindle_load,
             floor(avg(CASE WHEN is_running = 1 THEN 1.0::DOUBLE ELSE 0.0 END) * 10000 + 0.5) / 10000
               AS running_ratio,
             floor(avg(feed_rate) + 0.5) AS avg_feed_rate
           FROM highfreq GROUP BY ts - ts % 60000, "machineId" """,
        ("highfreq",),
    ),
    # a stream's final watermark: five seconds behind the newest record of any of its inputs
    "watermark": ("SELECT epoch_ms(max(ts) - 5000) AS w FROM base", ("base",)),
    "lowfreq_watermark": (
        """SELECT epoch_ms(greatest((SELECT max(ts) FROM state), (SELECT max(ts) FROM metrics)) - 5000) AS w""",
        ("state", "metrics"),
    ),
    "status_watermark": (
        """SELECT epoch_ms(greatest((SELECT max(ts) FROM base),
             (SELECT max(epoch_ms(start_time)) FROM changes)) - 5000) AS w""",
        ("changes",),
    ),
    "merged": (
        """SELECT "machineId", ts, seq, 0 AS side FROM state UNION ALL
           SELECT "machineId", ts, seq, 1 FROM metrics""",
        ("state", "metrics"),
    ),
    "run_rows": (
        """SELECT *, sum(starts) OVER w AS run FROM (
             SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY "machineId" ORDER BY ts, side, seq)
               THEN 0 ELSE 1 END AS starts FROM merged)
           WINDOW w AS (PARTITION BY "machineId" ORDER BY ts, side, seq)""",
        ("merged",),
    ),
    "run_list": (
        """SELECT "machineId", run, any_value(side) AS side, count(*) AS len, arg_min(seq, (ts, seq)) AS first_seq,
             arg_max(seq, (ts, seq)) AS last_seq FROM run_rows GROUP BY 1, 2""",
        ("run_rows",),
    ),
    "run_pending": (
        """SELECT *, CASE WHEN r IS NULL THEN run % 2 = 1 ELSE (run - r) % 2 = 0 END AS waits FROM (
             SELECT *, max(CASE WHEN len >= 2 THEN run END) OVER (
               PARTITION BY "machineId" ORDER BY run) AS r FROM run_list)""",
        ("run_list",),
    ),
    "pair_keys": (
        """SELECT "machineId", first_seq AS seq, CASE WHEN side = 0 THEN first_seq ELSE prev END AS s_seq,
             CASE WHEN side = 0 THEN prev ELSE first_seq END AS m_seq
           FROM (SELECT *, lag(last_seq) OVER w AS prev, lag(waits) OVER w AS prev_waits FROM run_pending
                 WINDOW w AS (PARTITION BY "machineId" ORDER BY run)) WHERE prev_waits""",
        ("run_pending",),
    ),
    "pairs": (
        """SELECT k.seq, greatest(s.ts, m.ts) AS ts, k."machineId", s.duration_seconds, s.is_running,
             s.is_standby, s.is_offline, m.cutting_time, m.cycle_time, m.total_parts, m.spindle_load,
             m.cumulative_runtime, m.cumulative_parts, s.cumulative_alarms, m.avg_spindle_load_10,
             m.avg_cutting_time_10, s."isAlarm"
           FROM pair_keys k JOIN state s ON s.seq = k.s_seq JOIN metrics m ON m.seq = k.m_seq""",
        ("pair_keys", "state", "metrics"),
    ),
    "records": (
        f"""SELECT p.* EXCLUDE (ts, "isAlarm"),
              COALESCE(f.var_temp, 0) AS var_temp, COALESCE(f.kurtosis_temp, 0) AS kurtosis_temp,
              COALESCE(f.fft_peak, 0) AS fft_peak, COALESCE(f.avg_spindle_load, 0) AS avg_spindle_load_win,
              COALESCE(f.max_spindle_load, 0) AS max_spindle_load_win,
              COALESCE(f.running_ratio, 0) AS running_ratio, COALESCE(f.avg_feed_rate, 0) AS avg_feed_rate,
              CASE WHEN p."isAlarm" = '' THEN '' ELSE
                COALESCE(d.message, '{UNKNOWN_ALARM_PREFIX}' || p."isAlarm") END AS "alarmMessage"
            FROM pairs p ASOF LEFT JOIN features f
              ON p."machineId" = f."machineId" AND epoch_ms(p.ts) >= f.window_end
            LEFT JOIN dictionary d ON d.code = p."isAlarm" """,
        ("pairs", "features", "dictionary"),
    ),
    "labels": (
        f"""SELECT f."machineId", window_start, any_value(var_temp) AS var_temp, any_value(fft_peak) AS fft_peak,
              (epoch_ms(min(l."timestamp")) - epoch_ms(window_end)) / {HOUR_SECONDS * 1000} AS rul_hours
            FROM features f JOIN logs l ON CAST(l.machine_id AS INT) = f."machineId"
              AND l.error_code = '999' AND l."timestamp" >= f.window_end
            GROUP BY f."machineId", window_start, window_end""",
        ("features", "logs"),
    ),
    "lives": (
        f"""SELECT f.*, coalesce(l.rul_hours, greatest(0.0, ((SELECT epoch_ms(max("timestamp")) FROM logs) - epoch_ms(window_end))
              / {HOUR_SECONDS * 1000})) AS life_hours, l.rul_hours IS NOT NULL AS failed
            FROM features f LEFT JOIN (SELECT "machineId", window_start, rul_hours FROM labels) l USING ("machineId", window_start)""",
        ("features", "labels", "logs"),
    ),
    "life_steps": (
        f"""SELECT coalesce(state, 'other') AS grp, floor(life_hours / {SURVIVAL_STEP_HOURS}) * {SURVIVAL_STEP_HOURS}::DOUBLE AS after_hours,
              count(*) FILTER (failed) AS failures, count(*) FILTER (NOT failed) AS censored
            FROM lives LEFT JOIN (SELECT *, 'stable' AS state FROM stable) USING ("machineId", window_start) GROUP BY 1, 2""",
        ("lives", "stable"),
    ),
    "far_lines": (
        f"""SELECT regr_slope(rul_hours, var_temp) AS s1, regr_intercept(rul_hours, var_temp) AS i1,
              regr_slope(fails, fft_peak) AS s2, regr_intercept(fails, fft_peak) AS i2
            FROM (SELECT *, CASE WHEN rul_hours <= {FAR_HOURS} THEN 1.0 ELSE 0.0 END::DOUBLE AS fails FROM labels)
            WHERE (epoch_ms(window_start) // 60000) % 4 <> 3""",
        ("labels",),
    ),
    "far_scored": (
        """SELECT f.*, greatest(0.0, i1 + s1 * var_temp) AS rul_value,
             least(1.0, greatest(0.0, i2 + s2 * fft_peak)) AS failure_probability
           FROM features f JOIN stable USING ("machineId", window_start), far_lines""",
        ("features", "stable", "far_lines"),
    ),
    "score_bins": (
        f"""SELECT least(floor(p * {BINS}), {BINS} - 1)::INT AS bin, count(*) AS n, count(*) FILTER (fails) AS failures, avg(p) AS mean_score FROM (
              SELECT least(1.0, greatest(0.0, i2 + s2 * fft_peak)) AS p, failed AND life_hours <= {FAR_HOURS} AS fails FROM lives, far_lines
              WHERE (epoch_ms(window_start) // 60000) % 4 = 3 AND (failed OR life_hours > {FAR_HOURS})) GROUP BY 1""",
        ("lives", "far_lines"),
    ),
    "calibration": (
        """SELECT bin, max(least_mean) AS calibrated FROM (
             SELECT i.bin, j.bin AS first, min((SELECT sum(failures) / sum(n) FROM score_bins b WHERE b.bin BETWEEN j.bin AND k.bin)) AS least_mean
             FROM score_bins i JOIN score_bins j ON j.bin <= i.bin JOIN score_bins k ON k.bin >= i.bin GROUP BY 1, 2) GROUP BY 1""",
        ("score_bins",),
    ),
    "stable": (
        """SELECT CAST(machine_id AS INT) AS "machineId", date_trunc('minute', update_time) AS window_start
           FROM statuses GROUP BY 1, 2 HAVING arg_max(machine_status, (update_time, seq)) = '稳定运行'""",
        ("statuses",),
    ),
    "lines": (
        f"""SELECT regr_slope(rul_hours, var_temp) AS s1, regr_intercept(rul_hours, var_temp) AS i1,
              regr_slope(fails, fft_peak) AS s2, regr_intercept(fails, fft_peak) AS i2
            FROM (SELECT *, CASE WHEN rul_hours <= {HORIZON_HOURS} THEN 1.0 ELSE 0.0 END::DOUBLE AS fails FROM labels)
            WHERE (epoch_ms(window_start) // 60000) % 4 <> 3""",
        ("labels",),
    ),
    "scored": (
        """SELECT f.*, greatest(0.0, i1 + s1 * var_temp) AS rul_value,
             least(1.0, greatest(0.0, i2 + s2 * fft_peak)) AS failure_probability
           FROM features f JOIN stable USING ("machineId", window_start), lines""",
        ("features", "stable", "lines"),
    ),
}


def _window_cte(name: str, ms: int, label: str) -> str:
    return f"""SELECT epoch_ms(ts - ts % {ms}) AS window_start, epoch_ms(ts - ts % {ms} + {ms}) AS window_end,
      machine_id, max(temperature) AS max_temperature,
      sqrt(avg(vibration_x * vibration_x + vibration_y * vibration_y + vibration_z * vibration_z))
        AS avg_vib_rms,
      stddev_pop("current") AS current_fluctuation, max(temperature) - min(temperature) AS temp_slope,
      '{label}' AS window_type FROM sensor GROUP BY ts - ts % {ms}, machine_id"""


for _name, _ms in (("w3s", 3000), ("w1m", 60_000), ("w5m", 300_000), ("w1h", 3_600_000)):
    _CTES[_name] = (_window_cte(_name, _ms, _name[1:]), ("sensor",))

_CTES["w3s_gaps"] = (
    """SELECT *, COALESCE(gap > 1 AND gap <= 5, false) AS filled FROM (
         SELECT *, (epoch_ms(window_end) - epoch_ms(lag(window_end) OVER w)) // 1000 AS gap FROM w3s
         WINDOW w AS (PARTITION BY machine_id ORDER BY window_end))""",
    ("w3s",),
)
_CTES["spikes"] = (
    """SELECT window_end AS alert_time, machine_id,
         concat('振动突增:', printf('%.2f', abs(avg_vib_rms - prev) / prev * 100), '%%') AS alert_type,
         avg_vib_rms AS trigger_value, 0.0::DOUBLE AS threshold_value, '请立即检查设备' AS suggested_action
       FROM (SELECT *, lag(avg_vib_rms) OVER (PARTITION BY machine_id ORDER BY window_end) AS prev FROM w1m)
       WHERE prev > 0 AND abs(avg_vib_rms - prev) / prev >= 0.2""",
    ("w1m",),
)


def sql(body: str, *needs: str) -> str:
    """``body`` with the expressions it needs, in order, ahead of it."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _CTES[name][1]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    head = ",\n".join(f"{name} AS ({_CTES[name][0]})" for name in order)
    return f"WITH {head}\n{body}" if order else body


def rounded(names: str, plain: str = "") -> str:
    """Select list: ``names`` rounded, ``plain`` as they are (both space-separated)."""
    items = [f'"{n}"' for n in plain.split()]
    items += [f'round("{n}", {DIGITS}) AS "{n}"' for n in names.split()]
    return ", ".join(items)


_MEASURES = "max_temperature avg_vib_rms current_fluctuation temp_slope"
_WINDOW = rounded(_MEASURES, "window_start window_end machine_id window_type")
_ALERT = rounded("trigger_value threshold_value", "alert_time machine_id alert_type suggested_action")
_STATUS_ROW = rounded(
    "current_temperature current_vibration_rms health_score", "seq machine_id update_time machine_status"
)
_DEVIATION_ROW = rounded(
    "actual_value standard_value deviation_ratio", "record_time machine_id param_name duration_seconds"
)
_READABLE = f"seq % {fx.MALFORMED_EVERY} <> 0"
_FEATURES = rounded(
    "var_temp kurtosis_temp fft_peak avg_spindle_load max_spindle_load running_ratio avg_feed_rate",
    "window_start window_end machineId",
)
_PAIR = rounded(
    "duration_seconds cutting_time cycle_time spindle_load cumulative_runtime avg_spindle_load_10 "
    "avg_cutting_time_10",
    "seq machineId is_running is_standby is_offline total_parts cumulative_parts cumulative_alarms",
)
_RECORD = f"""{_PAIR}, {rounded(
    "var_temp kurtosis_temp fft_peak avg_spindle_load_win max_spindle_load_win running_ratio "
    "avg_feed_rate", "alarmMessage")}"""
_CLEAN_NUMBERS = """CASE WHEN status IN ('运行', '运行中', '自动运行', 'AUTO') THEN 1.0 ELSE 0.0 END::DOUBLE
    AS "isRunning",
  CASE WHEN status IN ('待机', '暂停', 'RESET', 'MDI') THEN 1.0 ELSE 0.0 END::DOUBLE AS "isStandby",
  CASE WHEN connection = 'normal' THEN 0.0 ELSE 1.0 END::DOUBLE AS "isOffline",
  CASE WHEN alarm_no > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS "isAlarm",
  run_time::DOUBLE AS "durationSeconds", cut_time::DOUBLE AS "cuttingTime",
  cycle_time::DOUBLE AS "cycleTime", round(load_tenths / 10, 2) AS "spindleLoad",
  total_parts::DOUBLE AS "totalParts", power_time::DOUBLE AS "cumRuntime", parts::DOUBLE AS "cumParts",
  round(load_tenths / 10, 2) AS "avgSpindleLoad", spindle_speed::DOUBLE AS "spindleSpeed",
  feed::DOUBLE AS "feedSpeed", device_ip, status AS machine_status,
  CAST(alarm_no AS VARCHAR) AS alarm_code, alarm_msg AS alarm_message"""


def _mean_of_ten(column: str, name: str) -> str:
    over = 'OVER (PARTITION BY "machineId" ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)'
    return f'floor(avg({column}) {over} * 10 + 0.5) / 10 AS {name}'


def _quarantined() -> str:
    feeds = [("sensor", "sensor"), ("log", "logs"), ("state", "all_state"), ("metrics", "all_metrics"),
             ("highfreq", "highfreq")]
    parts = [
        f"SELECT seq, '{tag}' AS topic_type, 40::INT AS n_chars FROM {cte} WHERE NOT ({_READABLE})"
        for tag, cte in feeds
    ]
    return " UNION ALL ".join(parts)


def _interpolated(until: str = "true") -> str:
    def line(c: str) -> str:
        return f"p_{c} + ({c} - p_{c}) * (k * 1000 / gap)"

    columns = ("temperature", "vibration_x", "current")
    lags = ", ".join(f'lag("{c}") OVER w AS p_{c}' for c in columns)
    values = ", ".join(f"round({line(c)}, {DIGITS}) AS \"{c}\"" for c in columns)
    return f"""SELECT machine_id, epoch_ms(p_ts + k * 1000) AS "timestamp", {values} FROM (
      SELECT *, ts - p_ts AS gap, unnest(range(1, 6)) AS k FROM (
        SELECT *, lag(ts) OVER w AS p_ts, {lags} FROM sensor
        WINDOW w AS (PARTITION BY machine_id ORDER BY ts, seq)))
      WHERE gap > 1000 AND gap <= 5000 AND k * 1000 < gap AND {until}"""


def _throttled(statuses: str, until: str = "true") -> str:
    columns = rounded("health_score", "machine_id update_time machine_status")
    return sql("", statuses, "status_watermark").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
      secs AS (SELECT machine_id, epoch_ms(update_time) // 1000 AS s, arg_min(seq, (update_time, seq)) AS seq
        FROM {statuses} WHERE {until} GROUP BY 1, 2),
      hits AS (
        SELECT machine_id, min(s) AS s FROM secs GROUP BY 1
        UNION ALL
        SELECT machine_id, s FROM (
          SELECT h.machine_id, (SELECT min(c.s) FROM secs c WHERE c.machine_id = h.machine_id
            AND c.s >= h.s + 60) AS s FROM hits h) WHERE s IS NOT NULL)
      SELECT {columns} FROM hits JOIN secs USING (machine_id, s) JOIN {statuses} USING (machine_id, seq)"""


_SLIDING = f"""SELECT {_DEVIATION_ROW} FROM (
  SELECT epoch_ms(ts - ts % 10000 - back) AS record_time, machine_id, 'current' AS param_name,
    max("current") AS actual_value, max(std_current) AS standard_value,
    max(current_dev) * 100 AS deviation_ratio, 30::INT AS duration_seconds
  FROM deviations, sliding_slots WHERE current_dev > 0.028 OR speed_dev > 0.028
  GROUP BY ts - ts % 10000 - back, machine_id)"""
_HELD = f"""SELECT {rounded(_MEASURES, 'window_start window_end machine_id window_type filled')} FROM (
  SELECT * REPLACE (
    last_value(CASE WHEN NOT filled THEN max_temperature END IGNORE NULLS) OVER w AS max_temperature,
    last_value(CASE WHEN NOT filled THEN avg_vib_rms END IGNORE NULLS) OVER w AS avg_vib_rms,
    last_value(CASE WHEN NOT filled THEN current_fluctuation END IGNORE NULLS) OVER w AS current_fluctuation)
  FROM w3s_gaps WINDOW w AS (PARTITION BY machine_id ORDER BY window_end))"""

def _landed() -> str:
    """Lines by feed and target; tests compare their contents."""
    parts = []
    feeds = [("sensor", "sensor", True), ("log", "logs", True), ("change", "change_rows", True), ("state", "all_state", False),
             ("metrics", "all_metrics", False), ("highfreq", "highfreq", False)]
    for feed, cte, files in feeds:
        for target in ["topic", "files"] if files else ["topic"]:
            cut = "0" if feed == "change" else f"count(*) FILTER (seq % {fx.MALFORMED_EVERY} = 0)"
            parts.append(
                f"SELECT '{feed}' AS topic_type, '{target}' AS target, count(*) AS n, {cut}::BIGINT AS n_cut_off FROM {cte}"
            )
    return sql(" UNION ALL ".join(parts), *[cte for _, cte, _ in feeds])


def _episodes(threshold: float, seconds: int, gap: int = 15, until: str = "true", ended: bool = False) -> str:
    """Islands of readings over a threshold, numbered over a machine's whole history."""
    still_open = "run = max(run) OVER (PARTITION BY machine_id, param_name)"
    return sql(
        f"""SELECT epoch_ms(first) AS record_time, epoch_ms(last) AS end_time, machine_id, param_name,
          round(actual, {DIGITS}) AS actual_value, round(std, {DIGITS}) AS standard_value, round(dev * 100, {DIGITS}) AS deviation_ratio,
          round((last - first) / 1000, {DIGITS}) AS duration_seconds, n_readings, still_open FROM (
          SELECT machine_id, param_name, run, min(ts) AS first, max(ts) AS last, max(actual) AS actual, max(std) AS std, max(dev) AS dev,
            count(*) AS n_readings, any_value(over) AS over, {still_open} AS still_open FROM (
            SELECT *, sum(starts) OVER (PARTITION BY machine_id, param_name ORDER BY ts, seq) AS run FROM (
              SELECT *, dev > {threshold} AS over,
                CASE WHEN (lag(dev) OVER w > {threshold}) IS NOT DISTINCT FROM (dev > {threshold}) AND ts - lag(ts) OVER w <= {gap * 1000}
                  THEN 0 ELSE 1 END AS starts
              FROM deviations_by_param WHERE {until} WINDOW w AS (PARTITION BY machine_id, param_name ORDER BY ts, seq)))
          GROUP BY machine_id, param_name, run)
        WHERE over AND last - first >= {seconds * 1000}{" AND NOT still_open" if ended else ""}""",
        "deviations_by_param", *(["watermark"] if ended else []),
    )


def _clusters(body: str, depth: int = 4, merge_at: int = 5, merges: int = 2) -> str:
    """Templates of all messages, round by round, as ``found(text, template)`` and the lines as ``lines``."""
    masked = (
        "array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(error_msg, ''), '0x[0-9A-Fa-f]+', '<hex>', 'g'), "
        "'[0-9]+(\\.[0-9]+)?', '<num>', 'g'), '\\s+'), lambda x: x <> ''), ' ')"
    )
    parts = [
        f"lines AS (SELECT seq, machine_id, ts, error_msg, {masked} AS text FROM log_texts)",
        "m0 AS MATERIALIZED (SELECT text, words, CAST(len(words) AS VARCHAR) AS grp FROM (SELECT text, list_filter(string_split(text, ' '), "
        "lambda x: x <> '') AS words FROM (SELECT DISTINCT text FROM lines)))",
    ]
    places = "SELECT *, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM"
    for i in range(depth):
        parts += [
            f"c{i} AS (SELECT grp, pos, word, count(*) AS c FROM ({places} m{i}) GROUP BY ALL)",
            f"q{i} AS (SELECT grp, pos, count(*) AS d, sum(c)::DOUBLE AS n, sum(c * c)::DOUBLE AS s FROM c{i} GROUP BY ALL)",
            f"b{i} AS (SELECT grp, arg_max(pos, (s, -pos)) AS place FROM q{i} WHERE d > 1 AND n * n * n <= s * s GROUP BY grp)",
            f"m{i + 1} AS MATERIALIZED (SELECT text, words, CASE WHEN place IS NULL THEN grp ELSE concat(grp, ' ', place, ' ', words[place + 1]) END AS grp "
            f"FROM m{i} LEFT JOIN b{i} USING (grp))",
        ]
    parts.append(
        "t0 AS (SELECT grp, list(CASE WHEN low = high THEN low ELSE '<*>' END ORDER BY pos) AS template FROM ("
        f"SELECT grp, pos, min(word) AS low, max(word) AS high FROM ({places} m{depth}) GROUP BY ALL) GROUP BY grp)"
    )
    for i in range(merges):
        parts += [
            f"k{i} AS (SELECT template, pos, template[:pos] || ['<*>'] || template[pos + 2:] AS merged FROM ("
            f"SELECT template, unnest(range(len(template))) AS pos FROM (SELECT DISTINCT template FROM t{i})))",
            f"z{i} AS (SELECT pos, merged, count(*) AS c FROM k{i} GROUP BY ALL HAVING count(*) >= {merge_at})",
            f"g{i} AS (SELECT template, arg_max(merged, (c, -pos)) AS merged FROM k{i} JOIN z{i} USING (pos, merged) GROUP BY template)",
            f"t{i + 1} AS (SELECT grp, coalesce(merged, t.template) AS template FROM t{i} t LEFT JOIN g{i} g ON g.template = t.template)",
        ]
    parts.append(
        f"found AS (SELECT text, coalesce(array_to_string(template, ' '), '') AS template FROM m{depth} LEFT JOIN t{merges} USING (grp))"
    )
    return sql("", "log_texts") + "," + ",\n".join(parts) + "\n" + body


_RECORD_FIELDS = _RECORD.replace('"seq", ', "")


def _clean_outputs() -> str:
    """Each target's columns of every record, null where the target has no such column."""
    source = f"SELECT record_id, machine_id, epoch_ms(record_time) AS record_time, {_CLEAN_NUMBERS} FROM cells"
    every = OUTPUTS["cleaned_full_csv"][1]
    parts = []
    for target, name in (("full", "cleaned_full_csv"), ("metrics", "device_metrics_csv"), ("state", "device_state_csv"),
                         ("json", "json_backup")):
        held = OUTPUTS[name][1]
        columns = ", ".join(
            (f"nullif(\"{c}\", '') AS \"{c}\"" if c in EXTENSION_FIELDS else f'"{c}"') if c in held
            else f'CASE WHEN false THEN "{c}" END AS "{c}"'
            for c in every if c != "clean_time"
        )
        parts.append(f"SELECT {columns}, '{target}' AS target FROM ({source})")
    return sql(" UNION ALL ".join(parts), "cells")


CHECKS: dict[str, str] = {
    "parse_sensor_json": sql(
        f"""SELECT {rounded('temperature vibration_x vibration_y vibration_z current speed',
            'seq machine_id ts timestamp')},
          CASE WHEN seq % 10 = 0 THEN 0 ELSE round(noise, {DIGITS}) END AS noise
        FROM sensor WHERE {_READABLE}""", "sensor"),
    "parse_log_json": sql(f"SELECT * FROM logs WHERE {_READABLE}", "logs"),
    "parse_change_csv": sql("SELECT * FROM changes", "changes"),
    "parse_device_state_json": sql(
        f"""SELECT {rounded('duration_seconds', 'seq machineId is_running is_standby is_offline isAlarm '
            'cumulative_alarms')} FROM all_state WHERE {_READABLE}""", "all_state"),
    "parse_sensor_metrics_json": sql(
        f"""SELECT {rounded('cutting_time cycle_time spindle_load cumulative_runtime avg_spindle_load_10 '
            'avg_cutting_time_10', 'seq machineId feed_rate spindle_speed total_parts cumulative_parts')}
        FROM all_metrics WHERE {_READABLE}""", "all_metrics"),
    "parse_highfreq_json": sql(
        f"""SELECT {rounded('temperature vibration_x vibration_y vibration_z spindle_load',
            'seq machineId feed_rate spindle_speed is_running')},
          strftime(epoch_ms(ts), '%Y-%m-%d %H:%M:%S.%g') AS "timestamp", epoch_ms(ts) AS event_time
        FROM highfreq WHERE {_READABLE}""", "highfreq"),
    "quarantine": sql(_quarantined(), "sensor", "logs", "all_state", "all_metrics", "highfreq"),
    "sensor_alerts": sql(f"SELECT {_ALERT} FROM sensor_alerts", "sensor_alerts"),
    "log_alerts": sql(f"SELECT {_ALERT} FROM log_alerts", "log_alerts"),
    "log_alerts_both_codes": sql(
        """SELECT "timestamp" AS alert_time, machine_id, '严重错误: ' || error_code AS alert_type,
          error_code::DOUBLE AS trigger_value, 0.0::DOUBLE AS threshold_value,
          '请立即检查硬件日志' AS suggested_action FROM logs WHERE error_code IN ('999', '500')""", "logs"),
    "alerts_union": sql(
        f"SELECT {_ALERT} FROM sensor_alerts UNION ALL SELECT {_ALERT} FROM log_alerts",
        "sensor_alerts", "log_alerts"),
    "alerts_with_spikes": sql(
        f"SELECT {_ALERT} FROM sensor_alerts UNION ALL SELECT {_ALERT} FROM log_alerts UNION ALL SELECT {_ALERT} FROM spikes",
        "sensor_alerts", "log_alerts", "spikes"),
    "alert_json": sql(
        f"""SELECT * REPLACE (strftime(alert_time, '%Y-%m-%d %H:%M:%S.%g') AS alert_time) FROM (
          SELECT {_ALERT} FROM sensor_alerts UNION ALL SELECT {_ALERT} FROM log_alerts)""",
        "sensor_alerts", "log_alerts"),
    "log_severity": sql(
        """SELECT * EXCLUDE (seq), CASE error_code WHEN '999' THEN 'Critical' WHEN '500' THEN 'High'
          ELSE 'Normal' END AS severity FROM logs""", "logs"),
    "error_surge": sql(
        f"""SELECT window_start, error_code, n, round(baseline, {DIGITS}) AS baseline FROM (
          SELECT s, window_start, error_code, n, (SELECT COALESCE(sum(p.n), 0) FROM surge_counts p
              WHERE p.error_code = c.error_code AND p.s BETWEEN c.s - 50 AND c.s - 10)
            / NULLIF(least(5, (c.s - (SELECT min(s) FROM surge_counts)) // 10), 0) AS baseline
          FROM surge_counts c) WHERE n >= 1.5 * baseline AND (baseline > 0 OR n >= 3)""", "surge_counts"),
    "log_templates": sql(
        """SELECT regexp_replace(regexp_replace(error_msg, '0x[0-9A-Fa-f]+', '<hex>', 'g'),
            '[0-9]+(\\.[0-9]+)?', '<num>', 'g') AS template, count(*) AS n,
          min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM logs GROUP BY 1""", "logs"),
    "rare_templates": sql(
        """SELECT regexp_replace(regexp_replace(error_msg, '0x[0-9A-Fa-f]+', '<hex>', 'g'),
            '[0-9]+(\\.[0-9]+)?', '<num>', 'g') AS template, count(*) AS n,
          min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM logs GROUP BY 1
        HAVING count(*) <= 0.005 * (SELECT count(*) FROM logs)""", "logs"),
    "error_change_points": sql(
        f"""SELECT window_start, error_code, n, round(score, {DIGITS}) AS score, round(sqrt(mean) * 4, {DIGITS}) AS score_limit, began FROM (
          SELECT *, after - least(low, after) AS score, coalesce(
            last_value(CASE WHEN before <= low THEN window_start END IGNORE NULLS) OVER u, first_value(window_start) OVER u) AS began FROM (
            SELECT *, least(0.0, min(before) OVER u) AS low FROM (
              SELECT *, upto - n - drift * t AS before, upto - drift * (t + 1) AS after FROM (
                SELECT *, mean + sqrt(mean) * 0.5 AS drift, sum(n) OVER u AS upto FROM (
                  SELECT *, (s - min(s) OVER ()) // 10 AS t, sum(n) OVER (PARTITION BY error_code) / ((max(s) OVER () - min(s) OVER ()) / 10 + 1) AS mean
                  FROM surge_counts) WINDOW u AS (PARTITION BY error_code ORDER BY s)))
            WINDOW u AS (PARTITION BY error_code ORDER BY s))
          WINDOW u AS (PARTITION BY error_code ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        WHERE score > sqrt(mean) * 4""", "surge_counts"),
    "log_line_patterns": _clusters("SELECT seq, machine_id, error_msg, template FROM lines JOIN found USING (text)"),
    "log_patterns_found": _clusters(
        """SELECT template, count(*) AS n, epoch_ms(min(ts)) AS first_seen, epoch_ms(max(ts)) AS last_seen
        FROM lines JOIN found USING (text) GROUP BY template"""
    ),
    "log_new_patterns": _clusters(
        """SELECT epoch_ms(s * 1000) AS window_start, template, n, silent AS silent_seconds FROM (
          SELECT *, s - lag(s) OVER (PARTITION BY template ORDER BY s) - 10 AS silent, min(s) OVER () AS begun FROM (
            SELECT (ts - ts % 10000) // 1000 AS s, template, count(*) AS n FROM lines JOIN found USING (text) GROUP BY ALL))
        WHERE s - begun >= 60 AND (silent IS NULL OR silent >= 60)"""
    ),
    "machine_status": sql(f"SELECT {_STATUS_ROW} FROM statuses", "statuses"),
    "change_record_status": sql(
        "SELECT machine_id, arg_max(status, (start_time, seq)) AS status FROM changes GROUP BY 1", "changes"),
    "health_latest": sql(
        f"""SELECT {_STATUS_ROW} FROM statuses
        QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY update_time DESC, seq DESC) = 1""",
        "statuses"),
    "latest_status_sample": sql(
        f"""SELECT * FROM (SELECT {_STATUS_ROW} FROM statuses
        QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY update_time DESC, seq DESC) = 1)
        ORDER BY update_time DESC, machine_id LIMIT 20""", "statuses"),
    "health_throttled": _throttled("statuses"),
    "window_metrics_1m": sql(f"SELECT {_WINDOW} FROM w1m", "w1m"),
    "window_trend_1m": sql(
        f"""SELECT epoch_ms(ts - ts % 60000) AS window_start, epoch_ms(ts - ts % 60000 + 60000) AS window_end,
          machine_id, round(regr_slope(temperature, (ts % 60000) / 1000.0::DOUBLE), {DIGITS}) AS temp_trend
        FROM sensor GROUP BY ts - ts % 60000, machine_id""", "sensor"),
    "window_metrics_5m": sql(f"SELECT {_WINDOW} FROM w5m", "w5m"),
    "window_metrics_1h": sql(f"SELECT {_WINDOW} FROM w1h", "w1h"),
    "window_metrics_all": sql(
        f"SELECT {_WINDOW} FROM w1m UNION ALL SELECT {_WINDOW} FROM w5m UNION ALL SELECT {_WINDOW} FROM w1h",
        "w1m", "w5m", "w1h"),
    "window_rollup": sql(
        f"SELECT {_WINDOW} FROM w1m UNION ALL SELECT {_WINDOW} FROM w5m UNION ALL SELECT {_WINDOW} FROM w1h",
        "w1m", "w5m", "w1h"),
    "simple_window": sql(
        f"""SELECT epoch_ms(ts - ts % 60000) AS window_start, epoch_ms(ts - ts % 60000 + 60000) AS window_end,
          machine_id, round(max(temperature), {DIGITS}) AS max_temperature,
          round(avg(vibration_x), {DIGITS}) AS avg_vib_rms FROM sensor
        GROUP BY ts - ts % 60000, machine_id""", "sensor"),
    "window_stability": sql(
        f"""SELECT {rounded('temp_slope current_fluctuation', 'machine_id window_start window_end')},
          CASE WHEN max_temperature <= 79 AND current_fluctuation <= 2 THEN 'STABLE' ELSE 'WARNING' END
            AS status FROM w1m""", "w1m"),
    "gap_fill_hold": sql(_HELD, "w3s_gaps"),
    "vibration_spike": sql(f"SELECT {_ALERT} FROM spikes", "spikes"),
    "interpolate": sql(_interpolated(), "sensor"),
    "latest_windows": sql(
        f"SELECT {_WINDOW} FROM w1m ORDER BY window_end DESC, machine_id LIMIT 10", "w1m"),
    "late_filter": sql(
        """SELECT seq, machine_id, event_ms, epoch_ms(event_ms) AS event_time FROM (
          SELECT *, max(event_ms) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
          FROM arrivals) WHERE seen IS NULL OR event_ms >= seen - 30000""", "arrivals"),
    "process_deviation": sql(
        f"""SELECT {rounded('current std_current current_dev speed std_speed speed_dev',
            'seq machine_id timestamp')} FROM deviations WHERE current_dev > 0.028 OR speed_dev > 0.028""",
        "deviations"),
    "deviation_sliding": sql(_SLIDING, "deviations", "sliding_slots"),
    "deviation_by_param": sql(
        f"""SELECT {_DEVIATION_ROW} FROM (
          SELECT epoch_ms(ts - ts % 10000 - back) AS record_time, machine_id, param_name,
            max(actual) AS actual_value, max(std) AS standard_value, max(dev) * 100 AS deviation_ratio,
            30::INT AS duration_seconds
          FROM (SELECT ts, machine_id, 'current' AS param_name, "current" AS actual, std_current AS std,
                  current_dev AS dev FROM deviations
                UNION ALL SELECT ts, machine_id, 'speed', speed, std_speed, speed_dev FROM deviations),
            sliding_slots WHERE dev > 0.028
          GROUP BY ts - ts % 10000 - back, machine_id, param_name)""", "deviations", "sliding_slots"),
    "deviation_episodes": _episodes(0.10, 30),
    "deviation_episodes_short": _episodes(0.028, 8),
    "stream_episodes": _episodes(0.10, 20, until="ts - ts % 10000 + 10000 <= (SELECT epoch_ms(w) FROM watermark)", ended=True),
    "deviation_sustained": sql(f"SELECT {_DEVIATION_ROW} FROM sustained", "sustained"),
    "deviation_top5": sql(
        f"""SELECT {_DEVIATION_ROW} FROM (SELECT * FROM sustained
        ORDER BY deviation_ratio DESC, record_time, machine_id LIMIT 5)""", "sustained"),
    "highfreq_features": sql(f"SELECT {_FEATURES} FROM features", "features"),
    "lowfreq_pairs": sql(f'SELECT {_PAIR}, "isAlarm" FROM pairs', "pairs"),
    "alarm_translate": sql(
        f"""SELECT seq, "machineId", "isAlarm", CASE WHEN "isAlarm" = '' THEN '' ELSE
          COALESCE(message, '{UNKNOWN_ALARM_PREFIX}' || "isAlarm") END AS "alarmMessage"
        FROM all_state LEFT JOIN dictionary ON code = "isAlarm" """, "all_state", "dictionary"),
    "features_22": sql(f"SELECT {_RECORD} FROM records", "records"),
    "feature_json": sql(
        f"""SELECT {_RECORD_FIELDS}, 22::INT AS n_fields FROM records""", "records"),
    "trailing10": sql(
        f"""SELECT seq, "machineId", {_mean_of_ten('spindle_load', 'avg_spindle_load_10')},
          {_mean_of_ten('cutting_time', 'avg_cutting_time_10')} FROM all_metrics""", "all_metrics"),
    "running_totals": sql(
        f"""SELECT seq, "machineId",
          CAST(sum(CASE WHEN "isAlarm" <> '' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS alarms_so_far,
          round(sum(duration_seconds) OVER w, {DIGITS}) AS runtime_so_far,
          CAST(sum(is_running) OVER w AS BIGINT) AS running_so_far
        FROM all_state WINDOW w AS (PARTITION BY "machineId" ORDER BY ts, seq)""", "all_state"),
    "latest_by_key": sql(
        """SELECT * FROM logs
        QUALIFY row_number() OVER (PARTITION BY machine_id, error_code ORDER BY ts DESC, seq DESC) = 1""",
        "logs"),
    "offline_realtime_merge": sql(
        f"""SELECT {rounded('temperature speed', 'source machine_id ts')} FROM (
          SELECT 'realtime' AS source, machine_id, ts, temperature, speed FROM (
            {_select(fx.SENSOR_RAW, 'base', where=fx.REALTIME_FILTER)})
          UNION ALL
          SELECT 'offline', o.machine_id, o.ts, 0.0::DOUBLE, o.speed FROM (
            {_select(fx.SENSOR_RAW, 'base', where=fx.OFFLINE_FILTER)}) o
          WHERE NOT EXISTS (SELECT 1 FROM (
            {_select(fx.SENSOR_RAW, 'base', where=fx.REALTIME_FILTER)}) r
            WHERE r.machine_id = o.machine_id AND r.ts = o.ts))""", "base"),
    "clean_change_data": sql(
        f"SELECT record_id, machine_id, epoch_ms(record_time) AS record_time, {_CLEAN_NUMBERS}, true AS is_readable "
        "FROM cells", "cells"),
    "xml_quarantine": sql(
        f"""SELECT record_id, machine_id, CASE WHEN record_id % {fx.MALFORMED_EVERY} = 0 THEN 40 END::INT AS n_chars
        FROM cells WHERE record_id % {fx.MALFORMED_EVERY} < 2""", "cells"),
    "clean_outputs": _clean_outputs(),
    "rul_label": sql(
        f"""SELECT f."machineId", window_start,
          round((epoch_ms(min(l."timestamp")) - epoch_ms(window_end)) / 3.6e6, {DIGITS}) AS rul_hours
        FROM features f JOIN logs l ON CAST(l.machine_id AS INT) = f."machineId"
          AND l.error_code = '999' AND l."timestamp" >= f.window_end
        GROUP BY f."machineId", window_start, window_end""", "features", "logs"),
    "rul_linear": sql(
        f"""SELECT "machineId", window_start, {rounded('rul_value failure_probability')} FROM scored""", "scored"),
    "risk_level": sql(
        f"""SELECT "machineId", window_start, round(rul_value, {DIGITS}) AS rul_value,
          CASE WHEN rul_value < 48 THEN 'High' WHEN rul_value < 168 THEN 'Medium' ELSE 'Low' END
            AS risk_level FROM scored""", "scored"),
    "rul_alerts": sql(
        f"""SELECT {_ALERT} FROM (SELECT window_end AS alert_time, CAST("machineId" AS VARCHAR) AS machine_id,
          'RUL预警' AS alert_type, rul_value AS trigger_value, 130.0::DOUBLE AS threshold_value,
          '请立即检查设备' AS suggested_action FROM scored
        WHERE rul_value < 130 OR failure_probability > 0.6)""", "scored"),
    "stable_windows": sql("SELECT * FROM stable", "stable"),
    "rul_lives": sql(f'SELECT "machineId", window_start, round(life_hours, {DIGITS}) AS life_hours, failed FROM lives', "lives"),
    "rul_survival": sql(
        f"""SELECT grp, after_hours, at_risk, failures, censored, round(CASE WHEN max(failures = at_risk) OVER u THEN 0.0
          ELSE exp(sum(CASE WHEN failures < at_risk THEN ln(1 - failures / at_risk) END) OVER u) END, {DIGITS}) AS survival FROM (
          SELECT *, (sum(failures + censored) OVER (PARTITION BY grp ORDER BY after_hours DESC))::BIGINT AS at_risk FROM life_steps)
        WINDOW u AS (PARTITION BY grp ORDER BY after_hours)""", "life_steps"),
    "failure_reliability": sql(
        f"""SELECT bin, n, failures, round(mean_score, {DIGITS}) AS mean_score, round(failures / n, {DIGITS}) AS observed_rate,
          round(calibrated, {DIGITS}) AS calibrated FROM score_bins JOIN calibration USING (bin)""", "score_bins", "calibration"),
    "rul_alerts_calibrated": sql(
        f"""SELECT {_ALERT} FROM (SELECT window_end AS alert_time, CAST("machineId" AS VARCHAR) AS machine_id,
          'RUL预警' AS alert_type, rul_value AS trigger_value, 48.0::DOUBLE AS threshold_value, '请立即检查设备' AS suggested_action,
          coalesce((SELECT arg_max(calibrated, bin) FROM calibration c WHERE c.bin <= least(floor(failure_probability * {BINS}), {BINS} - 1)),
            (SELECT arg_min(calibrated, bin) FROM calibration)) AS calibrated FROM far_scored)
        WHERE trigger_value < 48 OR calibrated > 0.85""", "far_scored", "calibration"),
    # --- streams ---
    "stream_windows": sql(
        f"SELECT {_WINDOW} FROM w1m WHERE window_end <= (SELECT w FROM watermark)", "w1m", "watermark"),
    "stream_rollup": sql(
        f"""SELECT {_WINDOW} FROM w1m WHERE window_end <= (SELECT w FROM watermark) UNION ALL
        SELECT {_WINDOW} FROM w5m WHERE window_end <= (SELECT w FROM watermark) UNION ALL
        SELECT {_WINDOW} FROM w1h WHERE window_end <= (SELECT w FROM watermark)""", "w1m", "w5m", "w1h", "watermark"),
    "stream_deviation": sql(
        f"""SELECT * FROM ({_SLIDING})
        WHERE record_time + INTERVAL 30 SECOND <= (SELECT w FROM watermark)""",
        "deviations", "sliding_slots", "watermark"),
    "stream_sustained": sql(
        f"""SELECT {_DEVIATION_ROW} FROM sustained
        WHERE record_time + INTERVAL 30 SECOND <= (SELECT w FROM watermark)""", "sustained", "watermark"),
    "stream_interpolate": sql(_interpolated("epoch_ms(ts) <= (SELECT w FROM watermark)"), "sensor", "watermark"),
    "late_rows": sql(
        """SELECT seq, machine_id, epoch_ms(event_ms) AS event_time,
          CASE WHEN event_ms < (SELECT max(newest) FROM quarter_ends q WHERE q.part < p.part) - 30000 THEN 'late' ELSE 'on_time' END AS routed_to
        FROM quarters p""", "quarters", "quarter_ends"),
    "stream_error_surge": sql(
        f"""SELECT window_start, error_code, n, round(baseline, {DIGITS}) AS baseline FROM (
          SELECT s, window_start, error_code, n, (SELECT COALESCE(sum(p.n), 0) FROM surge_counts p
              WHERE p.error_code = c.error_code AND p.s BETWEEN c.s - 50 AND c.s - 10)
            / NULLIF(least(5, (c.s - (SELECT min(s) FROM surge_counts)) // 10), 0) AS baseline
          FROM surge_counts c) WHERE n >= 1.5 * baseline AND (baseline > 0 OR n >= 3)
          AND s + 10 <= (SELECT epoch_ms(w) / 1000 FROM watermark)""", "surge_counts", "watermark"),
    "stream_late": sql(
        """SELECT epoch_ms(event_ms - event_ms % 60000) AS window_start, machine_id, count(*) AS n FROM arrivals
        WHERE event_ms - event_ms % 60000 + 60000 <= (SELECT max(event_ms) - 30000 FROM arrivals)
        GROUP BY 1, 2""", "arrivals"),
    "stream_spike": sql(
        f"SELECT {_ALERT} FROM spikes WHERE alert_time <= (SELECT w FROM watermark)", "spikes", "watermark"),
    "stream_gap_fill": sql(
        f"""SELECT * EXCLUDE (filled) FROM ({_HELD}) WHERE window_end <= (SELECT w FROM watermark)""",
        "w3s_gaps", "watermark"),
    "stream_features": sql(
        f"SELECT {_FEATURES} FROM features WHERE window_end <= (SELECT w FROM watermark)",
        "features", "watermark"),
    "stream_pairs": sql(
        f"""SELECT {_PAIR}, "isAlarm" FROM pairs
        WHERE epoch_ms(ts) <= (SELECT w FROM lowfreq_watermark)""", "pairs", "lowfreq_watermark"),
    "stream_pairs_split": sql(
        f"""SELECT {_PAIR}, "isAlarm" FROM pairs
        WHERE epoch_ms(ts - ts % 10000 + 10000) <= (SELECT w FROM lowfreq_watermark)""", "pairs", "lowfreq_watermark"),
    "stream_feature_records": sql(
        f"""SELECT {_RECORD} FROM records JOIN (SELECT seq, ts FROM pairs) USING (seq)
        WHERE epoch_ms(ts) <= (SELECT w FROM watermark)""", "records", "watermark"),
    "stream_status": sql(
        f"SELECT {_STATUS_ROW} FROM statuses WHERE update_time <= (SELECT w FROM status_watermark)",
        "statuses", "status_watermark"),
    "stream_health": _throttled("statuses", "update_time <= (SELECT w FROM status_watermark)"),
    "stream_alerts": sql(
        f"SELECT {_ALERT} FROM sensor_alerts UNION ALL SELECT {_ALERT} FROM log_alerts",
        "sensor_alerts", "log_alerts"),
    "lake_sensor_upsert": sql(
        f"""SELECT {rounded('temperature vibration_x vibration_y vibration_z current noise speed',
            'machine_id ts')} FROM sensor
        QUALIFY row_number() OVER (PARTITION BY machine_id, ts ORDER BY seq DESC) = 1""", "sensor"),
    "lake_log_upsert": sql(
        """SELECT machine_id, ts, error_code, error_msg, stack_trace,
          CASE error_code WHEN '999' THEN 'Critical' WHEN '500' THEN 'High' ELSE 'Normal' END AS severity
        FROM logs QUALIFY row_number() OVER (PARTITION BY machine_id, ts ORDER BY seq DESC) = 1""", "logs"),
    "raw_landing": _landed(),
}
