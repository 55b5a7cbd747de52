"""Cleaning of XML change records into 14 features and four extension fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.functions import columns as fn

# Cell names in the XML and status words.
RUNNING_WORDS = ["运行", "运行中", "自动运行", "AUTO"]
STANDBY_WORDS = ["待机", "暂停", "RESET", "MDI"]
CONNECTION_NORMAL = "normal"
CELL_DEVICE_IP = "设备IP"
CELL_MACHINE_STATUS = "机器状态"
CELL_CONNECTION = "连接状态"
CELL_ALARM = "报警信息"
NUMERIC_CELLS = {
    "durationSeconds": "运行时间",
    "cuttingTime": "切削时间",
    "cycleTime": "循环时间",
    "spindleLoad": "主轴负载",
    "totalParts": "总加工个数",
    "cumRuntime": "上电时间",
    "cumParts": "加工个数",
    "avgSpindleLoad": "主轴负载",
    "spindleSpeed": "主轴转速",
    "feedSpeed": "进给速度",
}

FLAG_FIELDS = ["isRunning", "isStandby", "isOffline", "isAlarm"]
EXTENSION_FIELDS = ["device_ip", "machine_status", "alarm_code", "alarm_message"]
FEATURE_FIELDS = [*FLAG_FIELDS, *NUMERIC_CELLS]
CLEAN_FIELDS = [*FEATURE_FIELDS, *EXTENSION_FIELDS]

_BROKEN = "_corrupt_record"
_CELLS = f"col array<struct<_ColName: string, _VALUE: string>>, {_BROKEN} string"
# a cell in its plain form: one attribute, text without markup or entities
_PLAIN_CELL = '<col ColName="([^"<&]*)">([^<&]*)</col>'


def _once(c: Column) -> Column:
    """Value computed in its own step: exploding a one-element array keeps the optimizer from
    repeating an expensive expression at every use."""
    return F.explode(F.array(c))


def parse_cells(records: DataFrame, column: str = "ChangeData") -> DataFrame:
    """Add ``cells``: the names ``n`` and texts ``v`` of the XML fragment's cells, in order; null for
    a null or broken fragment.

    Fragments made of plain cells only are read by pattern, which gives the same cells as the XML
    parser at a fraction of its cost; all others go through ``from_xml``. A fragment is plain if
    every "<" in it belongs to a cell the pattern has found.
    """
    text = F.col(column)
    found = records.select(
        "*", _once(F.regexp_extract_all(text, F.lit(_PLAIN_CELL), F.lit(1))).alias("_names")
    )
    marks = F.length(text) - F.length(F.replace(text, F.lit("<"), F.lit("")))
    plain = F.size("_names") * 2 == marks
    document = F.concat(F.lit("<r>"), text, F.lit("</r>"))
    xml = F.from_xml(document, _CELLS, {"columnNameOfCorruptRecord": _BROKEN})
    parsed = found.select("*", _once(F.when(~plain, xml)).alias("_xml"))
    whole = plain | (F.col("_xml").isNotNull() & F.col(f"_xml.{_BROKEN}").isNull())
    names = F.coalesce(F.col("_xml.col._ColName"), F.col("_names"))
    values = F.coalesce(
        F.col("_xml.col._VALUE"), F.regexp_extract_all(text, F.lit(_PLAIN_CELL), F.lit(2))
    )
    return parsed.select(
        *records.columns,
        _once(F.when(whole, F.struct(names.alias("n"), values.alias("v")))).alias(
            "cells"
        ),
    )


def cell_map(cells: Column | str = "cells") -> Column:
    """``cells`` as a map; a repeated name keeps its first value, a null name is left out."""
    cells = fn.col(cells)
    names, values = cells["n"], cells["v"]
    distinct = F.array_distinct(F.array_compact(names))
    first = F.transform(
        distinct, lambda n: F.get(values, (F.array_position(names, n) - 1).cast("int"))
    )
    return F.map_from_arrays(distinct, first)


def _cell(name: str) -> Column:
    """Text of the first cell of that name."""
    position = F.array_position(F.col("cells.n"), name).cast("int")
    return F.trim(F.get(F.col("cells.v"), position - 1))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def quarantine_change_data(records: DataFrame, column: str = "ChangeData") -> DataFrame:
    """The records that are not readable, unchanged: no fragment, or one that is not XML."""
    return parse_cells(records, column).filter("cells IS NULL").drop("cells")


def clean_change_data(records: DataFrame, column: str = "ChangeData") -> DataFrame:
    """One row of ``CLEAN_FIELDS`` per record, and ``is_readable``; the other columns pass through.

    A missing or broken fragment gives zeros and empty texts and is not readable; ``quarantine_change_data``
    has those records.
    """
    keep = [c for c in records.columns if c != column]
    status = _cell(CELL_MACHINE_STATUS)
    alarm = _cell(CELL_ALARM)
    number = F.get_json_object(alarm, "$.AlmNo")
    cells = parse_cells(records, column).select(*keep, "cells", _once(number).alias("_number"))
    number = F.col("_number")
    return cells.select(
        *keep,
        _flag(status.isin(RUNNING_WORDS)).alias("isRunning"),
        _flag(status.isin(STANDBY_WORDS)).alias("isStandby"),
        # an absent connection cell is not "normal" either, but a broken fragment says nothing of it
        _flag(
            F.col("cells").isNotNull() & ~F.coalesce(_cell(CELL_CONNECTION) == CONNECTION_NORMAL, F.lit(False))
        ).alias("isOffline"),
        _flag(F.coalesce(number.try_cast("double"), F.lit(0.0)) > 0).alias("isAlarm"),
        *[fn.clean_number(_cell(cell)).alias(name) for name, cell in NUMERIC_CELLS.items()],
        F.coalesce(_cell(CELL_DEVICE_IP), F.lit("")).alias("device_ip"),
        F.coalesce(status, F.lit("")).alias("machine_status"),
        F.coalesce(number, F.lit("")).alias("alarm_code"),
        F.coalesce(F.get_json_object(alarm, "$.AlmMsg"), F.lit("")).alias("alarm_message"),
        F.col("cells").isNotNull().alias("is_readable"),
    )


# the four targets by name: format and columns (22, 12, 11 and 22 of them)
OUTPUTS = {
    "cleaned_full_csv": (
        "csv", ["record_id", "machine_id", "record_time", "clean_time", *CLEAN_FIELDS],
    ),
    "device_metrics_csv": (
        "csv", ["machine_id", "record_time", *NUMERIC_CELLS],
    ),
    "device_state_csv": (
        "csv",
        ["record_id", "machine_id", "record_time", *FLAG_FIELDS, *EXTENSION_FIELDS],
    ),
    "json_backup": (
        "json", ["record_id", "machine_id", "record_time", "clean_time", *CLEAN_FIELDS],
    ),
}


def write_outputs(cleaned: DataFrame, base_path: str, mode: str = "overwrite") -> dict[str, str]:
    """Write the wide CSV, metrics CSV, state CSV and JSON backup; returns their paths.

    The cleaned rows are written once as parquet and the targets read that, so the XML is parsed
    one time only and a lost executor costs a re-read, not a re-parse. Rows that lack a column of any
    target are an error: no target is ever written narrower than declared.
    """
    wanted = {c for _, columns in OUTPUTS.values() for c in columns}
    if missing := sorted(wanted - set(cleaned.columns)):
        raise ValueError(f"columns missing from the cleaned rows: {missing}")
    staged = f"{base_path}/cleaned_parquet"
    cleaned.write.mode(mode).parquet(staged)
    rows = cleaned.sparkSession.read.parquet(staged)
    paths = {}
    for name, (fmt, columns) in OUTPUTS.items():
        paths[name] = f"{base_path}/{name}"
        writer = rows.select(*columns).write.mode(mode)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(paths[name])
    return paths
