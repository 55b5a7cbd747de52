"""Keyed state for streams: what a batch window function does, one machine at a time.

Rows of a key reach a processor in no particular order. ``VectorReplay`` therefore holds rows back
until the watermark has passed them and replays them by (time, rank), so that results equal
those of the batch operators. State lives in the state store, so it survives lost executors.
Rows go in and come out as bounded frames: the row-wise form of ``transformWithState`` would gather all that a
key puts out at once in a list.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIME_MS = "_t_ms"
# rows, and characters of their texts, of one key held in memory before they are put into the store
HELD_ROWS = 100_000
HELD_TEXT = 1 << 25
# rows per state entry: few of a held block, so that entries of blocks without order overlap little in time
VECTOR_CHUNK = 500
# rows, and stored bytes, folded at once
FOLD_ROWS = 20_000
FOLD_BYTES = 1 << 24
_ROWS = T.StructType([T.StructField("rows", T.BinaryType())])


#: Columns of the rows a ``VectorReplay`` takes beside the keys (names that begin with an underscore would be lost on the way).
US, RANK, SIDE, PAYLOAD = "time_us", "time_rank", "record_side", "record"
_CHUNK_KEY = T.StructType([T.StructField("first_us", T.LongType()), T.StructField("part", T.IntegerType())])


def _text_size(columns: tuple) -> int:
    return sum(len(x) for c in columns if c.dtype == object for x in c if x is not None)


class VectorReplay(StatefulProcessor):
    """Buffer, sort and fold, on whole columns; operators mostly move records about without looking into them.

    A row is a time in microseconds, a rank among equal times, a side and a text that holds the record (``packed``), which is never parsed
    here, and the columns named by ``more``. Rows wait in the state store in chunks sorted by time; replay merges those that overlap and hands
    arrays to ``fold(memory, us, side, payload, *more) -> (memory, output columns or None)``, ``memory`` being any small object.
    """

    more: tuple[str, ...] = ()

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", _CHUNK_KEY, _ROWS)
        self.memory = handle.getValueState("memory", _ROWS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, count, text = [], 0, 0
        for frame in rows:
            held.append(tuple(frame[c].to_numpy() for c in (US, RANK, SIDE, PAYLOAD, *self.more)))
            count += len(frame)
            text += _text_size(held[-1])
            if count >= HELD_ROWS or text >= HELD_TEXT:
                self._store(held)
                held, count, text = [], 0, 0
        self._store(held)
        yield from self._replay(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._replay(key, timerValues.getCurrentWatermarkInMs() * 1000)

    @staticmethod
    def _merged(parts: list[tuple]) -> tuple:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        by = np.lexsort((columns[1], columns[0]))
        return tuple(c[by] for c in columns)

    def _store(self, parts: list[tuple]) -> None:
        if not parts:
            return
        columns = self._merged(parts)
        for begin in range(0, len(columns[0]), VECTOR_CHUNK):
            chunk = tuple(c[begin : begin + VECTOR_CHUNK] for c in columns)
            place = (int(chunk[0][0]), 0)
            while self.chunks.containsKey(place):
                place = (place[0], place[1] + 1)
            self.chunks.updateValue(place, (pickle.dumps(chunk),))

    def _replay(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        places = sorted((k[0], k[1]) for k in self.chunks.keys())
        due = [k for k in places if k[0] <= watermark]
        memory = pickle.loads(bytes(self.memory.get()[0])) if self.memory.exists() else None
        before, pool, size = memory, [], 0
        for i, place in enumerate(due):
            stored = bytes(self.chunks.getValue(place)[0])
            pool.append(pickle.loads(stored))
            self.chunks.removeKey(place)
            size += len(stored)
            last = i + 1 == len(due)
            if not last and size < FOLD_BYTES and sum(len(c[0]) for c in pool) < FOLD_ROWS:
                continue
            rows = self._merged(pool)
            bound = watermark if last else due[i + 1][0] - 1
            cut = int(np.searchsorted(rows[0], bound, side="right"))
            pool, size = [tuple(c[cut:] for c in rows)] if cut < len(rows[0]) else [], 0
            if cut:
                us, _, *columns = (c[:cut] for c in rows)
                memory, out = self.fold(memory, us, *columns)
                if out is not None and len(out[next(iter(out))]):
                    names = dict(zip(self.keys, key, strict=True))
                    yield pd.DataFrame(out).assign(**names)
        later = [k[0] for k in places[len(due) :][:1]]
        if pool:
            self._store(pool)
            later.append(int(pool[0][0][0]))
        if later:
            self.handle.registerTimer(-(-min(later) // 1000))
        if memory is None:
            if before is not None:
                self.memory.clear()
        elif memory != before:
            self.memory.update((pickle.dumps(memory),))

    def fold(self, memory, us: np.ndarray, side: np.ndarray, payload: np.ndarray, *more: np.ndarray):
        raise NotImplementedError

    def close(self) -> None:
        pass


def _times(us: np.ndarray) -> np.ndarray:
    return us.astype("datetime64[us]")


class OrderedReplay(VectorReplay):
    """``VectorReplay`` row by row. Subclasses give ``step(memory, row) -> (memory, output rows)``, rows being dictionaries;
    ``memory`` is None at the start of a key. For rows that Spark has aggregated before."""

    def __init__(self, row_schema: T.StructType, order: str):
        super().__init__([])
        self.order, self.names = order, row_schema.fieldNames()
        # numbers that are not finite are texts in JSON
        self.doubles = [f.name for f in row_schema if isinstance(f.dataType, T.DoubleType)]
        self.lists = [f.name for f in row_schema if f.dataType == T.ArrayType(T.DoubleType())]

    def _row(self, text: str) -> dict:
        row = dict.fromkeys(self.names) | json.loads(text)
        for c in self.doubles:
            if row[c] is not None:
                row[c] = float(row[c])
        for c in self.lists:
            if row[c] is not None:
                row[c] = [None if x is None else float(x) for x in row[c]]
        return row

    def fold(self, memory, us, side, payload):
        found = []
        for text in payload:
            memory, out = self.step(memory, self._row(text))
            found += out
        return memory, {"left": [json.dumps(x) for x in found]}

    def step(self, memory, row: dict):
        raise NotImplementedError

    def emit(self, values: dict) -> list[dict]:
        return [{n: values[n] for n in self.output}]


class HoldAndSpike(VectorReplay):
    """Gap fill over consecutive windows: with each window's record comes the one whose values it holds (its own, unless it fills a gap), and
    that one of the window before. Memory is the end of the last window and the record it holds."""

    def __init__(self, keys: list[str], min_gap: int, max_gap: int):
        super().__init__(keys)
        self.min_gap, self.max_gap = min_gap, max_gap

    def fold(self, memory, us, side, payload):
        if memory:
            us, payload = np.append(memory[0], us), np.append(np.array([memory[1]], object), payload)
        gap = np.diff(us) // 1_000_000
        fills = np.append(False, (gap > self.min_gap) & (gap <= self.max_gap))
        held = payload[np.maximum.accumulate(np.where(fills, 0, np.arange(len(us))))]
        first = 1 if memory else 0
        before = np.append(np.array([None], object), held[:-1])
        return (int(us[-1]), held[-1]), {
            TIME: _times(us[first:]), "left": payload[first:], "right": held[first:], "before": before[first:],
        }


class Interpolate(VectorReplay):
    """Linear interpolation over short gaps; memory is the reading before, its time in microseconds first."""

    def __init__(self, keys: list[str], columns: list[str], step_us: int, max_gap_us: int):
        super().__init__(keys)
        self.columns, self.more = columns, ("at_us", *columns)
        self.step_us, self.max_gap_us = step_us, max_gap_us

    def fold(self, memory, us, side, payload, at, *values):
        if memory:
            at, *values = (np.append(np.array([a], b.dtype), b) for a, b in zip(memory, (at, *values), strict=True))
        gap = np.diff(at)
        points = np.where((gap > self.step_us) & (gap <= self.max_gap_us), (gap - 1) // self.step_us, 0)
        of = np.repeat(np.arange(len(gap)), points)
        ahead = (np.arange(len(of)) - np.repeat(np.cumsum(points) - points, points) + 1) * self.step_us
        share = ahead / gap[of]
        out = {c: v[of] + (v[of + 1] - v[of]) * share for c, v in zip(self.columns, values, strict=True)}
        return tuple(v[-1].item() for v in (at, *values)), {"us": at[of] + ahead, **out}


class LatestPairing(VectorReplay):
    """Consume-once pairing of two sides; memory is the one record left waiting (side, payload)."""

    def fold(self, memory, us, side, payload):
        first, second = [], []
        held = -1 if memory else None
        held_side = memory[0] if memory else None
        for i, s in enumerate(side.tolist()):
            if held is None or held_side == s:
                held, held_side = i, s
            else:
                first.append(held)
                second.append(i)
                held = None
        waiting = None if held is None else memory if held < 0 else (held_side, payload[held])
        second = np.array(second, np.int64)
        firsts = np.empty(len(first), object)
        firsts[:] = [memory[1] if i < 0 else payload[i] for i in first]
        seconds = payload[second]
        swap = side[second] == 0
        return waiting, {
            TIME: _times(us[second]), "left": np.where(swap, seconds, firsts), "right": np.where(swap, firsts, seconds),
            "last": np.where(swap, "0", "1").astype(object),
        }


class LatestValue(VectorReplay):
    """As-of lookup: side 1 comes out with the newest payload of side 0, which is the memory."""

    def fold(self, memory, us, side, payload):
        at = np.maximum.accumulate(np.where(side == 0, np.arange(len(side)), -1))
        left = side == 1
        mine = at[left]
        found = np.where(mine >= 0, payload[mine], memory)
        return payload[at[-1]] if at[-1] >= 0 else memory, {TIME: _times(us[left]), "left": payload[left], "right": found}


class Throttle(VectorReplay):
    """Greedy throttle by whole seconds; memory is the second of the last row let through."""

    def __init__(self, keys: list[str], interval: int):
        super().__init__(keys)
        self.interval = interval

    def fold(self, memory, us, side, payload):
        seconds = us // 1_000_000
        passed = []
        i = 0 if memory is None else int(np.searchsorted(seconds, memory + self.interval))
        while i < len(seconds):
            passed.append(i)
            memory = int(seconds[i])
            i = max(i + 1, int(np.searchsorted(seconds, memory + self.interval)))
        at = np.array(passed, np.int64)
        return memory, {TIME: _times(us[at]), "left": payload[at]}


#: The time column of what a ``VectorReplay`` gives out.
TIME = "event_at"


def packed(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one text, times in microseconds."""
    kinds = {f.name: f.dataType for f in df.schema}
    timed = [c for c in columns if isinstance(kinds[c], T.TimestampType)]
    return F.to_json(F.struct(F.lit(0).alias("_"), *[F.unix_micros(c).alias(c) if c in timed else F.col(c) for c in columns]))


def unpacked(text: str, schema: T.StructType) -> list[Column]:
    """The columns of a packed text, null where there is none."""
    kinds = T.StructType([
        T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema
    ])
    read = F.from_json(text, kinds)
    return [
        (F.timestamp_micros(read[f.name]) if isinstance(f.dataType, T.TimestampType) else read[f.name]).alias(f.name) for f in schema
    ]


def run_vector(
    rows: DataFrame, keys: list[str], processor: VectorReplay, texts: list[str] | T.StructType,
) -> DataFrame:
    """Keys, ``TIME`` and the texts a processor gives out; ``rows`` carry ``TIME``, the watermarked time, too.

    With fields in place of texts, keys and those fields, which carry no event time for operators above.
    """
    # a row without time is never passed by the watermark
    columns = [*keys, TIME, US, RANK, SIDE, PAYLOAD, *processor.more]
    timed = not isinstance(texts, T.StructType)
    fields = [T.StructField(TIME, T.TimestampType())] + [T.StructField(t, T.StringType()) for t in texts] if timed else list(texts)
    output = T.StructType([rows.schema[k] for k in keys] + fields)
    return rows.select(*columns).filter(F.col(TIME).isNotNull()).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode="eventTime",
        eventTimeColumnName=TIME if timed else "",
    )


def run_rows(rows: DataFrame, time_column: str, keys: list[str], processor: OrderedReplay, output: T.StructType) -> DataFrame:
    """What an ``OrderedReplay`` gives out for ``rows`` with ``TIME_MS``, watermarked on ``time_column``."""
    processor.keys = keys
    kept = [c for c in rows.columns if c not in (time_column, TIME_MS)]
    taken = rows.select(
        *keys, F.col(time_column).alias(TIME), (F.col(TIME_MS) * 1000).alias(US), F.col(processor.order).cast("bigint").alias(RANK),
        F.lit(0).cast("tinyint").alias(SIDE), packed(rows, kept).alias(PAYLOAD),
    )
    found = run_vector(taken, keys, processor, T.StructType([T.StructField("left", T.StringType())]))
    return found.select(*unpacked("left", output))
