"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.session import configure, shared_path

#: Rows an Arrow batch holds; with whole documents in the rows this bounds a Python worker's memory.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, as rows here carry whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return configure(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_worker(name: tuple, make: Callable):
    """What ``make()`` gives, once in each Python process.

    Functions travel to workers by value, and with each task anew, so a module's own variables do not last there.
    """
    store = sys.__dict__.setdefault("_spindlewatch_worker", {})
    if name not in store:
        store[name] = make()
    return store[name]


def fresh(prefix: str) -> str:
    """A column name no input has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``limit`` characters together, or a single longer text."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def hash_share(column: str, parts: int):
    """A stable bucket number of a key: 0 .. parts - 1."""
    return F.pmod(F.xxhash64(column), F.lit(parts))


def sorted_groups(frames, key: str):
    """Runs of rows with equal ``key`` from pandas frames sorted by it, as lists of whole groups in one frame.

    Yields (frame, starts): group i is rows starts[i] : starts[i + 1]. A group may reach over several frames, so what
    is held at once is one input frame and one group.
    """
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] != keys[-1] else 0
        if last == 0 and (not kept or kept[-1][key].iloc[-1] == keys[0]):
            kept.append(frame)
            continue
        whole = pd.concat([*kept, frame.iloc[:last]], ignore_index=True) if last else pd.concat(kept, ignore_index=True)
        kept = [frame.iloc[last:]]
        yield whole, _starts(whole[key].to_numpy())
    if kept:
        whole = pd.concat(kept, ignore_index=True)
        yield whole, _starts(whole[key].to_numpy())


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
