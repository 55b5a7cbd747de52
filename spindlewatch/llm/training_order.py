"""Training-order materialisation: token sequences in a keyed pseudo-random order, as fixed-stride binary shards.

Method: a text of n bytes has at most n ids, which bounds how many sequences it makes. The running sum of these bounds
gives every sequence a number of its own before anything is encoded. A keyed Feistel network over the next power of
four, with cycle-walking, permutes the numbers: that is the sequence's global slot. One pass encodes and sends each record to the
partition of its slot range, where shards are written in slot order. So texts are encoded once, nothing but the
records is shuffled, once, and no order is ever collected. As the bound is rarely met, slots have gaps;
a sequence's position is the number of sequences in slots before its own, without gaps.

A record has a fixed size: key (int64, least value for null), number within its document (int32), ids held (int32), and
``length`` ids of 2 or 4 bytes, the last ones padding, then a line feed. Shard k holds the records of slots
k * shard_slots and up, in folder ``shard=<k>``; ``index`` has each shard's records and its first position; the record at
a position lies (position - first) * stride bytes into its shard. ``manifest`` says everything else a reader needs.

Defined results: a null text counts as empty and has one sequence, holding just the end id; repeated rows are
separate sequences; an empty table gives a manifest without shards; columns other than key and text are dropped.
The input must give the same rows in the same partitions when computed twice, as tables do; counts are compared and
the write fails otherwise.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindlewatch.llm.byte_bpe import encode, encoding

LENGTH = 512
SHARD_SLOTS = 8192
ROUNDS = 6
NULL_KEY = -(1 << 63)
HEADER = [("key", "<i8"), ("number", "<i4"), ("n_ids", "<i4")]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, key: int, inverse: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    keys = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    for k in keys[::-1] if inverse else keys:
        if inverse:
            left, right = right ^ (_mixed(left + k) & mask), left
        else:
            left, right = right, left ^ (_mixed(right + k) & mask)
    return left << np.uint64(half) | right


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slots of indices 0 .. n - 1 under the keyed permutation of that range; or the indices of slots."""
    half = _half_bits(n)
    out = _network(index.astype(np.uint64), half, key, inverse)
    while (outside := out >= np.uint64(n)).any():  # cycle-walking: four steps at most on average
        out[outside] = _network(out[outside], half, key, inverse)
    return out.astype(np.int64)


def write_shards(
    docs: DataFrame, folder: str, path: str, pattern: str, seed: int, key: str = "doc_id", text: str = "text",
    length: int = LENGTH, shard_slots: int = SHARD_SLOTS, end_id: int | None = None, pad_id: int = 0,
) -> dict:
    """Write shards, index and manifest of ``docs`` below ``folder``; returns the manifest. ``end_id`` defaults to the vocabulary's size."""
    spark = docs.sparkSession
    end = encoding(path, pattern).n_vocab if end_id is None else end_id
    width = 2 if end < 1 << 16 else 4
    rows = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_KEY)).alias("key"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("most", F.expr(f"(octet_length(text) + {length}) div {length}"))
    # one row for each input partition
    counted = sorted(
        map(tuple, rows.groupBy(F.spark_partition_id()).agg(F.sum("most"), F.count(F.lit(1))).collect())
    )
    total = sum(n for _, n, _ in counted)
    first = dict(zip((p for p, _, _ in counted), np.cumsum([0] + [n for _, n, _ in counted]).tolist(), strict=False))
    seen = {p: (n, r) for p, n, r in counted}
    record = np.dtype([*HEADER, ("ids", f"<u{width}", length)])
    manifest = {
        "slots": total, "length": length, "id_bytes": width, "shard_slots": shard_slots, "seed": seed, "end_id": end,
        "pad_id": pad_id, "stride": record.itemsize + 1, "shards": -(-total // shard_slots),
    }

    def place(batches):
        enc = encoding(path, pattern)
        part = TaskContext.get().partitionId()
        bound, n_rows = 0, 0
        for batch in batches:
            frame = batch.to_pydict()
            ids = [np.asarray([*encode(enc, t), end], dtype=f"<u{width}") for t in frame["text"]]
            windows = np.array([-(-len(i) // length) for i in ids])
            most = np.array(frame["most"])
            firsts = np.cumsum(windows) - windows
            block = np.full(int(windows.sum()) * length, pad_id, dtype=f"<u{width}")
            for at, found in zip(firsts * length, ids, strict=True):
                block[at : at + len(found)] = found
            out = np.zeros(int(windows.sum()), record)
            out["key"] = np.repeat(frame["key"], windows)
            out["number"] = np.arange(len(out)) - np.repeat(firsts, windows)
            sizes = np.repeat([len(i) for i in ids], windows)
            out["n_ids"] = np.minimum(length, sizes - out["number"] * length)
            out["ids"] = block.reshape(-1, length)
            starts = first[part] + bound + np.cumsum(most) - most
            slots = permuted(np.repeat(starts, windows) + out["number"], total, seed)
            bound, n_rows = bound + int(most.sum()), n_rows + len(most)
            offsets = np.arange(len(out) + 1, dtype=np.int32) * record.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), data], ["slot", "record"])
        if seen.get(part, (0, 0)) != (bound, n_rows):
            raise RuntimeError("the input gave other rows when it was computed again; write it to a table first")

    parts = max(1, min(manifest["shards"], int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = rows.mapInArrow(place, "slot bigint, record binary").selectExpr("*", f"slot div {shard_slots} AS shard")
    share = F.expr(f"int(shard * {parts} div {max(1, manifest['shards'])})")
    (
        placed.repartitionById(parts, share).sortWithinPartitions("shard", "slot")
        .select(F.col("record").cast("string").alias("value"), "shard")
        .write.partitionBy("shard").text(f"{folder}/shards")
    )
    _write_index(spark, folder, manifest)
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


INDEX = "shard bigint, records bigint, first bigint"
#: Shards whose first positions are summed up in one task.
INDEX_ROWS = 4096


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/shards").withColumn("shard", F.col("shard").cast("bigint"))


def _write_index(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Records and first position of each shard, from the lengths of the files alone."""
    if not manifest["shards"]:
        spark.createDataFrame([], INDEX).write.parquet(f"{folder}/index")
        return
    sizes = _files(spark, folder).groupBy("shard").agg(F.sum("length").alias("bytes")).select(
        "shard", F.expr(f"bytes div {manifest['stride']}").alias("records"), F.expr(f"shard div {INDEX_ROWS}").alias("block")
    )
    blocks = sorted(map(tuple, sizes.groupBy("block").agg(F.sum("records")).collect()))
    firsts = np.cumsum([0] + [n for _, n in blocks]).tolist()
    bases = spark.createDataFrame([(b, f) for (b, _), f in zip(blocks, firsts, strict=False)], "block bigint, base bigint")
    before = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("inner", F.coalesce(F.sum("records").over(before), F.lit(0)))
    sizes.join(bases, "block").selectExpr("shard", "records", "base + inner AS first").write.parquet(f"{folder}/index")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest").first()["value"])


def read_shards(spark: SparkSession, folder: str, begin: int = 0, end: int | None = None) -> DataFrame:
    """Sequences at positions begin .. end - 1: position, shard, key, number, n_ids, ids (4 bytes each, no padding).

    Only shards that hold such positions are opened. To resume after a position, begin at the next.
    """
    about = read_manifest(spark, folder)
    last = (1 << 62) if end is None else end
    index = spark.read.schema(INDEX).parquet(f"{folder}/index").filter((F.col("first") < last) & (F.col("first") + F.col("records") > begin))
    low, high = index.agg(F.min("shard"), F.max("shard")).first()
    schema = "position bigint, shard bigint, key bigint, number int, n_ids int, ids binary"
    if low is None:
        return spark.createDataFrame([], schema)
    stride, record = about["stride"], np.dtype([*HEADER, ("ids", f"<u{about['id_bytes']}", about["length"]), ("line", "u1")])
    files = _files(spark, folder).filter(F.col("shard").between(low, high)).select("shard", "content").join(index, "shard")

    def run(frames):
        for frame in frames:
            for shard, content, first in zip(frame["shard"], frame["content"], frame["first"], strict=True):
                if len(content) % stride:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                found = np.frombuffer(content, record)
                position = first + np.arange(len(found))
                keep = (position >= begin) & (position < last)
                found, position = found[keep], position[keep]
                key = pd.array(found["key"], dtype="Int64")
                key[found["key"] == NULL_KEY] = pd.NA
                ids = found["ids"].astype("<u4")
                yield pd.DataFrame(
                    {
                        "position": position, "shard": shard, "key": key, "number": found["number"], "n_ids": found["n_ids"],
                        "ids": [i[:n].tobytes() for i, n in zip(ids, found["n_ids"].tolist(), strict=True)],
                    }
                )

    return files.mapInPandas(run, schema)
