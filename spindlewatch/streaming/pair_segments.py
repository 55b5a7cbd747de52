"""Consume-once pairing of two streams without folding a machine's records in one task.

What a stretch of a machine's records does to the pairing depends on one thing before it only: whether the record left waiting is of
the other side than the stretch's first record. If so, that one is consumed and the rest starts anew; if not, the first
record waits itself. So a segment of a few seconds is a function with two values, each a list of pairs and a record left waiting. Both are worked
out by Spark, segment by segment in any task, with array functions on rows gathered by a window aggregation. The state of a machine
takes one row a segment, picks the value, and passes its text through unread.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewatch.streaming import processors as p
from spindlewatch.streaming.transforms import pair_columns, pair_sides

_NONE = -1
_PAIRS = "array<struct<us: bigint, side: int, held: string, record: string>>"


def _folded(rows: Column) -> Column:
    """(side, held, out): what a list of records leaves waiting, and the pairs it makes, from an empty state."""
    start = F.struct(
        F.lit(_NONE).alias("side"), F.lit(None).cast("string").alias("held"), F.array().cast(_PAIRS).alias("out")
    )

    def step(s, x):
        meets = (s["side"] != _NONE) & (s["side"] != x["side"])
        pair = F.struct(x["us"].alias("us"), x["side"].alias("side"), s["held"].alias("held"), x["record"].alias("record"))
        return F.struct(
            F.when(meets, _NONE).otherwise(x["side"]).alias("side"), F.when(~meets, x["record"]).alias("held"),
            F.when(meets, F.array_append(s["out"], pair)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(rows, start, step)


_VALUES = ("a_side", "a_held", "a_pairs", "b_side", "b_held", "b_pairs")


class ChainSegments(p.VectorReplay):
    """Picks a segment's value by what waits before it, which is the memory: (side, record). A row is a segment's first record
    and its two values."""

    more = ("first_us", *_VALUES)

    def fold(self, memory, us, side, payload, first_us, a_side, a_held, a_pairs, b_side, b_held, b_pairs):
        waited, consumed = np.empty(len(us), object), np.zeros(len(us), bool)
        for i, first in enumerate(side.tolist()):
            if memory is not None and memory[0] != first:
                waited[i], consumed[i] = memory[1], True
                after, held = b_side[i], b_held[i]
            else:
                after, held = a_side[i], a_held[i]
            memory = None if after == _NONE else (int(after), held)
        return memory, {
            "first_us": first_us, "first_side": side, "first_record": payload, "pairs": np.where(consumed, b_pairs, a_pairs), "waited": waited,
        }


def pair_stream_by_segment(
    state: DataFrame, metrics: DataFrame, order: str, time_column: str, segment: str = "10 seconds", delay: str | None = None
) -> DataFrame:
    """``transforms.pair_stream`` for hot machines; a segment's pairs come out when the watermark has passed its end."""
    both, schemas = pair_sides(state, metrics, order, time_column)
    if delay:
        both = both.withWatermark(p.TIME, delay)
    each = F.struct(F.col(p.US).alias("us"), F.col(p.RANK).alias("rank"), F.col(p.SIDE).cast("int").alias("side"), F.col(p.PAYLOAD).alias("record"))
    gathered = both.groupBy(F.window(p.TIME, segment).alias("_w"), "machineId").agg(F.array_sort(F.collect_list(each)).alias("_r"))
    first = F.element_at("_r", 1)
    values = gathered.select(
        "machineId", F.window_time("_w").alias(p.TIME), F.unix_micros("_w.end").alias(p.US), F.lit(0).cast("bigint").alias(p.RANK),
        first["us"].alias("first_us"), first["side"].alias(p.SIDE), first["record"].alias(p.PAYLOAD),
        _folded(F.col("_r")).alias("a"), _folded(F.slice("_r", 2, F.greatest(F.size("_r"), F.lit(1)))).alias("b"),
    )
    # as a text: a null among whole numbers would reach Python as NaN, which is a key of its own in each row
    plain = values.select(
        F.col("machineId").cast("string").alias("machineId"), p.TIME, p.US, p.RANK, p.SIDE, p.PAYLOAD, "first_us",
        *[c for v in "ab" for c in (F.col(f"{v}.side").alias(f"{v}_side"), F.col(f"{v}.held").alias(f"{v}_held"), F.to_json(f"{v}.out").alias(f"{v}_pairs"))],
    )
    output = T.StructType([T.StructField("first_us", T.LongType()), T.StructField("first_side", T.IntegerType())] + [
        T.StructField(c, T.StringType()) for c in ("first_record", "pairs", "waited")
    ])
    chosen = p.run_vector(plain, ["machineId"], ChainSegments(["machineId"]), output)
    chosen = chosen.withColumn("machineId", F.col("machineId").cast(values.schema["machineId"].dataType))
    joined = F.struct(F.col("first_us").alias("us"), F.col("first_side").alias("side"), F.col("waited").alias("held"), F.col("first_record").alias("record"))
    inside = F.from_json("pairs", _PAIRS)
    pairs = chosen.select("machineId", F.inline(F.when(F.col("waited").isNotNull(), F.array_prepend(inside, joined)).otherwise(inside)))
    later_is_state = F.col("side") == 0
    texts = pairs.select(
        "machineId", F.timestamp_micros("us").alias(p.TIME), F.col("side").cast("string").alias("last"),
        F.when(later_is_state, F.col("record")).otherwise(F.col("held")).alias("left"),
        F.when(later_is_state, F.col("held")).otherwise(F.col("record")).alias("right"),
    )
    return pair_columns(texts, schemas, order, time_column)
