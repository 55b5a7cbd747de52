"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine verification, connected components.

Method: the signs of products with random hyperplanes give a code in each of several tables; vectors of equal label
that share a code in any table are compared by exact cosine. The number of hyperplanes of a code grows with the logarithm of the
number of vectors, so that buckets keep their size, and the number of tables with it, so that a pair exactly at the
threshold is missed with a probability of at most ``MISSED``.

Pairs are compared block by block and never emitted: a block reports how many links each vector has (a pair counts in
the first table it shares a code in) and one edge for each vector to the lowest vector of its component within the block.
Buckets larger than ``BLOCK`` are split into blocks of two chunks each, so that every pair is still compared. Equal
vectors are one class with a weight.

Defined results: a vector that is null or zero, holds null or non-finite components, or has a null label links with
nothing; vectors of different lengths do not link; rows with the same id are separate vectors; an empty table gives an
empty table; columns other than id, vector and label are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.llm.common import sorted_groups, written
from spindlewatch.llm.components import components

THRESHOLD = 0.93
MISSED = 1e-4
BUCKET = 32
BLOCK = 1024
SEED = 11


def usable(vector: str):
    """Whether a vector is not null or zero and all its components are finite."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def tables_and_bits(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(tables, hyperplanes of each) for so many vectors of a label."""
    bits = min(30, max(4, round(math.log2(max(1, vectors) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISSED) / math.log1p(-same)), bits


def _codes(tables: int, bits: int):
    @F.pandas_udf("array<int>")
    def run(column: pd.Series) -> pd.Series:
        out: list = [None] * len(column)
        sizes = column.map(len)
        for d in sizes.unique():
            at = np.flatnonzero(sizes == d)
            planes = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), tables * bits))
            signs = np.stack([np.asarray(column.iloc[i], np.float64) for i in at]) @ planes > 0
            codes = signs.reshape(len(at), tables, bits) @ (1 << np.arange(bits))
            for i, row in zip(at, codes.astype(np.int32), strict=True):
                out[i] = row
        return pd.Series(out)

    return run


def _block_links(v: np.ndarray, codes: np.ndarray, label: np.ndarray, table: int, side: np.ndarray, threshold: float):
    """Linked pairs (i, j), i < j, of one block and whether they count here; sides 0 and 1 are compared crosswise, 2 among themselves."""
    first, second = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    near = v[first] @ v[second].T >= threshold
    near &= label[first][:, None] == label[second][None, :]
    i, j = np.nonzero(near)
    i, j = first[i], second[j]
    if len(side) and side[0] == 2:
        keep = i < j
        i, j = i[keep], j[keep]
    fresh = np.ones(len(i), bool)
    for t in range(table):
        fresh &= codes[i, t] != codes[j, t]
    return i, j, fresh


def _lowest(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each position the lowest id reachable over pairs (i, j)."""
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            return low
        low = new


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Per vector: key, n_links, component_id (smallest key reachable over links, its own included), kept (key = component_id)."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(label).alias("label"))
    rows = rows.withColumn("ok", usable("v") & F.col("label").isNotNull())
    h = [F.when(F.col("ok"), F.xxhash64(F.lit(seed), "label", "v")) for seed in (1, 2)]
    members = rows.select("key", h[0].alias("h1"), h[1].alias("h2"))
    classes = (
        rows.filter("ok").select(h[0].alias("h1"), h[1].alias("h2"), "key", "v", F.xxhash64("label").alias("label"))
        .groupBy("h1", "h2")
        .agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"), F.first("label").alias("label"))
    )
    classes = written(classes, "embedding-classes")
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    tables, bits = tables_and_bits(most, threshold)

    @F.pandas_udf("binary")
    def unit(column: pd.Series) -> pd.Series:
        return column.map(lambda x: _unit(np.asarray(x, np.float64)).tobytes())

    coded = written(
        classes.select("h1", "h2", "weight", "label", F.size("v").alias("d"), unit("v").alias("v"), _codes(tables, bits)("v").alias("codes")),
        "embedding-codes",
    )
    spread = coded.select("*", F.posexplode("codes").alias("t", "code")).withColumn("bucket", F.xxhash64("label", "d", "t", "code"))
    large = (
        spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
        .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks"))
    )
    large = written(large, "embedding-large")
    spread = spread.join(large, "bucket", "left")
    chunk = F.pmod(F.xxhash64("h1", F.lit(5)), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = (
        spread.select("*", F.coalesce(chunk, F.lit(0)).alias("own"), other.alias("other"))
        .select(
            "h1", "h2", "weight", "label", "v", "codes", "t",
            F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        )
        .repartition("block").sortWithinPartitions("block")
    )

    def compare(frames):
        for frame, starts in sorted_groups(frames, "block"):
            sums: dict[int, np.ndarray] = {}
            found = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2:
                    continue
                part = frame.iloc[a:b]
                side = part["side"].to_numpy()
                order = np.argsort(side, kind="stable")
                part, side = part.iloc[order], side[order]
                v = np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), -1)
                codes = np.stack(part["codes"].to_numpy())
                i, j, fresh = _block_links(v, codes, part["label"].to_numpy(), int(part["t"].iloc[0]), side, threshold)
                if not len(i):
                    continue
                weight = part["weight"].to_numpy(np.float64)
                links = np.bincount(i[fresh], weights=weight[j[fresh]], minlength=len(part))
                links += np.bincount(j[fresh], weights=weight[i[fresh]], minlength=len(part))
                h1, h2 = part["h1"].to_numpy(), part["h2"].to_numpy()
                low = _lowest(i, j, np.arange(len(part)))
                at = np.flatnonzero((links > 0) | (low != np.arange(len(part))))
                found.append(pd.DataFrame({"h1": h1[at], "h2": h2[at], "links": links[at].astype(np.int64), "l1": h1[low[at]], "l2": h2[low[at]]}))
            if found:
                yield pd.concat(found, ignore_index=True)

    linked = written(
        blocks.mapInPandas(compare, "h1 bigint, h2 bigint, links bigint, l1 bigint, l2 bigint"), "embedding-links"
    )
    links = linked.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    # components on class numbers: the lowest id of the class names it
    names = classes.select("h1", "h2", "rep")
    ends = (
        linked.select("h1", "h2", "l1", "l2").distinct().join(names, ["h1", "h2"])
        .join(names.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), F.col("rep").alias("low")), ["l1", "l2"])
        .select(F.col("rep").alias("a"), F.col("low").alias("b"))
    )
    found = components(ends)
    known = written(
        classes.select("h1", "h2", "rep", "weight").join(links, ["h1", "h2"], "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")),
        "embedding-known",
    )
    out = members.join(known, ["h1", "h2"], "left").select(
        "key", F.coalesce(F.col("weight") - 1 + F.col("links"), F.lit(0)).alias("n_links"),
        F.coalesce("component", "key").alias("component_id"),
    )
    return out.withColumn("kept", F.col("key").eqNullSafe(F.col("component_id"))).withColumnRenamed("key", key)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
    return x / np.sqrt(x @ x)
