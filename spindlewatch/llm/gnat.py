"""Hard negatives by a GNAT-style multiway hyperplane tree: rows of another label that score almost as high as a positive.

A score is the inner product of two vectors of whole numbers; higher scores come first, ties by smaller id. An anchor's
positives are its first rows of the same label; the negatives of an anchor and a positive are the first rows of other labels
whose score lies in a window below the positive's.

Method: each node of the tree has up to ``ARITY`` split points, and a row goes down to the nearest one (a partition by
hyperplanes). A node stores for each split point the range of its distances to the rows of every sibling subtree, and the range of the
norms there. With |a - b|^2 = |a|^2 + |b|^2 - 2 a.b a window of scores is an annulus around the anchor; a subtree whose ranges
do not meet it, seen from any split point, is eliminated. The split points come from a sample of at most ``SAMPLE`` rows (the
smallest hashes; the bound does not affect results), the ranges from all rows. Rows of a cell are cut into
leaves by their distance to its split point, with ranges of their own, so leaves stay below ``LEAF`` rows at any size; crowds at
one distance are split further by hash. Leaves are compared exactly, block by block (``LEAF`` rows x ``QUERIES`` anchors).
A search visits the anchor's own cell first; the scores found there narrow its annuli, and the second visit goes to all
other leaves that still meet one. No row, pair or candidate is capped, so the result is that of a full comparison.

Results: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of different
lengths are not compared; an anchor is no partner of rows with its own id; equal anchor rows count once, equal partner rows
each; fewer partners than asked for give fewer rows; other columns are dropped; an empty table gives an empty table. Whole
numbers are exact as long as scores stay below 2^63.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from spindlewatch.llm.common import fresh, sorted_groups, written

ARITY = 8
SAMPLE = 8192
SPLIT = 48
DEPTH = 4
LEAF = 2048
QUERIES = 1024
BINS = 256
EXACT = float(1 << 53)


def finite(vector: str) -> Column:
    """Whether a vector is not null and all its components are finite."""
    each = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & each


def _distances(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (v * v).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (v @ points.T)
    return np.sqrt(np.maximum(square, 0))


def grow(sample: np.ndarray, first_cell: int = 0) -> dict:
    """A tree over a sample: nodes (points, children: node number or -1 - cell) and each cell's path and split point."""
    nodes: list[dict] = []
    cells: dict[int, tuple] = {}

    def add(rows: np.ndarray, path: tuple) -> int:
        number = len(nodes)
        chosen = [0]  # farthest from those chosen so far
        near = _distances(rows, rows[:1])[:, 0]
        while len(chosen) < ARITY and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, _distances(rows, rows[chosen[-1:]])[:, 0])
        points = rows[chosen]
        nodes.append({"points": points, "children": []})
        to = _distances(rows, points).argmin(1)
        for j in range(len(points)):
            below = rows[to == j]
            if len(below) > SPLIT and len(path) + 1 < DEPTH and (below != below[0]).any():
                child = add(below, (*path, (number, j)))
            else:
                cell = first_cell + len(cells)
                cells[cell] = ((*path, (number, j)), points[j])
                child = -1 - cell
            nodes[number]["children"].append(child)
        return number

    if len(sample):
        add(sample, ())
    return {"nodes": nodes, "cells": cells}


def locate(tree: dict, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance to its split point) of each row."""
    cell, r = np.empty(len(v), np.int64), np.empty(len(v))
    waiting = [(0, np.arange(len(v)))]
    while waiting:
        number, at = waiting.pop()
        node = tree["nodes"][number]
        d = _distances(v[at], node["points"])
        to = d.argmin(1)
        for j, child in enumerate(node["children"]):
            mine = at[to == j]
            if not len(mine):
                continue
            if child >= 0:
                waiting.append((child, mine))
            else:
                cell[mine], r[mine] = -1 - child, d[to == j, j]
    return cell, r


def meets(q2, low, high, near, far, least, most):
    """Whether rows at distances near..far with squared norms least..most can score within low..high."""
    slack = 1e-7 * (q2 + most) + 0.5
    return ((q2 + most - near * near) / 2 >= low - slack) & ((q2 + least - far * far) / 2 <= high + slack)


def alive(tree: dict, v: np.ndarray, low: np.ndarray, high: np.ndarray, window: np.ndarray):
    """(row, cell, distance) of the cells that can hold scores in a window; windows low, high belong to rows ``window``."""
    q2 = (v * v).sum(1)
    out = []
    waiting = [(0, np.arange(len(v)))]
    while waiting:
        number, at = waiting.pop()
        node = tree["nodes"][number]
        d = _distances(v[at], node["points"])
        place = np.full(len(v), -1)
        place[at] = np.arange(len(at))
        mine = place[window] >= 0
        of, lo, hi = place[window[mine]], low[mine], high[mine]
        for j, child in enumerate(node["children"]):
            if not node["most"][j] >= 0:  # no rows there
                continue
            near = np.maximum(np.maximum(node["near"][:, j] - d, d - node["far"][:, j]), 0).max(1)
            far = (d + node["far"][:, j]).min(1)
            ok = meets(q2[at][of], lo, hi, near[of], far[of], node["least"][j], node["most"][j])
            live = np.zeros(len(at), bool)
            live[of[ok]] = True
            if not live.any():
                continue
            if child >= 0:
                waiting.append((child, at[live]))
            else:
                out.append((at[live], np.full(int(live.sum()), -1 - child), d[live, j]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(column) -> np.ndarray:
    data = np.frombuffer(b"".join(column), np.float64)
    return data.reshape(len(column), -1) if len(data) else np.zeros((len(column), 0))


def _by_length(frame: pd.DataFrame):
    for d, part in frame.groupby("d", sort=False):
        yield int(d), part


def _index(points: DataFrame):
    """(rows with cell, distance and leaf bin, written; bins with ranges and sizes, written; trees by vector length)."""
    drawn = points.select("d", "v", F.xxhash64("key", "v").alias("h")).orderBy("h", "d", "v").limit(SAMPLE).toPandas()
    trees: dict[int, dict] = {}
    count = 0
    for d, part in _by_length(drawn):
        if d:
            trees[d] = grow(np.unique(_matrix(part["v"].tolist()), axis=0), count)
            count += len(trees[d]["cells"])

    def place(frames):
        for frame in frames:
            for d, part in _by_length(frame):
                if d in trees:
                    cell, r = locate(trees[d], _matrix(part["v"].tolist()))
                else:
                    cell, r = -1 - d, 0.0
                yield part.assign(cell=cell, r=r)

    rows = written(points.mapInPandas(place, f"{_POINT}, cell bigint, r double"), "gnat-cells")

    def spread(frames):
        """Ranges of distances to split points, by subtree, over this task's rows."""
        kept: dict[tuple, list] = {}
        for frame in frames:
            for (d, cell), part in frame.groupby(["d", "cell"], sort=False):
                if d not in trees:
                    continue
                v = _matrix(part["v"].tolist())
                n2 = (v * v).sum(1)
                for number, child in trees[d]["cells"][cell][0]:
                    away = _distances(v, trees[d]["nodes"][number]["points"])
                    had = kept.get((d, number, child))
                    new = [away.min(0), away.max(0), n2.min(), n2.max()]
                    if had:
                        new = [np.minimum(had[0], new[0]), np.maximum(had[1], new[1]), min(had[2], new[2]), max(had[3], new[3])]
                    kept[d, number, child] = new
        for (d, number, child), (near, far, least, most) in kept.items():
            yield pd.DataFrame({
                "d": int(d), "number": number, "child": child, "i": np.arange(len(near)), "near": near, "far": far, "least": least, "most": most,
            })

    ranges = rows.select("d", "cell", "v").mapInPandas(
        spread, "d int, number int, child int, i int, near double, far double, least double, most double"
    ).groupBy("d", "number", "child", "i").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.min("least").alias("least"), F.max("most").alias("most"))
    for tree in trees.values():
        for node in tree["nodes"]:
            m = len(node["points"])
            node |= {"near": np.zeros((m, m)), "far": np.zeros((m, m)), "least": np.full(m, -1.0), "most": np.full(m, -1.0)}
    for r in ranges.collect():  # at most ARITY^2 rows a node, and nodes are bounded by the sample
        node = trees[r["d"]]["nodes"][r["number"]]
        node["near"][r["i"], r["child"]], node["far"][r["i"], r["child"]] = r["near"], r["far"]
        node["least"][r["child"]], node["most"][r["child"]] = r["least"], r["most"]

    # leaves: bins of the distance within a cell, split by hash where a bin is crowded
    steps = [i / BINS for i in range(1, BINS)]
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", steps, 2000).alias("bounds")).withColumn(
        "every", F.greatest(F.lit(1), F.floor(F.lit(BINS) / F.greatest(F.lit(1), F.least(F.lit(BINS), F.ceil(F.col("n") / LEAF))))).cast("int")
    )
    below = F.size(F.filter("bounds", lambda b: b < F.col("r")))
    binned = written(
        rows.join(cells.select("cell", "bounds", "every"), "cell").withColumn("bin", F.floor(below / F.col("every")).cast("int")).drop("bounds", "every"),
        "gnat-rows",
    )
    bins = written(
        binned.groupBy("cell", "bin").agg(
            F.min("r").alias("near"), F.max("r").alias("far"), F.min("n2").alias("least"), F.max("n2").alias("most"),
            F.ceil(F.count(F.lit(1)) / LEAF).cast("int").alias("parts"),
        ),
        "gnat-bins",
    )
    return binned, bins, trees


_POINT = "key bigint, label bigint, d int, n2 double, v binary"
_QUERY = "qid bigint, key bigint, label bigint, d int, n2 double, v binary, own bigint, low array<double>, high array<double>"


def _visits(queries: DataFrame, bins: DataFrame, trees: dict, own: bool) -> DataFrame:
    """Queries with the leaves (cell, bin) they must see: of their own cell, or of all others."""

    def run(frames):
        for frame in frames:
            for d, part in _by_length(frame):
                if d not in trees:
                    if own:
                        yield part.assign(cell=part["own"], away=np.nan)  # null in Spark: no tree, no elimination
                    continue
                v = _matrix(part["v"].tolist())
                sizes = [len(x) for x in part["low"]]
                low, high = (np.concatenate([np.asarray(x, np.float64) for x in part[c]]) for c in ("low", "high"))
                row, cell, away = alive(trees[d], v, low, high, np.repeat(np.arange(len(part)), sizes))
                keep = (part["own"].to_numpy()[row] == cell) == own
                yield part.iloc[row[keep]].assign(cell=cell[keep], away=away[keep])

    seen = queries.mapInPandas(run, f"{_QUERY}, cell bigint, away double").join(bins, "cell")
    near = F.greatest(F.col("near") - F.col("away"), F.col("away") - F.col("far"), F.lit(0.0))
    far = F.col("away") + F.col("far")
    ok = meets(F.col("n2"), F.array_min("low"), F.array_max("high"), near, far, F.col("least"), F.col("most"))
    return seen.filter(F.col("away").isNull() | ok)


def _compare(found: DataFrame, rows: DataFrame, bins: DataFrame, same: bool, k: int) -> DataFrame:
    """(qid, w, other, score): for each window of each query its first k rows in each visited leaf."""
    found = written(found.select(*(c.split()[0] for c in _QUERY.split(", ")), "cell", "bin", "parts"), "gnat-visits")
    asked = found.groupBy("cell", "bin").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("groups"))
    nothing = F.lit(None).cast("array<double>")
    parted = rows.join(bins.select("cell", "bin", "parts"), ["cell", "bin"]).join(asked, ["cell", "bin"])
    points = parted.select(
        F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("qid"), "key", "label", "v", nothing.alias("low"), nothing.alias("high"), "cell", "bin",
        F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"),
    )
    askers = found.join(asked, ["cell", "bin"]).select(
        F.lit(1).alias("side"), "qid", "key", "label", "v", "low", "high", "cell", "bin",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("part"),
        F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int").alias("group"),
    )
    blocks = (
        points.unionByName(askers).withColumn("block", F.xxhash64("cell", "bin", "part", "group")).drop("cell", "bin", "part", "group")
        .repartition("block").sortWithinPartitions("block")
    )

    def run(frames):
        for whole, starts in sorted_groups(frames, "block"):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part = whole.iloc[a:b]
                side = part["side"].to_numpy()
                if side.all() or not side.any():
                    continue
                mine = part[side == 0].sort_values("key", kind="stable")
                out = _best(part[side == 1], mine, same, k)
                if len(out):
                    yield out

    return blocks.mapInPandas(run, "qid bigint, w int, other bigint, score bigint")


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if not q.shape[1] or np.abs(q).max() * np.abs(v).max() * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    # beyond what doubles hold
    a, b = ([[int(x) for x in row] for row in m] for m in (q, v))
    return np.array([[sum(x * y for x, y in zip(r, s, strict=True)) for s in b] for r in a], np.int64)


def _best(asks: pd.DataFrame, mine: pd.DataFrame, same: bool, k: int) -> pd.DataFrame:
    q, v = _matrix(asks["v"].tolist()), _matrix(mine["v"].tolist())
    key = mine["key"].to_numpy()
    score = _scores(q, v)
    ok = asks["key"].to_numpy()[:, None] != key[None, :]
    ok &= (asks["label"].to_numpy()[:, None] == mine["label"].to_numpy()[None, :]) == same
    lows, highs, qid = asks["low"].tolist(), asks["high"].tolist(), asks["qid"].to_numpy()
    found = []
    for w in range(max(len(x) for x in lows)):
        at = np.array([i for i, x in enumerate(lows) if len(x) > w])
        low, high = (np.array([x[i][w] for i in at]) for x in (lows, highs))
        s = score[at]
        fits = ok[at] & (s >= low[:, None]) & (s <= high[:, None])
        some = np.flatnonzero(fits.any(1))
        if not len(some):
            continue
        s, fits = s[some], fits[some]
        worth = np.where(fits, s, np.iinfo(np.int64).min)
        if s.shape[1] > k:  # all that reach the k-th score; ties are settled by id below
            kth = np.partition(worth, -k, axis=1)[:, -k]
            fits &= worth >= kth[:, None]
        i, j = np.nonzero(fits)
        order = np.lexsort((j, -s[i, j], i))  # columns are in the order of ids
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[rank < k], j[rank < k]
        found.append(pd.DataFrame({"qid": qid[at[some[i]]], "w": w, "other": key[j], "score": s[i, j]}))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame()


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid", "w").orderBy(F.desc("score"), F.asc("other"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(queries: DataFrame, rows: DataFrame, bins: DataFrame, trees: dict, same: bool, k: int) -> DataFrame:
    """(qid, w, other, score, rank) of the first k rows in each window of each query, of the same label or of others."""
    near = written(_first(_compare(_visits(queries, bins, trees, True), rows, bins, same, k), k), "gnat-near")
    reached = near.filter(F.col("rank") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
    narrowed = queries.join(reached, "qid", "left").withColumn(
        "low", F.expr("transform(low, (x, i) -> greatest(x, coalesce(cast(reached[i] as double), x)))")
    ).drop("reached")
    far = _compare(_visits(narrowed, bins, trees, False), rows, bins, same, k)
    return written(_first(near.drop("rank").unionByName(far), k), "gnat-found")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; window low..high in hundredths of the positive's score.

    Components must be whole numbers. Labels that are not whole numbers are compared by a 64-bit hash.
    """
    whole = isinstance(vectors.schema[label].dataType, IntegralType)
    flag = fresh("anchor")

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return column.map(lambda x: np.asarray(x, np.float64).tobytes())

    usable = vectors.withColumn(flag, F.coalesce(is_anchor, F.lit(False))).filter(
        F.col(key).isNotNull() & F.col(label).isNotNull() & finite(vector)
    )
    points = usable.select(
        F.col(key).cast("bigint").alias("key"), (F.col(label).cast("bigint") if whole else F.xxhash64(label)).alias("label"),
        F.size(vector).alias("d"), F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("n2"), packed(vector).alias("v"),
        F.col(flag).alias("anchor"),
    )
    points = written(points, "gnat-points")
    rows, bins, trees = _index(points.drop("anchor"))
    qid = F.xxhash64("key", "label", "v")
    own = rows.select("key", "label", "v", "d", "n2", F.col("cell").alias("own"), qid.alias("qid")).join(
        points.filter("anchor").select(qid.alias("qid")).distinct(), "qid"
    ).dropDuplicates(["qid"])
    far = float("inf")
    names = [c.split()[0] for c in _QUERY.split(", ")]
    anchors = written(own.withColumn("low", F.array(F.lit(-far))).withColumn("high", F.array(F.lit(far))).select(*names), "gnat-anchors")
    good = search(anchors, rows, bins, trees, True, positives)
    pairs = good.filter("score >= 0").select(
        "qid", F.col("other").alias("positive"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("w"),
        F.expr(f"({low} * score + 99) div 100").cast("double").alias("at_least"), F.expr(f"({high} * score) div 100").cast("double").alias("at_most"),
    )
    pairs = written(pairs, "gnat-pairs")
    windows = pairs.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("w", "at_least", "at_most"))).alias("all"))
    asks = written(
        anchors.drop("low", "high").join(windows, "qid").select(
            "*", F.transform("all", lambda x: x["at_least"]).alias("low"), F.transform("all", lambda x: x["at_most"]).alias("high")
        ).select(*names),
        "gnat-asks",
    )
    bad = search(asks, rows, bins, trees, False, negatives)
    # scores fall with rank, so those below zero are last and windows are numbered like the positives
    return (
        bad.join(pairs, ["qid", "w"]).join(anchors.select("qid", "key"), "qid").select(
            F.col("key").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        )
    )
