"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, queries search it greedily.

Graph: every vector starts with the nearest of the vectors beside it in a few orders by random projections (range-partitioned sorts, cut
into blocks). Then, in each round, the neighbours of a vector, near it in either direction, are joined with their
vectors and compared with each other; pairs that improve a neighbour list go to its owner, which keeps the ``degree``
nearest. Rounds end when few lists change. A vector that many others name takes several groups: all its own neighbours meet each
chunk of those others.

Search: each query keeps a beam of the nearest vectors met. A round expands the nearest beam members not yet
expanded along graph edges (its neighbours, and the ``degree`` nearest of those that name it), by joins of all queries
at once; it ends when no beam has any left. The beam is then ranked by exact cosines in double precision.

Graph and search compare the vectors as they are given, in double precision, so that near copies are told apart as the
final ranking does it. Equal vectors are one node.

Defined results: vectors that are null or zero or hold null or non-finite components take no part, as queries or as
candidates; vectors of different lengths are no candidates for each other; rows with the same id are separate vectors; ties
go to the smaller id; a query with fewer candidates than asked for gets all that were found; an empty table gives an empty table.
The recall of the registered query is tested against brute force.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindlewatch.llm.common import sorted_groups, written
from spindlewatch.llm.embedding_dedup import usable

DEGREE = 32
ORDERS = 8
BLOCK = 1024
#: Share of list entries that changed, below which no further round is made.
SETTLED = 0.02
#: Width of the beam up to so many nodes; it grows by as much again with each sixteenfold (``beam_for``).
BEAM, BEAM_NODES = 128, 4096
EXPANDED = 32
SEED = 5


def coded(x: np.ndarray) -> bytes:
    """A vector's components as they are, behind a byte for their width."""
    return x.dtype.char.encode() + x.tobytes()


def decoded(codes) -> np.ndarray:
    """Directions of unit length in double precision, one row for each code of equal size."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    x = np.ascontiguousarray(raw[:, 1:]).view(chr(raw[0, 0])).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision; both are scaled by powers of two, which rounds nothing, so that squares stay finite."""
    a, b = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in (a, b))
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def nodes_of(vectors: DataFrame, copies: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): node, v, code, and node, key of all rows. A node is the smallest key of equal vectors; ``ids``
    of a node are its ``copies`` smallest keys. ``vectors`` has key and v."""
    rows = vectors.filter(usable("v")).select("key", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    classes = rows.groupBy("h1", "h2").agg(F.min("key").alias("node"), F.first("v").alias("v"))

    width = np.float32 if vectors.schema["v"].dataType.elementType.typeName() == "float" else np.float64

    @F.pandas_udf("binary")
    def code(column: pd.Series) -> pd.Series:
        return column.map(lambda x: coded(np.asarray(x, width)))

    nodes = written(classes.select("h1", "h2", "node", "v", code("v").alias("code")), "nn-nodes")
    first = Window.partitionBy("h1", "h2").orderBy("key")
    few = rows.select("h1", "h2", "key").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= copies)
    few = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("key")).alias("ids"))
    nodes = written(nodes.join(few, ["h1", "h2"]), "nn-nodes")
    members = rows.select("key", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "key")
    return nodes.drop("h1", "h2"), members


FLAT = "u bigint, v bigint, sim double"


def _pairs(ids: np.ndarray, sims: np.ndarray, keep: np.ndarray) -> pd.DataFrame:
    i, j = np.nonzero(keep)
    return pd.DataFrame({"u": ids[i], "v": ids[j], "sim": sims[i, j]})


def _merged(flat: DataFrame, degree: int) -> DataFrame:
    """u, ids, sims, fresh: the ``degree`` most similar v of each u, and how many of them are not ``old``."""

    def run(frames):
        for frame, starts in sorted_groups(frames, "u"):
            u, v = frame["u"].to_numpy(), frame["v"].to_numpy()
            sim, old = frame["sim"].to_numpy(), frame["old"].to_numpy()
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            order = np.lexsort((~old, -sim, v, group))  # repeats of a pair side by side, the best first
            one = np.ones(len(order), bool)
            one[1:] = (group[order][1:] != group[order][:-1]) | (v[order][1:] != v[order][:-1])
            order = order[one]
            # an old pair found again counts as old
            known = np.maximum.reduceat(old[np.lexsort((~old, -sim, v, group))], np.flatnonzero(one)) if len(order) else old
            rank = np.lexsort((v[order], -sim[order], group[order]))
            order, known = order[rank], known[rank]
            counts = np.bincount(group[order], minlength=len(starts) - 1)
            at = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
            order, known = order[at < degree], known[at < degree]
            counts = np.minimum(counts, degree)
            ends = np.cumsum(counts)
            cut = list(zip(ends - counts, ends, strict=True))
            yield pd.DataFrame(
                {
                    "u": u[starts[:-1]], "ids": [v[order[a:b]] for a, b in cut], "sims": [sim[order[a:b]] for a, b in cut],
                    "fresh": [int((~known[a:b]).sum()) for a, b in cut],
                }
            )

    sorted_rows = flat.repartition("u").sortWithinPartitions("u")
    return sorted_rows.mapInPandas(run, "u bigint, ids array<bigint>, sims array<double>, fresh int")


def _edges(graph: DataFrame) -> DataFrame:
    pairs = F.explode(F.arrays_zip("ids", "sims")).alias("e")
    return graph.select("u", pairs).select("u", F.col("e.ids").alias("v"), F.col("e.sims").alias("sim"))


def _start(nodes: DataFrame, degree: int) -> DataFrame:
    """Each node with its nearest among those beside it in ORDERS random orders."""

    @F.pandas_udf("array<struct<t: int, bucket: int, place: double>>")
    def placed(codes: pd.Series) -> pd.Series:
        out: list = [None] * len(codes)
        sizes = codes.map(len)
        for size in sizes.unique():
            at = np.flatnonzero(sizes == size)
            x = decoded([codes.iloc[i] for i in at])
            planes = np.random.default_rng([SEED, int(size)]).standard_normal((ORDERS, x.shape[1], 9)).astype(np.float32)
            for i in at:
                out[i] = []
            for t in range(ORDERS):
                y = x @ planes[t]
                bucket = (y[:, 1:] > 0) @ (1 << np.arange(8))
                for k, i in enumerate(at):
                    out[i].append({"t": t, "bucket": int(bucket[k]), "place": float(y[k, 0])})
        return pd.Series(out)

    orders = nodes.select("node", "code", F.explode(placed("code")).alias("o")).select(
        "node", "code", "o.t", F.length("code").alias("d"), "o.bucket", "o.place"
    )
    orders = written(orders, "nn-orders")
    keys = ["t", "d", "bucket", "place", "node"]

    def compare(frames):
        left = None
        for frame in frames:
            left = frame if left is None else pd.concat([left, frame], ignore_index=True)
            while len(left) >= 2 * BLOCK:
                yield from near(left.iloc[:BLOCK])
                left = left.iloc[BLOCK:]
        if left is not None:
            yield from near(left)

    def near(block):
        for _, part in block.groupby(["t", "d"]):
            if len(part) < 2:
                continue
            ids, x = part["node"].to_numpy(), decoded(part["code"].tolist())
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            k = min(degree, len(part) - 1)
            keep = np.zeros(sims.shape, bool)
            np.put_along_axis(keep, np.argpartition(-sims, k - 1, axis=1)[:, :k], True, axis=1)
            yield _pairs(ids, sims, keep & (sims > -2))

    flat = orders.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(compare, FLAT)
    return written(_merged(flat.withColumn("old", F.lit(False)), degree), "nn-graph")


def _round(nodes: DataFrame, graph: DataFrame, degree: int) -> DataFrame:
    """The graph after neighbours of every node have been compared with each other."""
    edges = _edges(graph)
    named = edges.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / (2 * degree)).cast("int").alias("chunks"))
    named = written(named, "nn-named")
    own = graph.select("u", F.explode("ids").alias("member")).join(named, F.col("u") == F.col("v"), "left").select(
        F.col("u").alias("centre"), F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"), "member"
    )
    others = edges.join(named, "v").select(
        F.col("v").alias("centre"), F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int").alias("chunk"), F.col("u").alias("member")
    )
    worst = F.when(F.size("sims") >= degree, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("double")
    known = written(nodes.select("node", "code").join(graph.select(F.col("u").alias("node"), worst.alias("worst")), "node", "left"), "nn-known")
    met = own.unionByName(others).distinct().join(known, F.col("member") == F.col("node"))
    met = met.select(F.xxhash64("centre", "chunk").alias("group"), "member", "code", "worst")
    met = met.repartition("group").sortWithinPartitions("group")

    def compare(frames):
        for frame, starts in sorted_groups(frames, "group"):
            member, codes = frame["member"].to_numpy(), frame["code"].tolist()
            worst, out = frame["worst"].fillna(-2.0).to_numpy(np.float64), []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2 or len(set(map(len, codes[a:b]))) > 1:
                    continue
                x = decoded(codes[a:b])
                sims = x @ x.T
                out.append(_pairs(member[a:b], sims, (sims > worst[a:b, None]) & (member[a:b, None] != member[None, a:b])))
            if out:
                yield pd.concat(out, ignore_index=True)

    found = met.mapInPandas(compare, FLAT).withColumn("old", F.lit(False))
    return written(_merged(edges.withColumn("old", F.lit(True)).unionByName(found), degree), "nn-graph")


def build(nodes: DataFrame, degree: int = DEGREE) -> DataFrame:
    """The neighbour graph (u, ids, sims) of ``nodes``. Lists only ever get better, so they settle."""
    graph = _start(nodes, degree)
    while True:
        graph = _round(nodes, graph, degree)
        changed, entries = graph.agg(F.sum("fresh"), F.sum(F.size("ids"))).first()
        if not entries or changed < SETTLED * entries:
            return graph


def beam_for(n: int) -> int:
    """The beam's width for ``n`` nodes: it grows with their logarithm."""
    return BEAM + math.ceil(BEAM / 4 * math.log2(max(1.0, n / BEAM_NODES)))


def search(
    queries: DataFrame, starts: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, expanded: int = EXPANDED,
    degree: int = DEGREE,
) -> DataFrame:
    """(q, node) of the ``beam`` nearest nodes met by each query. ``queries``: q, code; ``starts``: q, node to begin at."""
    edges = _edges(graph)
    back = edges.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u")))
    back = back.filter(F.col("n") <= degree).select(F.col("v").alias("u"), F.col("u").alias("v"))
    links = written(edges.select("u", "v").unionByName(back).distinct(), "nn-links")
    codes = nodes.select("node", "code")
    state_columns = "q bigint, code binary, ids array<bigint>, sims array<double>, done array<boolean>, next array<bigint>"
    nothing = F.lit(None)
    state = queries.select(
        "q", "code", nothing.cast("array<bigint>").alias("ids"), nothing.cast("array<double>").alias("sims"),
        nothing.cast("array<boolean>").alias("done"),
    )
    wanted = starts.select("q", "node")

    def step(frames):
        for frame, bounds in sorted_groups(frames, "q"):
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = frame.iloc[a:b]
                own = part[part["is_state"].to_numpy()]
                if not len(own):
                    continue
                own, met = own.iloc[0], part[~part["is_state"].to_numpy()]
                ids = np.zeros(0, np.int64) if own["ids"] is None else np.asarray(own["ids"], np.int64)
                sims = np.zeros(0) if own["sims"] is None else np.asarray(own["sims"], np.float64)
                done = np.zeros(0, bool) if own["done"] is None else np.asarray(own["done"], bool)
                same = met["code"].map(len).to_numpy() == len(own["code"]) if len(met) else np.zeros(0, bool)
                new, at = np.unique(met["node"].to_numpy()[same], return_index=True)
                fresh = ~np.isin(new, ids)
                new, at = new[fresh], at[fresh]
                if len(new):
                    x = decoded([own["code"]])[0]
                    ids = np.concatenate([ids, new])
                    sims = np.concatenate([sims, decoded(met["code"][same].iloc[at].tolist()) @ x])
                    done = np.concatenate([done, np.zeros(len(new), bool)])
                    best = np.lexsort((ids, -sims))[:beam]
                    ids, sims, done = ids[best], sims[best], done[best]
                ahead = np.flatnonzero(~done)[:expanded]
                done = done.copy()
                done[ahead] = True
                out.append((own["q"], own["code"], ids, sims, done, ids[ahead]))
            yield pd.DataFrame(out, columns=["q", "code", "ids", "sims", "done", "next"])

    while True:
        met = wanted.join(codes, "node").select(
            "q", "code", nothing.cast("array<bigint>").alias("ids"), nothing.cast("array<double>").alias("sims"),
            nothing.cast("array<boolean>").alias("done"), "node", F.lit(False).alias("is_state"),
        )
        rows = state.select("q", "code", "ids", "sims", "done", nothing.cast("bigint").alias("node"), F.lit(True).alias("is_state")).unionByName(met)
        state = written(rows.repartition("q").sortWithinPartitions("q").mapInPandas(step, state_columns), "nn-search")
        if state.filter(F.size("next") > 0).isEmpty():
            return state.select("q", F.explode("ids").alias("node"))
        ahead = state.select("q", F.explode("next").alias("u"))
        seen = state.select("q", F.explode("ids").alias("node"))
        wanted = ahead.join(links, "u").select("q", F.col("v").alias("node")).distinct().join(seen, ["q", "node"], "left_anti")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", degree: int = DEGREE,
    beam: int | None = None,
) -> DataFrame:
    """For the rows that ``is_query`` says: query_id, rank (from 1), key, score of the k nearest other rows found."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"), is_query.alias("is_query"))
    nodes, members = nodes_of(rows, k + 2)
    graph = build(nodes, degree)
    # equal query vectors are searched for once
    wanted = members.join(rows.filter("is_query").select("key").distinct(), "key")
    wanted = written(wanted, "nn-wanted")
    asked = wanted.select(F.col("node").alias("q")).distinct()
    queries = written(asked.join(nodes.select(F.col("node").alias("q"), "code"), "q"), "nn-queries")
    starts = asked.join(graph.select(F.col("u").alias("q"), F.explode("ids").alias("node")), "q")
    starts = starts.unionByName(asked.select("q", F.col("q").alias("node")))
    found = search(queries, starts, nodes, graph, beam or beam_for(nodes.count()), degree=degree)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([cosine(np.asarray(x, np.float64), np.asarray(y, np.float64)) for x, y in zip(a, b, strict=True)])

    near = found.join(nodes.select("node", F.col("v").alias("b"), "ids"), "node").join(
        nodes.select(F.col("node").alias("q"), F.col("v").alias("a")), "q"
    )
    near = near.select("q", "ids", score("a", "b").alias("score"))
    # a node stands for its smallest ids: enough for k besides the query itself
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = near.select("q", "score", F.explode("ids").alias("id")).withColumn("n", F.row_number().over(order))
    near = written(near.filter(F.col("n") <= k + 1), "nn-near")
    best = wanted.join(near, F.col("node") == F.col("q")).filter("id <> key")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("key").alias("query_id"), "rank", F.col("id").alias(key), "score"
    )
