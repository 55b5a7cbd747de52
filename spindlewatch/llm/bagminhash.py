"""Near-duplicate texts by weighted MinHash over word-shingle multisets: BagMinHash signatures, banding, verification.

Signatures: each distinct shingle carries independent Poisson processes over the weight intervals [0, 1), [1, 2), [2, 4),
[4, 8) ..., whose points have a time, a signature slot and a position inside the interval (a path down the binary
subdivision of the interval). A point counts if its position lies below the shingle's multiplicity; a slot keeps its earliest
point. Two multisets agree in a slot with a probability of exactly their weighted Jaccard similarity. Points come in
order of time, so only those up to a limit are made at which, nearly always, every slot is filled; the few texts
that have a slot left get a doubled limit.

Candidates: texts that share a band of ``ROWS`` slots are compared by whole signatures, block by block. Those that
may reach the threshold (within ``MARGIN`` of it) form candidate groups by connected components. Within a group every
pair is verified by exact multiset overlap, again in blocks, which report one edge a text. Neither pairs of documents nor
a whole group are ever emitted; large buckets and groups are split into blocks of two chunks, so every pair is compared.

Texts that are equal are one class; signatures, buckets and blocks hold classes (64-bit text hashes), not documents.

Defined results: texts that are null or have no word are in no group; a text of one to four words has one
shingle of them all; repeated rows are copies of each other; a pair exactly at the threshold is missed with a probability
of about 3e-6; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindlewatch.llm.common import sorted_groups, written
from spindlewatch.llm.components import components
from spindlewatch.llm.shingles import mixed, multiset, shingles

THRESHOLD = 0.8
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Five standard deviations of a signature's estimate at the threshold.
MARGIN = 5 * (THRESHOLD * (1 - THRESHOLD) / SLOTS) ** 0.5
#: Classes compared with each other in one block; larger buckets and groups take several blocks.
BLOCK = 768
#: Expected points of a text for each slot, beyond the logarithm of the slots.
SLACK = 3.0
MASK = (1 << 64) - 1


def _streams(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray):
    """One Poisson process for each shingle and weight interval that begins below its weight."""
    parts = [(hashes, weights, owner, np.zeros(len(hashes), np.int64), np.ones(len(hashes), np.int64))]
    low = 1
    at = np.flatnonzero(weights > low)
    while len(at):
        size = max(1, low)
        seeds = mixed(hashes[at] + np.uint64(low * 0xD1B54A32D192ED03 & MASK))
        parts.append((seeds, weights[at], owner[at], np.full(len(at), low), np.full(len(at), size)))
        low += size
        at = at[weights[at] > low]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` 64-bit values for each multiset (hashes, counts); rows of empty ones are zero."""
    times = np.full((len(bags), slots), np.inf)
    total = np.array([float(c.sum()) for _, c in bags])
    limit = (np.log(slots) + SLACK) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        hashes = np.concatenate([bags[i][0] for i in todo])
        counts = np.concatenate([bags[i][1] for i in todo]).astype(np.int64)
        owner = np.repeat(todo, [len(bags[i][0]) for i in todo])
        seed, weight, own, low, size = _streams(hashes, counts, owner)
        t, k = np.zeros(len(seed)), 0
        while len(seed):
            k += 1
            u = mixed(seed + np.uint64(k * 0x9E3779B97F4A7C15 & MASK))
            t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / (slots * size)
            live = t <= limit[own]
            seed, weight, own, low, size, t, u = (x[live] for x in (seed, weight, own, low, size, t, u))
            v = mixed(u + np.uint64(0x8CB92BA72F3D8DD7))
            place = low + ((v >> np.uint64(20)) % size.astype(np.uint64)).astype(np.int64)
            ok = place < weight
            np.minimum.at(times.reshape(-1), own[ok] * slots + (v[ok] & np.uint64(0xFFFFF)).astype(np.int64) * slots // (1 << 20), t[ok])
        limit[todo] *= 2
        todo = todo[np.isinf(times[todo]).any(axis=1)]
    out = mixed(np.where(np.isinf(times), 0.0, times).view(np.uint64))
    out[total == 0] = 0
    return out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def _similarities(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs: repeats become elements of their own, and a product of 0/1 matrices
    over the elements that at least two texts hold counts what they share."""
    n = len(bags)
    elements, owner = [], []
    for i, (hashes, counts) in enumerate(bags):
        elements.append(hashes)
        for k in range(1, int(counts.max(initial=1))):
            more = hashes[counts > k]
            elements.append(mixed(more + np.uint64(k)))
        owner.append(np.full(int(counts.sum()), i))
    elements, owner = np.concatenate(elements), np.concatenate(owner)
    _, number, seen = np.unique(elements, return_inverse=True, return_counts=True)
    shared = seen > 1
    column = np.cumsum(shared) - 1
    keep = shared[number]
    number, owner = column[number[keep]], owner[keep]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    both = np.zeros((n, n), np.float64)
    width = max(1, (1 << 22) // n)
    for begin in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(number, [begin, begin + width])
        x = np.zeros((n, width), np.float32)
        x[owner[a:b], number[a:b] - begin] = 1
        both += x @ x.T
    size = np.array([float(c.sum()) for _, c in bags])
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def _lowest(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each position the lowest id it reaches over the pairs of a symmetric matrix."""
    i, j = np.nonzero(near)
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        if (new == low).all():
            return low
        low = new


def _edges(near: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    low = _lowest(near, ids)
    at = low < ids
    return pd.DataFrame({"a": ids[at], "b": low[at]})


def _in_blocks(rows: DataFrame, group: str, chunks: str) -> DataFrame:
    """Rows (c, ``group``, ``chunks``, ...) repeated so that any two of a group meet in one ``block``; sorted by it.

    A group of k chunks makes k * (k + 1) / 2 blocks; each row goes to k of them.
    """
    own = F.pmod(F.xxhash64("c", F.lit(3)), F.col(chunks)).cast("int")
    pairs = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(chunks) - 1)))
    block = F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))
    return pairs.withColumn("block", block).drop("own", "other", chunks).repartition("block").sortWithinPartitions("block")


def _chunks(n):
    return F.ceil(F.col(n) * 2 / BLOCK).cast("int")


def text_class(text: str):
    """The class of a text: its hash; null for null."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text).cast("string")))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct texts with a word: c (hash), rep (smallest key), signature (a byte a slot), bands (a hash each)."""

    def run(frames):
        for frame in frames:
            bags = [multiset(s) for s in shingles(frame["text"].tolist())]
            values = signatures(bags)
            rows = np.array([len(h) > 0 for h, _ in bags], bool)
            joined = np.zeros((len(bags), BANDS), np.uint64)
            for r in range(ROWS):
                joined = mixed(joined * np.uint64(0xD1B54A32D192ED03) + values[:, r::ROWS][:, :BANDS])
            joined = mixed(joined + np.arange(BANDS, dtype=np.uint64)[None, :])
            small = (values & np.uint64(0xFF)).astype(np.uint8)
            yield pd.DataFrame(
                {
                    "c": frame["c"][rows], "key": frame["key"][rows], "signature": [x.tobytes() for x in small[rows]],
                    "bands": list(joined[rows].view(np.int64)),
                }
            )

    rows = docs.select(text_class(text).alias("c"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("text IS NOT NULL").mapInPandas(run, f"c bigint, key {docs.schema[key].dataType.simpleString()}, signature binary, bands array<bigint>")
    return rows.groupBy("c").agg(F.min("key").alias("rep"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))


def candidate_groups(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(c, group) of classes that may have a near duplicate, by signatures of classes that share a band."""
    bands = found.select("c", F.explode("bands").alias("band"))
    # most buckets hold a single class; those go before signatures are moved
    shared = written(
        bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", _chunks("n").alias("chunks")),
        "minhash-buckets",
    )
    # joined by sorting, whatever their size: both sides grow with the documents
    rows = bands.join(shared.hint("merge"), "band").join(found.select("c", "signature").hint("merge"), "c")
    least = threshold - MARGIN

    def compare(frames):
        for frame, starts in sorted_groups(frames, "block"):
            out = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2:
                    continue
                ids = frame["c"].to_numpy()[a:b]
                sig = np.frombuffer(b"".join(frame["signature"].iloc[a:b]), np.uint8).reshape(b - a, SLOTS)
                if b - a == 2:
                    if (sig[0] == sig[1]).mean() >= least:
                        out.append(pd.DataFrame({"a": [max(ids)], "b": [min(ids)]}))
                    continue
                near = np.zeros((b - a, b - a), np.int32)
                for s in range(SLOTS):
                    near += sig[:, s][:, None] == sig[:, s][None, :]
                out.append(_edges(near >= least * SLOTS, ids))
            if out:
                yield pd.concat(out, ignore_index=True)

    blocks = _in_blocks(rows, "band", "chunks").select("c", "signature", "block")
    edges = blocks.mapInPandas(compare, "a bigint, b bigint").distinct()
    return components(edges).select(F.col("node").alias("c"), F.col("component").alias("group"))


def verified_links(
    docs: DataFrame, found: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Edges (a, b) of classes that connect what exact overlap links within each candidate group."""
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).select("group", _chunks("n").alias("chunks"))
    wanted = written(groups.join(sizes, "group").join(found.select("c", "rep"), "c"), "minhash-wanted")
    texts = docs.select(text_class(text).alias("c"), F.col(key).alias("rep"), F.col(text).cast("string").alias("text"))
    rows = texts.join(wanted.hint("merge"), ["c", "rep"]).select("c", "text", "group", "chunks")

    def verify(frames):
        for frame, starts in sorted_groups(frames, "block"):
            bags = [multiset(s) for s in shingles(frame["text"].tolist())]
            out = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                ids = frame["c"].to_numpy()[a:b]
                if b - a < 2:
                    continue
                if b - a == 2:
                    if ids[0] != ids[1] and overlap(bags[a], bags[a + 1]) >= threshold:
                        out.append(pd.DataFrame({"a": [max(ids)], "b": [min(ids)]}))
                    continue
                out.append(_edges(_similarities(bags[a:b]) >= threshold, ids))
            if out:
                yield pd.concat(out, ignore_index=True)

    blocks = _in_blocks(rows, "group", "chunks").select("c", "text", "block")
    return blocks.mapInPandas(verify, "a bigint, b bigint").distinct()


def _labelled(docs: DataFrame, threshold: float, key: str, text: str) -> DataFrame:
    """Per document: key, c, rep (smallest key of equal texts), first (smallest key of the component)."""
    found = written(classes(docs, key, text), "minhash-classes")
    groups = written(candidate_groups(found, threshold), "minhash-groups")
    linked = components(verified_links(docs, found, groups, threshold, key, text))
    known = found.select("c", "rep").join(linked, F.col("c") == F.col("node"), "left")
    known = written(known.select("c", "rep", F.coalesce("component", "c").alias("component")), "minhash-known")
    first = known.groupBy("component").agg(F.min("rep").alias("first"))
    named = written(known.join(first, "component").select("c", "rep", "first"), "minhash-named")
    rows = docs.select(F.col(key).alias("key"), text_class(text).alias("c")).join(named, "c", "left")
    return rows.select("key", "c", F.coalesce("rep", "key").alias("rep"), F.coalesce("first", "key").alias("first"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, class_id (smallest key of equal texts), component_id (smallest key reachable over links), kept."""
    return _labelled(docs, threshold, key, text).select(
        F.col("key").alias(key), F.col("rep").alias("class_id"), F.col("first").alias("component_id"),
        F.col("key").eqNullSafe(F.col("first")).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each near-duplicate group keeps the one of the smallest key; all their columns.

    Of rows with equal key and text one stays. Rows without a key cannot be named, and stay.
    """
    labelled = _labelled(docs, threshold, key, text).filter("key IS NOT NULL AND key = first")
    kept = labelled.select(F.col("key").alias("__key"), F.coalesce("c", F.lit(0)).alias("__c")).distinct()
    own = docs.filter(F.col(key).isNotNull()).withColumns({"__key": F.col(key), "__c": F.coalesce(text_class(text), F.lit(0))})
    # joined by sorting, whatever the size, and numbered within the same partitions
    rows = own.join(kept.hint("merge"), ["__key", "__c"])
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__key", "__c").orderBy("__key")))
    return rows.filter("__n = 1").select(docs.columns).unionByName(docs.filter(F.col(key).isNull()))
