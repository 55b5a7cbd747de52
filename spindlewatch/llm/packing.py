"""Packing of token sequences into fixed windows, planned by non-negative least squares on the length histogram.

Method: every document's ids and an end id are cut into full windows and a rest. Only the histogram of the rests (at
most ``window`` numbers) reaches the driver. There, shallow combinations of lengths that fill a window exactly are
enumerated; non-negative least squares finds how often to repeat each so that the histogram is matched; the counts
are rounded down and a greedy pass fills up with what is left. The residual, in order of length, is laid end to end
and cut at window boundaries; its last, shorter window is split into powers of two. So no padding is needed.

The plan says for each length which ranks among the pieces of that length go where, so pieces are placed by a lookup:
ranks are counted by task and length, never by sorting one length in one place.

Defined results: a null text counts as empty and still has its end id; repeated rows are separate documents; null keys
are kept; an empty table gives an empty table; columns other than key and text are dropped. Texts of any length are
encoded whole. Which of equally long pieces goes where depends on the order of the input files.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindlewatch.llm.common import written
from spindlewatch.llm.word_ids import coder

WINDOW = 2048
END_ID = 1
#: Ways to split what one length leaves of a window between two more lengths.
TRIPLE_SPLITS = 6
ROUNDS = 400


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Combinations of at most three present lengths, each repeated k times, that fill a window: rows of 3 lengths, 0 for none.

    Repetitions of one length, all pairs, and for each length TRIPLE_SPLITS ways to split the rest in two.
    """
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    found = {(int(v),) for v in lengths if window % v == 0}
    found |= {(int(a), int(window - a)) for a in lengths if a * 2 < window and present[window - a]}
    for a in map(int, lengths):
        rest = window - a
        for j in range(1, TRIPLE_SPLITS + 1):
            b = rest * j // (2 * TRIPLE_SPLITS)
            if b > 0 and rest - b > 0 and present[b] and present[rest - b]:
                found.add(tuple(sorted((a, b, rest - b))))
    out = np.zeros((len(found), 3), np.int64)
    for i, c in enumerate(sorted(found)):
        out[i, : len(c)] = c
    return out


def solve(patterns: list[dict[int, int]], histogram: np.ndarray) -> np.ndarray:
    """x >= 0 with the least squares of A x - histogram; A's columns hold how often a pattern uses each length.

    Projected accelerated gradient; its step is the inverse of a bound on A's largest squared singular value.
    """
    if not patterns:
        return np.zeros(0)
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([v for p in patterns for v in p])
    val = np.array([n for p in patterns for n in p.values()], dtype=float)

    def forward(x):
        return np.bincount(row, weights=val * x[col], minlength=len(histogram))

    def back(r):
        return np.bincount(col, weights=val * r[row], minlength=len(patterns))

    probe = np.ones(len(patterns))
    for _ in range(30):
        probe = back(forward(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1 / (1.1 * norm)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0.0, y - step * back(forward(y) - histogram))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go, by their rank among them.

    Entry i holds ranks from ``low[i]`` of length ``size[i]``: ``each[i]`` of them a window, from window ``base[i]``
    and place ``place[i]`` on. Ranks from ``tail_low[l]`` on lie in the residual, from its token ``tail_at[l]`` on,
    which is cut at ``bounds``: full windows, then powers of two.
    """

    window: int
    size: np.ndarray
    low: np.ndarray
    each: np.ndarray
    base: np.ndarray
    place: np.ndarray
    tail_low: np.ndarray
    tail_at: np.ndarray
    tail_base: int
    tail_full: int
    tail_bounds: np.ndarray

    def locate(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window number, place, position in the residual or -1) of pieces by length and rank."""
        tail = rank >= self.tail_low[size]
        at = np.where(tail, self.tail_at[size] + (rank - self.tail_low[size]) * size, -1)
        wide = np.int64(1) << np.int64(48)
        i = np.searchsorted(self.size * wide + self.low, size * wide + rank, side="right") - 1
        i = np.where(tail, 0, i) if len(self.size) else np.zeros(len(size), np.int64)
        if not len(self.size):
            return np.zeros_like(rank), np.zeros_like(rank), at
        k = rank - self.low[i]
        return self.base[i] + k // self.each[i], self.place[i] + k % self.each[i] * size, at

    def cut(self, at: int, size: int) -> list[tuple[int, int, int, int]]:
        """(window number, place, first id of the piece, ids) of a residual piece at position ``at``."""
        out, done = [], 0
        while done < size:
            here = at + done
            if here < self.tail_full:
                begin = here // self.window * self.window
                end, number = begin + self.window, here // self.window
            else:
                k = int(np.searchsorted(self.tail_bounds, here, side="right")) - 1
                begin, end = int(self.tail_bounds[k]), int(self.tail_bounds[k + 1])
                number = self.tail_full // self.window + k
            n = min(size - done, end - here)
            out.append((self.tail_base + number, here - begin, done, n))
            done += n
        return out


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan of a histogram: ``histogram[l]`` pieces of length l, for l up to ``window``."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    entries, base = [], 0

    def take(pattern: dict[int, int], times: int) -> None:
        nonlocal base
        place = 0
        for length, n in pattern.items():
            entries.append((length, int(used[length]), n, base, place))
            used[length] += n * times
            left[length] -= n * times
            place += n * length
        base += times

    if left[window]:
        take({window: 1}, int(left[window]))
    lengths = np.flatnonzero(left[:window])
    patterns = []
    for row in combinations(lengths, window):
        pattern: dict[int, int] = {}
        for v in row[row > 0]:
            pattern[int(v)] = pattern.get(int(v), 0) + 1
        if len(pattern) == 1:
            pattern = {v: window // v for v in pattern}
        patterns.append(pattern)
    wanted = np.floor(solve(patterns, left.astype(float)) + 1e-6).astype(np.int64)
    order = np.argsort(-wanted, kind="stable")
    for share in (wanted, None):  # the rounded counts, then greedily whatever still fits
        for i in order:
            most = min(left[v] // n for v, n in patterns[i].items())
            times = int(most if share is None else min(most, share[i]))
            if times:
                take(patterns[i], times)
    at = np.concatenate([[0], np.cumsum(left * np.arange(window + 1))])
    total = int(at[-1])
    full = total // window * window
    bounds = [full]
    for bit in range(window.bit_length() - 1, -1, -1):
        if (total - full) >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    entries.sort()
    columns = np.array(entries, dtype=np.int64).reshape(-1, 5).T
    return Plan(window, *columns, used, at[:-1], base, full, np.array(bounds))


def _pieces(docs: DataFrame, path: str, key: str, text: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Documents cut into full windows and a rest: part, row, nth (of its length in the part), start, length, crc, ids."""

    def run(frames):
        part = TaskContext.get().partitionId()
        words = coder(path)
        seen = np.zeros(window + 1, np.int64)
        row = 0
        for frame in frames:
            out = []
            for name, ids in zip(frame["key"], words.encode([t or "" for t in frame["text"]]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n = len(piece)
                    kept = piece.tobytes() if keep_ids or n < window else None
                    out.append((name, part, row, int(seen[n]), start, n, zlib.crc32(piece), len(ids), kept))
                    seen[n] += 1
                    row += 1
            yield pd.DataFrame(
                out, columns=["key", "part", "row", "nth", "start", "length", "crc", "doc_tokens", "ids"]
            ).astype({"key": frame["key"].dtype})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(
        run, f"key {kind}, part int, row bigint, nth bigint, start bigint, length int, crc bigint, doc_tokens bigint, ids binary"
    )


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset; and its ids (4 bytes each) if asked for."""
    pieces = written(_pieces(docs, path, key, text, window, end_id, keep_ids), "pack-pieces")
    histogram = np.zeros(window + 1, np.int64)
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    layout = plan(histogram, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.drop("ids").join(bases, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    columns = ["key", "part", "row", "start", "length", "crc", "doc_tokens", "sequence_id", "offset", "skip"]

    def place(frames):
        for frame in frames:
            number, offset, at = layout.locate(frame["length"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64))
            frame = frame.assign(sequence_id=number, offset=offset, skip=0, at=at)
            yield frame[frame["at"] < 0][columns]
            rest = []
            for r in frame[frame["at"] >= 0].itertuples():
                cuts = layout.cut(r.at, r.length)
                for number, offset, skip, n in cuts:
                    crc = r.crc if len(cuts) == 1 else None
                    rest.append((r.key, r.part, r.row, r.start + skip, n, crc, r.doc_tokens, number, offset, skip))
            if rest:
                yield pd.DataFrame(rest, columns=columns).astype({"crc": "Int64", "key": frame["key"].dtype})

    kind = docs.schema[key].dataType.simpleString()
    placed = written(
        ranked.mapInPandas(
            place,
            f"key {kind}, part int, row bigint, start bigint, length bigint, crc bigint, doc_tokens bigint, "
            "sequence_id bigint, offset bigint, skip bigint",
        ),
        "pack-placed",
    )
    ids = pieces.select("part", "row", "ids")

    @F.pandas_udf("binary")
    def part_of(ids, skip, n):
        return pd.Series([i[4 * s : 4 * (s + k)] for i, s, k in zip(ids, skip, n, strict=True)])

    def with_ids(rows: DataFrame) -> DataFrame:
        return rows.join(ids, ["part", "row"]).withColumn("ids", part_of("ids", "skip", "length"))

    own = ["key", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    cut = with_ids(placed.filter("crc IS NULL")).withColumn("crc", F.crc32("ids"))
    whole = placed.filter("crc IS NOT NULL")
    out = (with_ids(whole) if keep_ids else whole).select(own).unionByName(cut.select(own))
    return out.withColumnsRenamed({"key": key, "crc": "ids_crc32"})


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed sequences of ``pack(..., keep_ids=True)``: sequence_id, length, ids (4 bytes each), padded to the window
    unless the length is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p")
    )
    length = F.aggregate("p", F.lit(0).cast("bigint"), lambda n, p: n + p["length"])
    rows = joined.select("sequence_id", length.alias("length"), F.transform("p", lambda p: p["ids"]).alias("parts"))

    @F.pandas_udf("binary")
    def padded(parts, length):
        pad = int(pad_id).to_bytes(4, "little")
        return pd.Series(
            [b"".join(p) + pad * (0 if n & (n - 1) == 0 else window - n) for p, n in zip(parts, length, strict=True)]
        )

    return rows.select("sequence_id", "length", padded("parts", "length").alias("ids"))
