"""Removal of repeated passages: every byte covered by a ``LENGTH``-byte string that starts anywhere else in the corpus.

Method: suffix arrays by shards, by Larsson-Sadakane refinement (suffixes sorted by eight bytes, then the unsettled groups alone by
the ranks of the suffixes 8, 16, 32 ... bytes on), Kasai common prefixes (in the permuted order: a value is carried over from the text
position before while the preceding bytes agree, all others are compared). Neighbours with a common prefix of ``LENGTH`` are
repeated windows.

A shard is not a stretch of the corpus, since then every pair of shards would have to be merged. A window of ``LENGTH``
bytes belongs to the shard named by the least hash among its strings of ``GRAM`` bytes: equal windows have equal names, and
neighbouring windows mostly share theirs, so a text falls into runs of about 170 windows. Names that occur once are dropped
on counts alone; of the others each run goes to its shard with the bytes of its windows. Equal runs of a text (a line repeated many
times) are one row with all of their places; equal runs are counted before they are moved. The shards of the sorted runs of one task are told apart by binary search over their bounds. The runs of a name with
more than ``CHUNK`` different ones (a passage many texts share, each in its own surroundings) are not one shard: they are taken as texts of
their own and named anew by longer strings (64, 288, 363, 400 bytes), so that runs with foreign surroundings become
unique and go, and the rest spreads over more names. At ``LENGTH`` itself a name is one string (and only a string of one byte repeated has
several runs, ``RUN`` at most), so this ends there. Nothing is
dropped or capped, and no name, text or group of copies passes one task whole.

Equal texts are one class: its windows all repeat if it has two rows. Results: null is the empty text; texts shorter than
``LENGTH`` bytes lose nothing; repeated rows lose everything from that size on, ids do not matter; an empty table gives an
empty table; columns other than id and text are dropped.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.llm.common import per_worker, sorted_groups, written
from spindlewatch.llm.shingles import mixed

LENGTH = 400
GRAM = 64
#: Windows of a run, different runs of a name in one shard, bytes of one suffix array, bytes hashed at once.
RUN = 2048
CHUNK = 512
SHARD_BYTES = 1 << 20
BLOCK = 1 << 20


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``data`` (bytes) in their order."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    key = _words(data)[:n]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    h = 8
    at = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(at):
        pos = order[at]
        ahead = pos + h
        inside = ahead < n
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + h, h - 1 - (ahead - n))
        pair = (rank[pos] << 32) | second
        by = np.argsort(pair)
        pos, pair = pos[by], pair[by]
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        order[at] = pos
        rank[pos] = np.maximum.accumulate(np.where(first, at, 0))
        at = at[~(first & np.append(first[1:], True))]
        h *= 2
    return order


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number, zeros behind the end; eight more places than bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    key = np.zeros(n + 8, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n + 8]
    return key


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each suffix with the one before it in ``order`` (0 for the first)."""
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    at = np.arange(n)
    carried = (at > 0) & (before > 0)
    carried[carried] = data[at[carried] - 1] == data[before[carried] - 1]
    size = np.zeros(n, np.int64)
    i = np.flatnonzero(~carried & (before >= 0))
    j = before[i]
    left = n - np.maximum(i, j)
    words = _words(data)
    off = 0
    while len(i):
        x = words[i + off] ^ words[j + off]
        same = x == 0
        equal = np.full(len(i), 8)
        for b in range(8):
            equal -= x >= np.uint64(1 << (8 * b))
        size[i] = np.minimum(off + equal, left)
        go = same & (left > off + 8)
        i, j, left = i[go], j[go], left[go]
        off += 8
    base = np.maximum.accumulate(np.where(carried, 0, at))
    return (size[base] - (at - base))[order]


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram``-byte string of ``data``."""
    up, down, weight = per_worker(("grams", BLOCK), _tables)
    n = len(data) - gram + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(weight[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[gram:] - sums[:n]) * down[:n])


def _tables():
    base, size = 0x9E3779B97F4A7C15, BLOCK + 2 * LENGTH
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), mixed(np.arange(1, 257, dtype=np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _runs(data: np.ndarray, bounds: np.ndarray, gram: int):
    """(text, first window, window behind the last, name, whether its string lies there twice) of each run; text i is data[bounds[i] : bounds[i + 1]]."""
    width = LENGTH - gram + 1
    hashes = _hashes(data, gram)
    names = _least(hashes, width)
    n = len(names)
    begins, ends = bounds[:-1], bounds[1:] - LENGTH + 1
    edge = np.unique(np.concatenate([begins, ends, np.flatnonzero(names[1:] != names[:-1]) + 1, np.arange(0, n + 1, RUN), [n]]))
    edge = edge[(edge >= 0) & (edge <= n)]
    a, b = edge[:-1], edge[1:]
    text = np.searchsorted(bounds, a, side="right") - 1
    ok = a < ends[text]
    a, b, text = a[ok], b[ok], text[ok]
    # places of naming strings: those whose hash is the least of a window over them
    none = np.full(width - 1, np.iinfo(np.uint64).max)
    at = np.flatnonzero(hashes == ~_least(np.concatenate([none, ~names, none]), width))
    values, which = np.unique(hashes[at], return_inverse=True)
    known = np.sort(which * (len(data) + 1) + at)
    own = np.searchsorted(values, names[a]) * (len(data) + 1)
    twice = np.searchsorted(known, own + b + width - 1) - np.searchsorted(known, own + a) > 1
    return text, a - bounds[text], b - bounds[text], names[a].view(np.int64), twice


def _by_name(a: np.ndarray, b: np.ndarray, name: np.ndarray, twice: np.ndarray):
    """(different names, how often each names a run or lies twice in one, its runs packed as pairs of first and behind last window) of a text."""
    by = np.argsort(name, kind="stable")
    name = name[by]
    heads = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])[: len(name)])
    times = np.add.reduceat(1 + twice[by], heads) if len(heads) else heads
    packed = np.column_stack([a[by], b[by]]).astype("<i4").tobytes()
    edges = [*(8 * heads).tolist(), len(packed)]
    return name[heads], times.astype(np.int64), [packed[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]


def _to_runs(gram: int):
    """The runs of each text, texts hashed together; long ones by overlapping blocks."""

    def short(rows):
        joined = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        bounds = np.cumsum([0] + [len(r[3]) for r in rows])
        text, a, b, name, twice = _runs(joined, bounds, gram)
        cut = np.searchsorted(text, np.arange(len(rows) + 1))
        return [(*r[:3], *_by_name(a[x:y], b[x:y], name[x:y], twice[x:y])) for r, x, y in zip(rows, cut[:-1], cut[1:], strict=True)]

    def long(row):
        data = np.frombuffer(row[3], np.uint8)
        parts = []
        for begin in range(0, len(data) - LENGTH + 1, BLOCK):
            piece = data[begin : begin + BLOCK + LENGTH - 1]
            _, a, b, name, twice = _runs(piece, np.array([0, len(piece)]), gram)
            parts.append((a + begin, b + begin, name, twice))
        return (*row[:3], *_by_name(*(np.concatenate(p) for p in zip(*parts, strict=True))))

    def run(frames):
        for frame in frames:
            done, held, size = [], [], 0
            for row in zip(frame["h1"], frame["h2"], frame["n"], frame["bytes"], strict=True):
                if len(row[3]) > BLOCK:
                    done.append(long(row))
                    continue
                if size + len(row[3]) > BLOCK and held:
                    done += short(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
            if held:
                done += short(held)
            if done:
                yield pd.DataFrame(done, columns=["h1", "h2", "n", "names", "times", "places"])

    return run


def _to_contexts(frames):
    """The bytes of each different run of a text that may repeat and all of its places, its digest in place of them where the batch had it before."""
    for frame in frames:
        seen: set[bytes] = set()
        rows = []
        for h1, h2, n, data, names, places in zip(*(frame[c] for c in ("h1", "h2", "n", "bytes", "names", "places")), strict=True):
            for name, packed in zip(names.tolist(), places, strict=True):
                own: dict[bytes, list[int]] = {}
                for a, b in struct.iter_unpack("<ii", packed):
                    piece = data[a : b + LENGTH - 1]
                    digest = xxhash.xxh3_128_digest(piece)
                    if digest in own:
                        own[digest].append(a)
                        continue
                    own[digest] = [a]
                    rows.append((h1, h2, n, own[digest], name, digest, None if digest in seen else piece))
                    seen.add(digest)
        if rows:
            yield pd.DataFrame(rows, columns=["h1", "h2", "n", "at", "name", "digest", "piece"])


def repeated(pieces: list[bytes], weights: np.ndarray):
    """The windows of a shard: (places, group, total weight of each group) and where each piece begins; a place's windows are its piece's."""
    sizes = np.array([len(p) for p in pieces])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    order = suffix_array(data)
    group = np.cumsum(common_prefixes(data, order) < LENGTH) - 1
    of = np.repeat(np.arange(len(pieces)), sizes)
    window = (np.arange(len(data)) - begins[of]) <= (sizes[of] - LENGTH)
    is_window = window[order]
    places, group = order[is_window], group[is_window]
    group = np.unique(group, return_inverse=True)[1] if len(group) else group
    return places, group, np.bincount(group, weights=weights[of[places]]), begins


def _ranges(places: np.ndarray, begins: np.ndarray):
    """(piece, first, behind last) of consecutive places in a piece."""
    places = np.sort(places)
    of = np.searchsorted(begins, places, side="right") - 1
    cut = np.flatnonzero((np.diff(places) != 1) | (np.diff(of) != 0)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(places)]]) - 1
    return of[first], places[first] - begins[of[first]], places[last] - begins[of[first]] + 1


def _to_found(frames):
    """Windows that repeat within a shard, as ranges of each of its runs."""

    def solve(part: pd.DataFrame):
        pieces = part["piece"].tolist()
        places, group, total, begins = repeated(pieces, part["weight"].to_numpy(np.float64))
        again = places[total[group] >= 2]
        if len(again):
            of, a, b = _ranges(again, begins)
            name, digest = part["name"].to_numpy(), part["digest"].to_numpy()
            yield pd.DataFrame({"name": name[of], "digest": digest[of], "start": a, "stop": b})

    for whole, starts in sorted_groups(frames, "name"):
        size = np.concatenate([[0], np.cumsum([len(p) for p in whole["piece"]])])
        begin = starts[0]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a > begin and size[b] - size[begin] > SHARD_BYTES:
                yield from solve(whole.iloc[begin:a])
                begin = a
        if starts[-1] > begin:
            yield from solve(whole.iloc[begin : starts[-1]])


def _to_kept(frames):
    for frame in frames:
        rows = []
        for h1, h2, n, data, starts, stops in zip(*(frame[c] for c in ("h1", "h2", "n", "bytes", "starts", "stops")), strict=True):
            if n > 1 and len(data) >= LENGTH:
                spans = [(0, len(data))]
            elif starts is None or not len(starts):
                spans = []
            else:
                by = np.argsort(starts, kind="stable")
                a, b = np.asarray(starts)[by], np.maximum.accumulate(np.asarray(stops)[by] + LENGTH - 1)
                head = np.concatenate([[True], a[1:] > b[:-1]])
                spans = list(zip(a[head].tolist(), b[np.append(np.flatnonzero(head)[1:], len(a)) - 1].tolist(), strict=True))
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rows.append((h1, h2, len(data), [s[0] for s in spans], [s[1] for s in spans], b"".join(kept)))
        if rows:
            yield pd.DataFrame(rows, columns=["h1", "h2", "n_bytes", "starts", "stops", "kept"])


def _longer(gram: int) -> int:
    """Two thirds of the way to ``LENGTH``; all of it when little is left."""
    left = LENGTH - gram
    return LENGTH if left <= LENGTH // 10 else LENGTH - left // 3


def repeats(texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """(h1, h2, starts, stops): the windows of each text that start anywhere else too, for texts (h1, h2, n, bytes) with n = 1."""
    runs = written(
        texts.filter(F.octet_length("bytes") >= LENGTH).mapInPandas(
            _to_runs(gram), "h1 bigint, h2 bigint, n bigint, names array<bigint>, times array<bigint>, places array<binary>"
        ),
        "suffix-runs",
    )
    shared = written(
        runs.select("n", F.explode(F.arrays_zip("names", "times")).alias("r")).groupBy(F.col("r.names").alias("name"))
        .agg(F.sum("r.times").alias("c"), F.min("n").alias("least")).filter("c > 1 and least = 1").select("name", "c"),
        "suffix-shared",
    )
    wanted = (
        runs.select("h1", "h2", F.explode(F.arrays_zip("names", "places")).alias("r"))
        .select("h1", "h2", F.col("r.names").alias("name"), "r.places").join(shared.select("name"), "name")
        .groupBy("h1", "h2").agg(F.collect_list("name").alias("names"), F.collect_list("places").alias("places"))
    )
    contexts = written(
        texts.join(wanted, ["h1", "h2"]).mapInPandas(
            _to_contexts, "h1 bigint, h2 bigint, n bigint, at array<int>, name bigint, digest binary, piece binary"
        ),
        "suffix-contexts",
    )
    pieces = contexts.groupBy("name", "digest").agg(F.sum(F.col("n") * F.size("at")).alias("weight"), F.first("piece", True).alias("piece"))
    many = shared.filter(F.col("c") > CHUNK).select("name")
    split = gram < LENGTH and not many.isEmpty()
    if split:
        crowded = written(
            contexts.select("name", "digest").join(many, "name", "left_semi").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("runs"))
            .filter(F.col("runs") > CHUNK).select("name"),
            "suffix-crowded",
        )
        split = not crowded.isEmpty()
    shards = (pieces.join(crowded, "name", "left_anti") if split else pieces).repartition("name").sortWithinPartitions("name")
    flags = written(shards.mapInPandas(_to_found, "name bigint, digest binary, start int, stop int"), "suffix-found").groupBy("name", "digest").agg(
        F.collect_list("start").alias("from"), F.collect_list("stop").alias("to")
    )
    if split:
        own = [F.xxhash64(F.lit(seed), "name", "digest").alias(f"h{seed}") for seed in (1, 2)]
        again = written(
            pieces.join(crowded, "name", "left_semi").select("name", "digest", *own, F.col("weight").alias("n"), F.col("piece").alias("bytes")),
            "suffix-again",
        )
        inside = repeats(again.select("h1", "h2", "n", "bytes"), _longer(gram))
        every = F.array(F.octet_length("bytes") - LENGTH + 1)
        flags = flags.unionByName(again.filter("n > 1").select("name", "digest", F.array(F.lit(0)).alias("from"), every.alias("to"))).unionByName(
            again.join(inside, ["h1", "h2"]).select("name", "digest", F.col("starts").alias("from"), F.col("stops").alias("to"))
        )

    def moved(column: str):
        return F.flatten(F.transform("at", lambda a: F.transform(column, lambda x: x + a)))

    return (
        contexts.filter("n = 1").select("h1", "h2", "at", "name", "digest").join(flags, ["name", "digest"])
        .select("h1", "h2", moved("from").alias("starts"), moved("to").alias("stops"))
        .groupBy("h1", "h2").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops"))
    )


def classes_and_members(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per different text: h1, h2, n_bytes, starts and stops of what goes, kept bytes; per row: key, h1, h2)."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key), data.alias("bytes")).select(
        key, "bytes", *(F.xxhash64(F.lit(seed), "bytes").alias(f"h{seed}") for seed in (1, 2))
    )
    members = rows.select(key, "h1", "h2")
    classes = written(
        rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes")), "suffix-classes"
    )
    cover = repeats(classes)
    kept = classes.join(cover, ["h1", "h2"], "left").mapInPandas(
        _to_kept, "h1 bigint, h2 bigint, n_bytes bigint, starts array<int>, stops array<int>, kept binary"
    )
    return kept, members


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, starts and stops of the removed spans, and kept, the bytes left."""
    kept, members = classes_and_members(docs, key, text)
    return members.join(kept, ["h1", "h2"]).drop("h1", "h2")
