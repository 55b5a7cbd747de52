"""Conversation structure repair: the cheapest edits that turn a conversation into ``system? (user assistant)+``, or nothing.

Rows of a conversation are taken by turn (nulls first; equal turns by role, then text). A row's first fault counts: *blank* (no
character but spaces, tabs and line ends), *duplicate* (role and text seen earlier in the conversation), *truncated* (the last
such character is not ``.``, ``!`` or ``?``). Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (the only edit of
blank and duplicate rows), Insert an empty user or assistant row 2; a truncated row that stays adds 1. Of the cheapest edit
strings over ``DIKR`` the ASCII-least is taken.

Method: a square-root checkpointed dynamic program. A state is the last role given out (none, s, u, a); the backward vector of
a place holds the least cost from each state to the end. Conversations are cut into blocks of at most ``BLOCK`` rows in their
order. Each block reports the least cost from every state before it to every state after it; a pass from the end composes these
to the vectors at block ends, the only ones stored for a whole conversation. Inside a block a backward pass stores vectors at
every sqrt(n)-th row only, and a walk forward recomputes one such stretch at a time and emits the ASCII-least tight edit. The
walk is done from all four states, so blocks are independent; a last pass chains them. A conversation of any length is thus
spread over tasks; only its block summaries, and the running digest of ``reports``, pass one task, as a stream.

Equal rows (same turn, role and text) are counted before any shuffle and stand in one row: the first is treated as such, all
others are deletes right behind it. Results: null role and text are one space; a null conversation id is a conversation of its
own; an empty table gives an empty table; columns other than the four named are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.llm.common import written

BLOCK = 4096
BLOCK_CHARS = 1 << 20
#: What a user may type between words.
BLANK = r"\x20\x09-\x0D"
_FAR = 1 << 60
#: States: 0 nothing yet, 1 system, 2 user, 3 assistant. State after an inserted or reroled row; state after keeping s, u, a.
_NEXT = (2, 2, 3, 2)
_KEEP = ((None, None, None, None), (1, None, None, None), (2, 2, None, 2), (None, None, 3, None))
_NAMES = {2: "user", 3: "assistant"}
_MUST, _CUT = 4, 8
END = (0, 4, 2, 0)


def damage(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults put in by crc32(``conversation:turn``) % 20: 0 drops, 1 empties, 2 takes ends of sentences out, 3 repeats, 4 says user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conversation, turn)))
    fate = F.crc32(key) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    return rows.filter(fate != 0).select(
        F.col(conversation), F.col(turn), F.when(fate == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias(role),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias(text),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    ).drop("__copy")


def _back(code: int, extra: int, after):
    """The vector before a row from the one behind it."""
    o = 3 * extra
    if code & _MUST:
        b = [3 + o + c for c in after]
    else:
        t = o + (1 if code & _CUT else 0)
        keep = _KEEP[code & 3]
        b = []
        for s in range(4):
            c = min(3 + o + after[s], 2 + t + after[_NEXT[s]])
            k = keep[s]
            b.append(c if k is None else min(c, t + after[k]))
    u, a = min(b[2], 2 + b[3]), min(b[3], 2 + b[2])
    return (min(b[0], 2 + u), min(b[1], 2 + u), u, a)


def _matrix(codes, extras) -> list[int]:
    """Least costs over a block, row by row of states before it, for each state behind it."""
    columns = []
    for e in range(4):
        v = tuple(0 if s == e else _FAR for s in range(4))
        for i in range(len(codes) - 1, -1, -1):
            v = _back(codes[i], extras[i], v)
        columns.append(v)
    return [min(columns[e][s], _FAR) for s in range(4) for e in range(4)]


def _walks(codes, extras, end, last: bool):
    """(audit, state behind, cost) from each of the four states before the block."""
    n = len(codes)
    step = max(1, math.isqrt(n))
    marks = {n: tuple(end)}
    v = marks[n]
    for i in range(n - 1, -1, -1):
        v = _back(codes[i], extras[i], v)
        if i % step == 0:
            marks[i] = v
    states, audits = [0, 1, 2, 3], [[], [], [], []]
    for begin in range(0, n, step):
        stop = min(begin + step, n)
        vectors = [marks[stop]]
        for i in range(stop - 1, begin - 1, -1):
            vectors.append(_back(codes[i], extras[i], vectors[-1]))
        vectors.reverse()
        for w in range(4):
            state, audit = states[w], audits[w]
            for i in range(begin, stop):
                code, o = codes[i], 3 * extras[i]
                now, after = vectors[i - begin], vectors[i - begin + 1]
                t = o + (1 if code & _CUT else 0)
                while True:
                    cost = now[state]
                    if cost == 3 + o + after[state]:
                        audit.append("D")
                    elif cost == 2 + now[_NEXT[state]]:
                        audit.append("I")
                        state = _NEXT[state]
                        continue
                    else:
                        kept = _KEEP[code & 3][state]
                        if kept is not None and cost == t + after[kept]:
                            audit.append("K")
                            state = kept
                        else:
                            audit.append("R")
                            state = _NEXT[state]
                    break
                if extras[i]:
                    audit.append("D" * extras[i])
            states[w] = state
    out = []
    for w in range(4):
        state, audit = states[w], audits[w]
        cost = v[w] - end[state]
        if last:
            cost = v[w]
            while END[state]:
                audit.append("I")
                state = _NEXT[state]
        out.append(("".join(audit), state, cost))
    return out


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and faults, in range partitions in order."""
    digest = [F.xxhash64(F.lit(seed), "text") for seed in (1, 2)]
    one = rows.select("*", digest[0].alias("h1"), digest[1].alias("h2"))
    firsts = one.groupBy("conv", "role", "h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    shown = F.col("text").rlike(f"[^{BLANK}]")
    marked = one.join(firsts, ["conv", "role", "h1", "h2"]).select(
        "conv", "turn", "role", "text", "copies", (~shown).alias("blank"),
        (shown & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"),
        (shown & ~F.col("text").rlike(f"[.!?][{BLANK}]*\\z")).alias("cut"),
    )
    # beginnings only, as range bounds pass the driver; equal beginnings stay together
    place = ["conv", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64)]
    return marked.repartitionByRange(*place).sortWithinPartitions("conv", "turn", "role", "text")


_BLOCKS = (
    "conv string, part int, blk int, codes binary, extras array<bigint>, roles array<string>, texts array<string>, "
    "matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string"
)
_LEGAL = {"su", "ua", "au"}


def _to_blocks(frames):
    part = TaskContext.get().partitionId()
    number = 0
    rows: list[tuple] = []
    chars = 0

    def close():
        nonlocal rows, chars, number
        codes = bytearray()
        blank = duplicate = truncated = illegal = 0
        before = None
        for conv, role, text, copies, is_blank, seen, cut in rows:
            code = {"s": 1, "u": 2, "a": 3}.get(role[:1], 0)
            if is_blank:
                blank += copies
            else:
                duplicate += copies - (not seen)
                truncated += int(cut and not seen)
            if is_blank or seen:
                code |= _MUST
            elif cut:
                code |= _CUT
            codes.append(code)
            illegal += copies - 1 + (before is not None and before + role[:1] not in _LEGAL)
            before = role[:1]
        extras = [r[3] - 1 for r in rows]
        out = (
            rows[0][0], part, number, bytes(codes), extras, [r[1] for r in rows], [r[2] for r in rows], _matrix(codes, extras),
            blank, duplicate, truncated, illegal, rows[0][1][:1], before,
        )
        number += 1
        rows, chars = [], 0
        return out

    names = ["conv", "part", "blk", "codes", "extras", "roles", "texts", "matrix", "blank", "duplicate", "truncated", "illegal", "first", "last"]
    for frame in frames:
        done = []
        columns = (frame[c].tolist() for c in ("conv", "role", "text", "copies", "blank", "seen", "cut"))
        for row in zip(*columns, strict=True):
            if rows and (row[0] != rows[0][0] or len(rows) >= BLOCK or chars + len(row[2]) > BLOCK_CHARS):
                done.append(close())
            rows.append(row)
            chars += len(row[2])
        if done:
            yield pd.DataFrame(done, columns=names)
    if rows:
        yield pd.DataFrame([close()], columns=names)


def _to_ends(frames):
    """Streams each conversation's blocks from the last one: the vector behind each block."""
    conv, v = None, END
    for frame in frames:
        ends, lasts = [], []
        for name, matrix in zip(frame["conv"], frame["matrix"], strict=True):
            last = name != conv
            if last:
                conv, v = name, END
            ends.append(list(v))
            lasts.append(last)
            v = tuple(min(int(matrix[4 * s + e]) + v[e] for e in range(4)) for s in range(4))
        yield frame[["conv", "part", "blk", "codes", "extras"]].assign(end=ends, final=lasts)


def _to_walks(frames):
    for frame in frames:
        found = [
            _walks(codes, [int(x) for x in extras], [int(x) for x in end], final)
            for codes, extras, end, final in zip(frame["codes"], frame["extras"], frame["end"], frame["final"], strict=True)
        ]
        yield frame[["conv", "part", "blk"]].assign(
            audits=[[w[0] for w in f] for f in found], exits=[[w[1] for w in f] for f in found], costs=[[w[2] for w in f] for f in found]
        )


def _to_chain(frames):
    """Streams each conversation's blocks from the first one: which of the four walks is taken."""
    conv, state = None, 0
    for frame in frames:
        rows = []
        for name, audits, exits, costs in zip(frame["conv"], frame["audits"], frame["exits"], frame["costs"], strict=True):
            if name != conv:
                conv, state = name, 0
            rows.append((state, audits[state], int(costs[state])))
            state = int(exits[state])
        entry, audit, cost = zip(*rows, strict=True) if rows else ((), (), ())
        yield frame[["conv", "part", "blk"]].assign(entry=np.array(entry, np.int32), audit=list(audit), cost=np.array(cost, np.int64))


def _apply(entry: int, audit: str, extras, roles, texts):
    """The repaired turns of a block by its edits."""
    state, row, skip = entry, 0, 0
    out = []
    for edit in audit:
        if skip:
            skip -= 1
            continue
        if edit == "I":
            state = _NEXT[state]
            out.append((_NAMES[state], ""))
            continue
        if edit == "K":
            state = _KEEP[{"s": 1, "u": 2, "a": 3}[roles[row][:1]]][state]
            out.append((roles[row], texts[row]))
        elif edit == "R":
            state = _NEXT[state]
            out.append((_NAMES[state], texts[row]))
        skip = int(extras[row])
        row += 1
    return out


def _to_turns(frames):
    for frame in frames:
        turns = [_apply(*r) for r in zip(frame["entry"], frame["audit"], frame["extras"], frame["roles"], frame["texts"], strict=True)]
        yield frame.drop(columns=["entry", "extras", "roles", "texts"]).assign(
            turns=[[{"role": role, "text": text} for role, text in t] for t in turns]
        )


def repair(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Blocks of repaired conversations: conversation, part and blk (their order), audit, cost, turns (array of role, text), fault counts."""
    kind = rows.schema[conversation].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit(""))
    base = rows.select(
        key.alias("conv"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text")))
    )
    one = written(base.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")), "repair-rows")
    blocks = written(_ordered(one).mapInPandas(_to_blocks, _BLOCKS), "repair-blocks")
    place = "conv string, part int, blk int"
    ends = (
        blocks.select("conv", "part", "blk", "codes", "extras", "matrix").repartition("conv")
        .sortWithinPartitions("conv", F.desc("part"), F.desc("blk"))
        .mapInPandas(_to_ends, f"{place}, codes binary, extras array<bigint>, end array<bigint>, final boolean")
    )
    walks = ends.repartition("conv", "part", "blk").mapInPandas(
        _to_walks, f"{place}, audits array<string>, exits array<int>, costs array<bigint>"
    )
    chain = walks.repartition("conv").sortWithinPartitions("conv", "part", "blk").mapInPandas(
        _to_chain, f"{place}, entry int, audit string, cost bigint"
    )
    counts = ["blank", "duplicate", "truncated", "illegal", "first", "last"]
    joined = blocks.select("conv", "part", "blk", "extras", "roles", "texts", *counts).join(chain, ["conv", "part", "blk"])
    turns = joined.mapInPandas(
        _to_turns,
        f"{place}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, audit string, "
        "cost bigint, turns array<struct<role: string, text: string>>",
    )
    back = F.when(F.col("conv") != "", F.expr("substring(conv, 2)").cast(kind)).alias(conversation)
    return turns.select(back, *[c for c in turns.columns if c != "conv"])


def turns(blocks: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The repaired rows: conversation, part, blk, position (order within a conversation by these three), role, text."""
    return blocks.select(conversation, "part", "blk", F.posexplode("turns").alias("position", "t")).select(
        conversation, "part", "blk", "position", "t.role", "t.text"
    )


_REPORT = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _to_reports(frames):
    sums, audit, digest, conv, last, any_turn = [0] * 5, [], None, None, None, False
    names = ["conv", *(c.split()[0] for c in _REPORT.split(", "))]

    def close():
        return (conv, *sums, "".join(audit), digest.hexdigest())

    for frame in frames:
        done = []
        fields = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns", "first", "last"]
        for name, *counts, edits, block, first, end in zip(*(frame[f].tolist() for f in fields), strict=True):
            if name != conv or digest is None:
                if digest is not None:
                    done.append(close())
                sums, audit, digest, conv, last, any_turn = [0] * 5, [], hashlib.sha256(), name, None, False
            for i, c in enumerate(counts):
                sums[i] += int(c)
            if last is not None and last + first not in _LEGAL:
                sums[3] += 1
            last = end
            audit.append(edits)
            for said in block:
                digest.update((("\n" if any_turn else "") + f"{said['role']}:{said['text']}").encode())
                any_turn = True
        if done:
            yield pd.DataFrame(done, columns=names)
    if digest is not None:
        yield pd.DataFrame([close()], columns=names)


def reports(blocks: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Per conversation with rows: fault counts, cost, audit and the digest of its repaired ``role:text`` lines."""
    kind = blocks.schema[conversation].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit(""))
    rows = blocks.withColumn("conv", key).repartition("conv").sortWithinPartitions("conv", "part", "blk").select(
        "conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns", "first", "last"
    )
    out = rows.mapInPandas(_to_reports, f"conv string, {_REPORT}")
    back = F.when(F.col("conv") != "", F.expr("substring(conv, 2)").cast(kind)).alias(conversation)
    return out.select(back, *out.columns[1:])


def gaps(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns missing between each conversation's first and last one; 0 without known turns."""
    wide = F.col(turn).cast("decimal(38,0)")
    missing: Column = F.max(wide) - F.min(wide) + 1 - F.count(turn)
    return rows.select(conversation, turn).distinct().groupBy(conversation).agg(
        F.coalesce(missing.cast("bigint"), F.lit(0)).alias("gaps")
    )
