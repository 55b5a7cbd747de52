"""Conversation repair against a plain enumeration of edit strings."""

import functools
import hashlib
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from spindlewatch.llm import conversation_repair as cr
from spindlewatch.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def repaired(rows):
    """Of one conversation: (blank, duplicate, truncated, illegal, cost, audit, digest), over all edit strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for r in rows:
        found = SHOWN.findall(r[3])
        faults.append("blank" if not found else "duplicate" if r[2:] in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add(r[2:])
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def follows(state, initial):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[state].find(initial) >= 0 if initial in ("s", "u", "a") else False

    @functools.lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if follows(state, role[0]):
                    c, e, t = best(i, role[0], inserts + 1)
                    options.append((c + 2, "I" + e, ((role, ""), *t)))
        if i < len(rows):
            c, e, t = best(i + 1, state, 0)
            options.append((c + 3, "D" + e, t))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for name, cost, role in (("K", 0, rows[i][2]), ("R", 2, "user"), ("R", 2, "assistant")):
                    if follows(state, role[:1]):
                        c, e, t = best(i + 1, role[:1], 0)
                        options.append((c + cost + more, name + e, ((role, rows[i][3]), *t)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    cost, audit, turns = best(0, "", 0)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), turns


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def random_rows(seed, conversations=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unknown"]
    texts = ["Hi.", "Hi", "", " \t", "Why?", "No!  ", "x y", " ", None, "Hm…", "End.\n"]
    rows = []
    for conv in range(conversations):
        for _ in range(rng.choice([1, 2, 4, 9, 25])):
            role = rng.choices(roles, [9, 9, 2, 1, 1, 1, 1, 1])[0]
            rows.append((conv if conv else None, rng.choice([None, *range(30)]), role, rng.choice(texts) if rng.random() < 0.4 else f"t{rng.random()}."))
    return rows + rng.sample(rows, 12)


@pytest.mark.parametrize("block", [1, 3, cr.BLOCK])
def test_cheapest_edits(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rows = random_rows(block)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("blank", F.lit(2))
    blocks = cr.repair(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.reports(blocks).collect()}
    said = {}
    for r in sorted(cr.turns(blocks).collect(), key=lambda r: (r["part"], r["blk"], r["position"])):
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    groups = by_conversation([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert set(got) == set(groups)
    for conv, group in groups.items():
        want, turns = repaired(group)
        assert got[conv] == want, (conv, group)
        assert said.get(conv, []) == list(turns)


def test_one_long_conversation(spark, monkeypatch):
    sys.setrecursionlimit(50_000)
    monkeypatch.setattr(cr, "BLOCK", 64)
    rng = random.Random(4)
    rows = [(5, i, rng.choice(["user", "assistant"]), f"{i} said." if rng.random() < 0.8 else "again") for i in range(600)]
    rows += [(5, 100, "user", "many times.")] * 50
    got = cr.reports(cr.repair(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [tuple(r)[1:] for r in got] == [repaired(rows)[0]]


def test_checkpointed_walk_of_a_large_block():
    rng = random.Random(9)
    codes = bytes(rng.choice([0, 1, 2, 3, 2, 3, 6, 11, 10]) for _ in range(5000))
    extras = [0] * 5000
    walks = cr._walks(codes, extras, cr.END, True)
    m = cr._matrix(codes, extras)
    for s in range(4):
        audit, _, cost = walks[s]
        assert cost == min(m[4 * s + e] + cr.END[e] for e in range(4))
        weights = {"D": 3, "I": 2, "K": 0, "R": 2}
        row, spent = 0, 0
        for edit in audit:
            spent += weights[edit]
            if edit != "I":
                spent += edit != "D" and bool(codes[row] & 8)
                row += 1
        assert spent == cost and row == 5000


def test_whole_query(spark, tmp_path):
    rows = random_rows(77, 80) + [(9000 + i, 3, "user", "dropped?") for i in range(60)] + [(None, None, "user", "x.")] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    groups = by_conversation(damaged(rows))
    assert set(got) == {r[0] for r in rows}
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for conv, r in got.items():
        group = groups.get(conv, [])
        want = repaired(group)[0] if group else (0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert tuple(r[n] for n in names) == want, conv
        known = {t[1] for t in group if t[1] is not None}
        assert r["gaps"] == (max(known) - min(known) + 1 - len(known) if known else 0)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert queries.op11_conversation_repair(spark, f"{tmp_path}/empty").count() == 0
