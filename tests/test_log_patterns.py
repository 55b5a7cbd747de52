"""Log templates against a plain version of the same rules."""

import collections
import datetime
import random
import re

import pytest

from spindlewatch.operators import log_patterns as lp

START = datetime.datetime(2024, 1, 1)
SCHEMA = "seq bigint, error_msg string, timestamp timestamp"


def masked(text):
    text = re.sub("0x[0-9A-Fa-f]+", "<hex>", text or "")
    return tuple(re.sub(r"[0-9]+(\.[0-9]+)?", "<num>", text).split())


def plain(messages, depth=4, merge_at=5, merges=2):
    """Template of each masked message, by loops."""
    groups = collections.defaultdict(set)
    for m in messages:
        groups[(len(masked(m)),)].add(masked(m))
    for _ in range(depth):
        split = collections.defaultdict(set)
        for name, members in groups.items():
            best = None
            for pos in range(len(next(iter(members)))):
                counts = collections.Counter(m[pos] for m in members)
                s = sum(c * c for c in counts.values())
                if len(counts) > 1 and len(members) ** 3 <= s * s and (best is None or s > best[0]):
                    best = (s, pos)
            for m in members:
                split[name if best is None else (*name, best[1], m[best[1]])].add(m)
        groups = split
    named = {}
    for name, members in groups.items():
        named[name] = tuple(w[0] if len(set(w)) == 1 else lp.VARIABLE for w in zip(*members, strict=True))
    for _ in range(merges):
        distinct = set(named.values())
        sizes = collections.Counter((p, t[:p] + (lp.VARIABLE,) + t[p + 1 :]) for t in distinct for p in range(len(t)))
        new = {}
        for t in distinct:
            options = [(sizes[p, k], -p, k) for p in range(len(t)) for k in [t[:p] + (lp.VARIABLE,) + t[p + 1 :]] if sizes[p, k] >= merge_at]
            new[t] = max(options)[2] if options else t
        named = {name: new[t] for name, t in named.items()}
    return {m: " ".join(named[name]) for name, members in groups.items() for m in members}


def messages(seed):
    rng = random.Random(seed)
    names = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    out = [None, "", "  ", "one", "two", "lone words here", "<*> in text", "a|b=1 2"]
    for _ in range(500):
        out.append(rng.choice([
            f"user {rng.choice(names)} logged in from {rng.choice(names)}", f"axis {rng.choice('XYZ')} overload by {rng.choice(names)}",
            f"pump {rng.choice(['left', 'right'])} pressure {rng.choice(['low', 'high'])} {rng.random()} bar",
            f"file {rng.choice(names)}.nc missing", "heartbeat ok", f"bus {rng.choice(names[:7])} up", f"retry {rng.randint(0, 9)} of  job",
        ]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_templates(spark, seed):
    texts = messages(seed)
    rows = [(i, t, START) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = lp.message_templates(df)
    want = plain(texts)
    got = {tuple(r.text.split()): r.template for r in found.collect()}
    assert got == want
    assert {t for t in got.values() if t.startswith("axis")} == {f"axis {a} overload by <*>" for a in "XYZ"}
    assert "user <*> logged in from <*>" in got.values()
    lines = {r.seq: r.template for r in lp.assign_templates(df, found).collect()}
    assert lines == {i: want[masked(t)] for i, t in enumerate(texts)}
    assert lp.message_templates(df.limit(0)).count() == 0


def test_new_patterns(spark):
    def at(seconds, text):
        return (0, text, START + datetime.timedelta(seconds=seconds))

    rows = [at(s, "alive") for s in range(0, 1000, 5)] + [at(500, "seldom seen thing"), at(5, "seldom seen thing"), at(700, "never before"), at(705, "never before")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = lp.new_patterns(lp.assign_templates(df, lp.message_templates(df)), 300, 10).collect()
    assert {(r.template, (r.window_start - START).seconds, r.n, r.silent_seconds) for r in found} == {
        ("seldom seen thing", 500, 1, 490), ("never before", 700, 2, None),
    }
    later = lp.assign_templates(spark.createDataFrame([at(0, "unheard of")], SCHEMA), lp.message_templates(df))
    assert later.first().template is None
