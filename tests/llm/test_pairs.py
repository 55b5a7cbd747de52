"""Near duplicates, neighbours and components against brute force on small tables."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlewatch.llm import bagminhash, components, embedding_dedup, nn_descent, shingles


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# components


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(500, 500)]
    edges += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)] + [(7, 3)] * 3
    rows = [*edges, (None, 1)]
    out = components.components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()
    links = [(a, b) for a, b in edges if a != b]
    assert {r["node"]: r["component"] for r in out} == roots({x for e in links for x in e}, links)
    assert len(out) == len({r["node"] for r in out})
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# texts


def bag(text):
    words = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", (text or "").lower())
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def jaccard(a, b):
    both = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def test_shingles_are_the_words():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["Ab", "ab", "ß", "é", "_", " ", "\n", ".", "9", "--"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["one two", "", "x " * 200_000, " ".join(str(i % 1000) for i in range(200_000))]
    by_hash = {}
    for text, hashes in zip(texts, shingles.shingles(texts), strict=True):
        words = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", text.lower())
        want = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        assert len(want) == len(hashes)
        for shingle, h in zip(want, hashes.tolist(), strict=True):
            assert by_hash.setdefault(h, shingle) == shingle


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    misses = []
    for _ in range(120):
        n = int(rng.integers(3, 200))
        h = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        a, b = rng.integers(1, 9, len(h)), rng.integers(0, 9, len(h))
        bags = [(h, a), (h[b > 0], b[b > 0])]
        s = bagminhash.overlap(*bags)
        got = bagminhash.signatures(bags, 1200)
        misses.append(((got[0] == got[1]).mean() - s) / math.sqrt(max(s * (1 - s), 1e-3) / 1200))
    assert abs(np.mean(misses)) < 0.3 and np.std(misses) < 1.3
    assert (bagminhash.signatures([(np.zeros(0, np.uint64), np.zeros(0, int))]) == 0).all()


def copies(seed, families=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(500)]
    texts = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 120]))]
        for _ in range(rng.randint(1, 25)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    texts += texts[:9] + [" again and again " * 30, " again and again " * 29]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [6, bagminhash.BLOCK])
def test_near_duplicate_texts(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    texts = copies(5) + [None, None, "", "", "?! ...", "?! ...", "solo", "Solo!"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, c string")
    out = bagminhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    bags = [bag(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8]
    want = roots(range(len(texts)), links)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t if bags[i] else i, i)
    for r in out:
        i = r["doc_id"]
        assert r["component_id"] == want[i]
        assert r["class_id"] == first[texts[i] if bags[i] else i]
        assert r["kept"] == (want[i] == i)
    kept = bagminhash.keep_one(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))
    assert all(texts[r["doc_id"]] == r["text"] and r["c"] == "x" for r in kept)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bagminhash.near_duplicates(df).count() == 0
    odd = spark.createDataFrame([(None, "some words that are here now"), (None, "some words that are here now"), (3, None)], "doc_id bigint, text string")
    assert bagminhash.near_duplicates(odd).count() == 3
    assert bagminhash.keep_one(odd).count() == 3


# vectors


def vectors(seed, n=240, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.standard_normal(d)
        if rows and i % 3:
            x = np.array(rows[int(rng.integers(0, len(rows)))][1]) + rng.standard_normal(d) * rng.choice([0.0, 0.05, 0.3])
        rows.append((i, [float(v) for v in np.float32(x)], int(rng.integers(0, 3))))
    return rows


ODD = [
    (900, None, 1), (901, [0.0] * 16, 1), (902, [math.nan] + [1.0] * 15, 1), (903, [math.inf] + [1.0] * 15, 1),
    (904, [None] + [1.0] * 15, 1), (905, [1.0] * 16, None), (906, [1.0] * 8, 1), (907, [2.0] * 8, 1), (908, [1e30] * 16, 2), (909, [1e-30] * 16, 2), (910, [], 1),
]


def clean(x):
    return x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x)


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    a, b = a / abs(a).max(), b / abs(b).max()
    return a @ b / math.sqrt((a @ a) * (b @ b))


@pytest.mark.parametrize("block", [7, embedding_dedup.BLOCK])
def test_near_duplicate_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = [*vectors(2), *ODD]
    rows.append((911, rows[0][1], rows[0][2]))
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, label int, key int")
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(out) == len(rows)
    links = []
    for a, x, k in rows:
        for b, y, j in rows:
            if b < a and k == j and k is not None and clean(x) and clean(y) and len(x) == len(y) and cosine(x, y) >= 0.93:
                links.append((a, b))
    want = roots([r[0] for r in rows], links)
    degree = collections.Counter(x for e in links for x in e)
    for i, r in out.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], want[i], want[i] == i)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_tables_find_pairs_at_the_threshold():
    for n in (1, 1000, 10**6, 10**9):
        tables, bits = embedding_dedup.tables_and_bits(n)
        assert (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables <= embedding_dedup.MISSED


def test_nearest_is_exact_on_a_small_table(spark):
    rows = [*vectors(7, 120), *ODD, (912, [1.0] * 16, 0), (913, [1.0] * 16, 0), (914, [1.0] * 16, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, rank int")
    out = collections.defaultdict(list)
    for r in nn_descent.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, x, _ in rows:
        near = sorted((-cosine(x, y), i) for i, y, _ in rows if i != q and clean(x) and clean(y) and len(x) == len(y)) if q % 10 == 0 else []
        assert [r for r, _, _ in out[q]] == list(range(1, min(5, len(near)) + 1))
        for (_, i, s), (t, j) in zip(out[q], near[:5], strict=True):
            assert abs(s + t) < 1e-12 and (i == j or abs(cosine(x, dict((a, b) for a, b, _ in rows)[i]) + t) < 1e-12)
    assert nn_descent.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_nearest_finds_most_on_a_larger_table(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    got = collections.defaultdict(set)
    for r in nn_descent.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    for q in range(0, 3000, 50):
        sims = unit @ unit[q]
        sims[q] = -2
        hits += len(got[q] & set(np.argsort(-sims)[:5].tolist()))
    assert hits >= 0.9 * 5 * 60


def test_nearest_tells_near_copies_apart(spark):
    rng = np.random.default_rng(8)
    x = (rng.standard_normal(64) + 0.01 * rng.standard_normal((3000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in nn_descent.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 50):
        sims = unit @ unit[q]
        sims[q] = -2
        hits += len(got[q] & set(np.argsort(-sims)[:5].tolist()))
    assert hits >= 0.9 * 5 * 60


def test_rounds_go_on_until_the_lists_settle(spark, monkeypatch):
    left = [90, 70, 50, 40, 30, 20, 10, 1, 0]
    made = []

    def one_round(nodes, graph, degree):
        made.append(left[len(made)])
        return spark.createDataFrame([(1, [2] * 100, made[-1])], "u bigint, ids array<bigint>, fresh int")

    monkeypatch.setattr(nn_descent, "_start", lambda nodes, degree: None)
    monkeypatch.setattr(nn_descent, "_round", one_round)
    nn_descent.build(None)
    assert made == left[:8]
    assert [nn_descent.beam_for(n) for n in (0, 4096, 65_536, 1_048_576)] == [128, 128, 256, 384]
