"""Hard negatives against a full comparison, and the tree's ranges against plain distances."""

import math
import random

import numpy as np
import pytest

from spindlewatch.llm import gnat, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    """anchor, positive, rank, negative, scores of all anchors, by the contract's words."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = set()
    for i, v, label in kept:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, u, strict=True)), j, other) for j, u, other in kept if j != i and len(u) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            hard = [(n, -t) for t, n, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out |= {(i, j, rank, n, -s, t) for rank, (n, t) in enumerate(hard, 1)}
    return out


def vectors(seed, n=400, d=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(d)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i * rng.choice([1, 1, 50]) if i % 3 == 0 else i, [x + rng.gauss(0, 0.1) for x in c], rng.randint(0, 9)))
    rows = list({r[0]: r for r in rows}.values())
    same = [0.25] * d
    rows += [(100_000 + i, same, i % 3) for i in range(90)]  # a crowd at one place, all ties
    rows += [
        (200_000, None, 1), (200_050, [None] * d, 1), (200_100, [math.nan] * d, 1), (200_150, [math.inf] * d, 1), (200_200, [0.1] * d, None),
        (None, [0.1] * d, 2), (200_250, [0.0] * d, 3), (200_300, [0.3, 0.2], 1), (200_301, [0.3, 0.2], 1), (200_302, [0.2, 0.2], 2), (200_350, [], 4),
        (200_351, [], 4), (200_352, [], 5), (200_400, [-0.3] * d, 3),
    ]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [{}, {"LEAF": 16, "QUERIES": 4, "SAMPLE": 120, "SPLIT": 10, "ARITY": 4}, {"SAMPLE": 0}])
def test_whole_query(spark, tmp_path, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(gnat, name, value)
    rows = vectors(len(settings))
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cell", "'x' AS qid", "2 AS key").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows) and got


def test_empty_and_lonely(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(50, [1.0, 2.0], 3)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert queries.op13_hard_negatives(spark, f"{tmp_path}/{name}").count() == 0


def test_tree_eliminates_without_loss():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 200, (12, 8))
    v = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(0, 15, (3000, 8)))
    tree = gnat.grow(np.unique(v[:600], axis=0))
    cell, r = gnat.locate(tree, v)
    for node in tree["nodes"]:
        m = len(node["points"])
        node |= {"near": np.zeros((m, m)), "far": np.zeros((m, m)), "least": np.full(m, -1.0), "most": np.full(m, -1.0)}
    for c, (path, point) in tree["cells"].items():
        mine = v[cell == c]
        assert np.allclose(r[cell == c], gnat._distances(mine, point[None])[:, 0])
    for number, node in enumerate(tree["nodes"]):
        for child in range(len(node["points"])):
            below = [c for c, (path, _) in tree["cells"].items() if (number, child) in path]
            mine = v[np.isin(cell, below)]
            if len(mine):
                away, n2 = gnat._distances(mine, node["points"]), (mine * mine).sum(1)
                node["near"][:, child], node["far"][:, child] = away.min(0), away.max(0)
                node["least"][child], node["most"][child] = n2.min(), n2.max()
    q = v[:40]
    score = q @ v.T
    best = np.sort(score, axis=1)[:, -20]
    row, cells, _ = gnat.alive(tree, q, best, np.full(40, np.inf), np.arange(40))
    seen = set(zip(row.tolist(), cells.tolist(), strict=True))
    assert {(i, int(cell[j])) for i, j in zip(*np.nonzero(score >= best[:, None]), strict=True)} <= seen
    assert len(seen) < 0.5 * 40 * len(tree["cells"])
