"""Repeated passages against a plain count of all windows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from spindlewatch.llm import queries, suffix_dedup

SCHEMA = "doc_id bigint, text string"


@pytest.mark.parametrize("data", [
    b"", b"a", b"ab\0", b"\0\0\0\0", b"banana", b"a" * 500, b"abc" * 300, bytes(random.Random(1).choices(b"ab", k=2000)),
    bytes(random.Random(2).choices(range(256), k=3000)) * 2, b"\0" * 9 + b"a\0a\0",
])
def test_suffix_order_and_common_prefixes(data):
    array = np.frombuffer(data, np.uint8)
    order = suffix_dedup.suffix_array(array)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    if not data:
        return
    got = suffix_dedup.common_prefixes(array, order).tolist()
    for slot in range(1, len(data)):
        a, b = data[order[slot - 1] :], data[order[slot] :]
        want = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[slot] == want
    assert got[0] == 0


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length, n=120):
    rng = random.Random(seed)

    def prose(k):
        return " ".join(rng.choice(["der", "ünd", "mountain", "of", "xyz", "q", "ß"]) + str(rng.randint(0, 40)) for _ in range(k))

    shared = [prose(length // 4) for _ in range(6)] + ["z" * (length * 2), "ab" * length, prose(length // 14)]
    texts = [None, "", "short", "z" * length, "z" * (length - 1), "z" * (length + 1), "y" * (3 * length), "ab" * length, "ab" * length, "pqr" * length, "k" * (5 * length)]
    for _ in range(n):
        text = [prose(rng.randint(1, length // 3))]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            text += [s[a : a + rng.randint(length // 2, 2 * length)], prose(rng.randint(0, length // 6))]
        texts.append(" ".join(text))
    texts += texts[20:26] + [texts[30][:-3] + "!", prose(6 * length)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("settings", [{}, {"CHUNK": 2, "RUN": 50, "SHARD_BYTES": 4000, "BLOCK": 1500}])
def test_whole_query(spark, tmp_path, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    texts = corpus(3, 400)
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS name", "2 AS h1").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op12_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i if i else None] for i in range(len(texts))] == brute(texts, 400)


def test_spans_and_kept_bytes(spark):
    passage = "".join(random.Random(5).choices("abcdefghij klm", k=500))
    df = spark.createDataFrame([(1, "left " + passage + " right"), (2, passage), (3, "other")], SCHEMA)
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicate(df).collect()}
    assert bytes(got[1]["kept"]) == b"left  right" and (got[1]["starts"], got[1]["stops"]) == ([5], [505])
    assert bytes(got[2]["kept"]) == b"" and bytes(got[3]["kept"]) == b"other" and got[3]["starts"] == []
    assert suffix_dedup.deduplicate(df.limit(0)).count() == 0


def test_a_line_repeated_in_many_texts_is_a_row_for_each_different_window(spark, tmp_path, monkeypatch):
    tables = []

    def kept(df, name, of=suffix_dedup.written):
        out = of(df, name)
        tables.extend([out] if name == "suffix-contexts" else [])
        return out

    monkeypatch.setattr(suffix_dedup, "written", kept)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 4)
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghij", k=450)) + "A line. " * rng.randint(60, 200) + "".join(rng.choices("klmnop", k=450)) for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in queries.op12_suffix_dedup(spark, str(tmp_path)).collect())
    assert [r[1:] for r in rows] == brute(texts, 400)
    last = tables[-1]
    assert last.select("digest").distinct().count() < 30
    assert last.count() == last.select("h1", "h2", "digest").distinct().count() < 30 * 30
