"""Packing, training order, the pipeline and the registry against brute force."""

import collections
import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from spindlewatch.llm import byte_bpe, packing, training_order, word_ids
from spindlewatch.llm import queries as llm_queries

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", None, "\x1c a\x1cb", "x\x00y", "\x00", "don't  ÀÉ ﬁ İstanbul ΣΑΣ <|endoftext|>", "a" * 5000, "\x85\xa0 ́x", "one", "one"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def texts_of(spark, small, n=60):
    return [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(n).collect()]


# token ids


def test_word_ids_are_the_tokenizer_s(spark, small, tokenizer, monkeypatch):
    monkeypatch.setattr(word_ids, "CACHE_CHUNKS", 500)
    monkeypatch.setattr(word_ids, "KEPT_CHUNKS", 100)
    monkeypatch.setattr(word_ids, "BLOCK_CHARS", 3000)
    own = word_ids.WordCoder(WORDS)
    texts = texts_of(spark, small) + [t or "" for t in ODD] + ["word " * 4000]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# packing


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(5)
    for window in (8, 64, 256):
        for _ in range(30):
            h = rng.integers(0, 40, window + 1) * (rng.random(window + 1) < rng.choice([0.05, 0.5, 1.0]))
            h[0] = 0
            layout = packing.plan(h, window)
            filled = collections.defaultdict(list)
            for size in np.flatnonzero(h):
                number, place, at = layout.locate(np.full(h[size], size), np.arange(h[size]))
                for n, p, a in zip(number.tolist(), place.tolist(), at.tolist(), strict=True):
                    parts = [(n, p, 0, size)] if a < 0 else layout.cut(a, int(size))
                    assert sum(x[3] for x in parts) == size
                    for n, p, _, k in parts:
                        filled[n].append((p, k))
            assert sorted(filled) == list(range(len(filled)))
            for parts in filled.values():
                end = 0
                for p, k in sorted(parts):
                    assert p == end
                    end += k
                assert end == window or end & (end - 1) == 0


def test_packed_documents(spark, small, tokenizer):
    texts = texts_of(spark, small) + ODD
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "no key", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part int").repartition(3)
    out = packing.pack(df, WORDS, window=128, keep_ids=True)
    pieces = collections.defaultdict(list)
    for r in out.collect():
        pieces[r["doc_id"]].append(r)
    for i, t, _ in rows:
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            ids = np.array(want[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(want), zlib.crc32(ids), ids)
            at += r["length"]
        assert at == len(want)
    whole = packing.sequences(out, 128).collect()
    for r in whole:
        assert r["length"] == 128 or r["length"] & (r["length"] - 1) == 0
        assert len(r["ids"]) == 4 * r["length"]
    assert sum(r["length"] for r in whole) == sum(r["length"] for p in pieces.values() for r in p)
    assert packing.pack(df.limit(0), WORDS).count() == 0


# training order


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (1, 2):
            slots = training_order.permuted(np.arange(n), n, key)
            assert sorted(slots) == list(range(n))
            assert (training_order.permuted(slots, n, key, inverse=True) == np.arange(n)).all()
    assert (training_order.permuted(np.arange(1000), 1000, 1) != training_order.permuted(np.arange(1000), 1000, 2)).any()


def test_shards(spark, small, tmp_path):
    texts = texts_of(spark, small) + ODD
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "no key", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot int").repartition(4)
    df.write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    about = training_order.write_shards(df, f"{tmp_path}/out", RANKS, public_tokenizers.PATTERN, seed=3, length=64, shard_slots=100)
    assert about == training_order.read_manifest(spark, f"{tmp_path}/out")
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    want = {}
    for i, t, _ in rows:
        ids = [*byte_bpe.encode(enc, t or ""), about["end_id"]]
        for k in range(0, len(ids), 64):
            want[i, k // 64] = ids[k : k + 64]
    out = training_order.read_shards(spark, f"{tmp_path}/out").orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(len(want)))
    assert {(r["key"], r["number"]): np.frombuffer(r["ids"], "<u4").tolist() for r in out} == want
    assert [r["key"] for r in out] != sorted((r["key"] for r in out), key=lambda k: -1 if k is None else k)
    rest = training_order.read_shards(spark, f"{tmp_path}/out", 150, 300).orderBy("position").collect()
    assert rest == out[150:300]
    index = spark.read.parquet(f"{tmp_path}/out/index").collect()
    for r in index:  # a record can be read by seeking alone
        (name,) = [f for f in os.listdir(f"{tmp_path}/out/shards/shard={r['shard']}") if f.startswith("part-")]
        with open(f"{tmp_path}/out/shards/shard={r['shard']}/{name}", "rb") as shard:
            shard.seek((r["records"] - 1) * about["stride"] + 8)
            assert int.from_bytes(shard.read(4), "little") == out[r["first"] + r["records"] - 1]["number"]
    again = training_order.write_shards(df, f"{tmp_path}/again", RANKS, public_tokenizers.PATTERN, seed=4, length=64, shard_slots=100)
    other = training_order.read_shards(spark, f"{tmp_path}/again").orderBy("position").collect()
    assert again["slots"] == about["slots"] and [r["ids"] for r in other] != [r["ids"] for r in out]


def test_shards_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    about = training_order.write_shards(df, f"{tmp_path}/out", RANKS, public_tokenizers.PATTERN, seed=3)
    assert about["shards"] == 0 and training_order.read_shards(spark, f"{tmp_path}/out").count() == 0


# pipeline and registry


def test_pipeline_is_its_stages(spark, small, tokenizer):
    """Brute force: all documents have letters, so none is rejected; groups, spans and ids by plain Python."""
    from test_pairs import bag, jaccard, roots
    from test_texts import brute_spans

    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    bags = {r["doc_id"]: bag(r["text"]) for r in docs}
    links = [(a, b) for a in bags for b in bags if b < a and bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8]
    want = roots(list(bags), links)
    kinds = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
    lengths = {}
    for r in docs:
        if want[r["doc_id"]] == r["doc_id"]:
            parts, at = [], 0
            for kind, a, b in brute_spans(r["text"]):
                if a >= at:
                    parts += [r["text"][at:a], kinds[kind]]
                at = max(at, b)
            text = "".join([*parts, r["text"][at:]])
            lengths[r["doc_id"]] = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    out = corpus_pipeline.run(spark, small)
    got = {r["doc_id"]: (r["n"], r["t"]) for r in out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert got == {i: (n, n) for i, n in lengths.items()}


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, "the quick brown fox jumps a@b.co", "en", "s", 32, "x"), (2, "the quick brown fox jumps a@b.co", "en", "s", 32, "x"), (None, "und noch ein Text", "de", None, 17, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, c string")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, df, "")
            assert after.columns == df.columns
            df = after
        out = corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
        if df.count():
            assert {r["doc_id"]: r["doc_tokens"] for r in out}.keys() == {None, 2}
            assert sum(r["length"] for r in out if r["doc_id"] == 2) == next(r["doc_tokens"] for r in out if r["doc_id"] == 2)


def test_registered_queries():
    names = list(llm_queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(names) | {"pipeline"} <= set(entry.queries())


def test_the_rest_stands_without_the_subpackage(tmp_path):
    code = (
        "import sys; sys.modules['spindlewatch.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') for n in e.queries())"
    )
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
