"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

Method: a text's subwords are the byte n-grams (1 to 4) of its lower-cased words with a mark at either end. Each
hashes to one row of an embedding table; their mean goes through a linear layer and a softmax. Training is
stochastic gradient descent in numpy on a bounded sample of labelled documents. Part of the sample is set aside to
fit a temperature, and the score below which a text is rejected is a low quantile of the calibrated scores there. As a
softmax always leans to some learnt language, a text is also rejected if its subwords are unusual: if their mean log
probability over the training texts of all languages lies further below the known texts' than chance and they explain.
As everything behind the mean is linear, prediction adds up one precomputed row of class scores per subword.

Defined results: null texts and texts without a letter get language ``und``, score 0.0, and are rejected; without a
single labelled document every text does. Rows with null labels do not train. Ties go to the alphabetically first
language. Repeated rows give repeated results; an empty table gives an empty table; texts are read whole, in blocks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindlewatch.llm.common import slices

BUCKETS = 1 << 15
DIMENSIONS = 16
GRAMS = (1, 2, 3, 4)
#: Labelled documents used for training: this many a language at most, fewer if all languages together had more than SAMPLE_ROWS.
PER_LANGUAGE = 400
LANGUAGES = 256
SAMPLE_ROWS = 12_000
#: One of so many sampled documents calibrates and does not train.
CALIBRATION = 4
EPOCHS = 12
RATE = 0.5
#: Share of right, calibrating documents that may score below the rejection threshold, and that threshold's ceiling:
#: below one half, so that a text in equal parts of two known languages stays.
REJECTED_SHARE = 0.001
CEILING = 0.4
#: Standard deviations below the known texts that are never held against a text.
FAMILIAR = 6.0
#: Subwords of a text that say as much as one drawn alone, as n-grams of four lengths overlap.
OVERLAP = 4
BLOCK_CHARS = 1 << 20
UNDETERMINED = "und"

LETTER = re.compile(r"[^\W\d_]")
_GAP = np.zeros(256, bool)
_GAP[[b for b in range(128) if not chr(b).isalpha()]] = True


def _blocks(text: str):
    """``text`` in blocks cut at white space where there is any near the end of a block."""
    begin = 0
    while begin < len(text):
        end = min(begin + BLOCK_CHARS, len(text))
        if end < len(text):
            cut = text.rfind(" ", begin, end)
            end = cut + 1 if cut > begin else end
        yield text[begin:end]
        begin = end


def subwords(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position of its first letter byte) of every subword of lower-cased UTF-8 bytes.

    Bytes that are neither ASCII letters nor part of a longer character count as gaps; a gap byte reads as 32,
    so that the n-grams at a word's ends show them. No n-gram reaches over a gap.
    """
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    gap = _GAP[raw]
    code = np.where(gap, 32, raw).astype(np.uint32)
    buckets, places = [], []
    key = np.zeros(len(code), np.uint32)
    inner = np.zeros(len(code) + 1, np.int32)
    np.cumsum(gap, out=inner[1:])
    for n in range(1, max(GRAMS) + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        key = key[:size] * np.uint32(0x01000193) ^ code[n - 1 :]
        if n not in GRAMS:
            continue
        if n == 1:
            at = np.flatnonzero(~gap)
        elif n == 2:
            at = np.flatnonzero(~(gap[:size] & gap[1:]))
        else:
            at = np.flatnonzero(inner[n - 1 : n - 1 + size] == inner[1 : 1 + size])
        h = key[at] * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        buckets.append((h >> np.uint32(17)).astype(np.int32))
        places.append(at - 1 + gap[at])
    return np.concatenate(buckets), np.concatenate(places)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, counts) of a whole text."""
    total = np.zeros(BUCKETS, np.int64)
    for block in _blocks(text):
        total += np.bincount(subwords(block.lower().encode("utf-8", "replace"))[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray = field(repr=False)  # buckets x languages: class scores, divided by the temperature
    bias: np.ndarray = field(repr=False)
    threshold: float = 0.0
    usual: np.ndarray | None = field(default=None, repr=False)  # log probability of each bucket in known texts
    centre: float = 0.0  # of known texts' means, with the variance among texts and that of a single subword
    among: float = 0.0
    single: float = 0.0
    floor: float = -np.inf

    def score_texts(self, texts: list[str]) -> np.ndarray:
        """Probabilities, one row for each text; rows of texts without subwords are those of the bias alone."""
        return self.judge(texts)[0]

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, whether the text's subwords are as usual as those of known texts), one row for each text."""
        sums = np.zeros((len(texts), len(self.languages) + 1))
        counts = np.zeros(len(texts))
        for begin, end in slices(texts, BLOCK_CHARS):
            if end == begin + 1 and len(texts[begin]) > BLOCK_CHARS:
                for block in _blocks(texts[begin]):
                    self._add(sums, counts, begin, [block])
            else:
                self._add(sums, counts, begin, texts[begin:end])
        means = sums / np.maximum(counts, 1)[:, None]
        return softmax(means[:, :-1] + self.bias), self.deviation(means[:, -1], counts) >= self.floor

    def deviation(self, mean: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (mean - self.centre) / np.sqrt(self.among + self.single / np.maximum(count, 1) + 1e-12)

    def _add(self, sums, counts, first: int, texts: list[str]) -> None:
        data = [t.lower().encode("utf-8", "replace") for t in texts]
        starts = np.cumsum([0] + [len(d) + 1 for d in data])
        buckets, places = subwords(b" ".join(data))
        owner = np.searchsorted(starts, places, side="right") - 1
        counts[first : first + len(texts)] += np.bincount(owner, minlength=len(texts))
        for k in range(len(self.languages)):
            sums[first : first + len(texts), k] += np.bincount(
                owner, weights=self.table[:, k][buckets], minlength=len(texts)
            )
        if self.usual is not None:
            sums[first : first + len(texts), -1] += np.bincount(owner, weights=self.usual[buckets], minlength=len(texts))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """A model from (language, buckets, counts); every CALIBRATION-th sample of a language only calibrates."""
    sample = [s for s in sample if len(s[1])]
    languages = sorted({s[0] for s in sample})
    if not languages:
        return None
    seen: dict[str, int] = {}
    fit, held = [], []
    for s in sample:
        seen[s[0]] = seen.get(s[0], 0) + 1
        (held if seen[s[0]] % CALIBRATION == 0 else fit).append(s)
    number = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            name, at, n = fit[i]
            share = n / n.sum()
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ embed[at]
            miss = softmax((mean @ out + bias)[None, :])[0].astype(np.float32)
            miss[number[name]] -= 1
            back = out @ miss
            out -= rate * np.outer(mean, miss)
            bias -= 0.1 * rate * miss
            # a bucket's share of the mean is tiny; the root evens out steps of frequent and rare subwords
            embed[at] -= rate * np.sqrt(share)[:, None] * back[None, :]
    table = embed @ out
    held = held or fit
    raw = np.array([(n / n.sum()) @ table[at] + bias for _, at, n in held], dtype=np.float64)
    truth = np.array([number[s[0]] for s in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    scores = softmax(raw / temperature)
    right = scores.max(axis=1)[scores.argmax(axis=1) == truth]
    threshold = min(CEILING, float(np.quantile(right, REJECTED_SHARE))) if len(right) else 0.0
    model = Model(languages, (table / temperature).astype(np.float64), bias.astype(np.float64) / temperature, threshold)
    return _familiarity(model, fit, held)


def _familiarity(model: Model, fit: list, held: list) -> Model:
    """The model with what tells texts of unknown languages; every language weighs alike, so texts of several stay."""
    chance = np.zeros(BUCKETS)
    for name in {s[0] for s in fit}:
        seen = np.zeros(BUCKETS)
        for s in fit:
            if s[0] == name:
                seen[s[1]] += s[2] / np.sqrt(s[2].sum())
        seen += 1e-3 * seen.mean()
        chance += seen / seen.sum()
    usual = np.log(chance / chance.sum())
    counts = np.array([n.sum() for _, _, n in held], np.float64)
    means = np.array([usual[at] @ n for _, at, n in held]) / counts
    squares = np.array([usual[at] ** 2 @ n for _, at, n in held]) / counts
    single = OVERLAP * float(np.median(squares - means**2))
    model = replace(model, usual=usual, centre=float(np.median(means)), among=float(means.var()), single=single)
    return replace(model, floor=min(-FAMILIAR, float(np.quantile(model.deviation(means, counts), REJECTED_SHARE))))


def fit_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", eligible: Column | None = None
) -> Model | None:
    """A model from a bounded sample of the labelled, eligible rows: those of the smallest hashes of key and text in each
    language, as many of each language at most. Rows that repeat key and text count once.

    Only subword counts of the sample reach the driver, SAMPLE_ROWS rows of them at most.
    """
    rows = docs.select(
        F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
        (F.lit(True) if eligible is None else eligible).alias("ok"),
    ).filter("ok AND text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("key", "text"), F.lit(1 << 40)))
    counts = {
        r["lang"]: r["n"]
        for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("h").alias("n"))
        .orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()
    }
    if not counts:
        return None
    share = min(PER_LANGUAGE, SAMPLE_ROWS // len(counts))
    # enough hashes below the limit to hold the share of smallest ones, as the counts are estimates
    near = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int((1 << 40) * min(1.0, (2 * share + 50) / n)))))
    drawn = rows.filter(F.col("lang").isin(list(counts)) & (F.col("h") < F.element_at(near, F.col("lang"))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = drawn.select("lang", "h").distinct().withColumn("n", rank).filter(F.col("n") <= share)
    last = {r["lang"]: r["h"] for r in last.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not last:
        return None
    limit = F.create_map(*(F.lit(x) for k, h in last.items() for x in (k, h)))
    sample = drawn.filter(F.col("h") <= F.element_at(limit, F.col("lang"))).dropDuplicates(["lang", "h"]).select("key", "lang", "text")

    def count(frames):
        for frame in frames:
            found = [features(t) for t in frame["text"]]
            yield pd.DataFrame(
                {"key": frame["key"].astype(str), "lang": frame["lang"], "at": [a.tobytes() for a, _ in found],
                 "n": [n.tobytes() for _, n in found]}
            )

    rows = sample.mapInPandas(count, "key string, lang string, at binary, n binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["key"], bytes(r["at"])))
    return train([(r["lang"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.float32)) for r in rows])


def predict(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out`` of lang, score (0 to 1), rejected; it replaces a column of that name."""

    @F.pandas_udf("struct<lang: string, score: double, rejected: boolean>")
    def run(column: pd.Series) -> pd.DataFrame:
        texts = ["" if t is None else t for t in column]
        lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        usual = np.ones(len(texts), bool)
        if model is not None and texts:
            chances, usual = model.judge(texts)
            for i, (t, k) in enumerate(zip(texts, chances.argmax(axis=1), strict=True)):
                if LETTER.search(t):
                    lang[i], score[i] = model.languages[k], chances[i, k]
        threshold = model.threshold if model else 0.0
        rejected = [name == UNDETERMINED or s < threshold or not u for name, s, u in zip(lang, score, usual, strict=True)]
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return docs.withColumn(out, run(F.col(text).cast("string")))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is not rejected, with their columns as they are; trained on these rows' own labels."""
    model = fit_documents(docs, key, text, lang)
    return predict(docs, model, text, "__language").filter("NOT __language.rejected").drop("__language")
