"""Hashes of word shingles of many texts at once, with numpy.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters, in lower case. A text's
shingles are its runs of ``size`` words; a text of fewer words, but at least one, has one shingle of all of them.
"""

from __future__ import annotations

import numpy as np

from spindlewatch.llm.common import per_worker, slices

WORDS = 5
BLOCK_CHARS = 1 << 19
_WORD = np.zeros(256, bool)
_WORD[[b for b in range(256) if b >= 128 or b == 95 or chr(b).isalnum()]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    return per_worker(("powers", n), lambda: _make_powers(n))


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word: a polynomial over its bytes that does not depend on where it stands."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = 1 << 20
    while size < len(raw) + 1:
        size *= 2
    up, down = _powers(size)
    edge = np.flatnonzero(np.diff(_WORD[raw].view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def _of_words(words: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """Shingles of each text from the words of all of them; ``counts`` says how many words each has."""
    weights = mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BASE))
    ends = np.cumsum(counts)
    n = len(words)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        full += words[k : k + len(full)] * weights[k]
    full = mixed(full)
    out = []
    for begin, end in zip(ends - counts, ends, strict=True):
        if end - begin >= size:
            out.append(full[begin : end - size + 1])
        elif end > begin:
            out.append(mixed((words[begin:end] * weights[: end - begin]).sum(dtype=np.uint64, keepdims=True) + np.uint64(end - begin)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _cut(text: str):
    """A long text in blocks cut where no word is cut, as far as it has any space."""
    begin = 0
    while begin < len(text):
        end = min(begin + BLOCK_CHARS, len(text))
        if end < len(text):
            space = text.find(" ", end)
            end = len(text) if space < 0 else space
        yield text[begin:end]
        begin = end


def shingles(texts: list[str], size: int = WORDS) -> list[np.ndarray]:
    """The shingle hashes of each text in order, repeats included."""
    out: list[np.ndarray] = []
    for begin, end in slices(texts, BLOCK_CHARS):
        if len(texts[begin]) > BLOCK_CHARS:
            words = np.concatenate([_word_hashes(b.lower().encode("utf-8", "replace"))[0] for b in _cut(texts[begin])])
            out += _of_words(words, np.array([len(words)]), size)
            continue
        data = [t.lower().encode("utf-8", "replace") for t in texts[begin:end]]
        words, starts = _word_hashes(b"\n".join(data))
        bounds = np.cumsum([0] + [len(d) + 1 for d in data])
        out += _of_words(words, np.diff(np.searchsorted(starts, bounds)), size)
    return out


def multiset(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes in order, how often each occurs)."""
    return np.unique(hashes, return_counts=True)
