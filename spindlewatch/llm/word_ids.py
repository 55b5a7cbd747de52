"""Token ids of whole texts by a local tokenizer file, fast enough for large corpora.

A text is split at white space, which this kind of vocabulary drops, and every distinct chunk is encoded by the
tokenizers library once per worker, for as long as the bounded cache holds it; ids of texts are gathered with numpy.
This holds for vocabularies whose pre-tokenizer never joins characters across white space.

A chunk of Latin letters in lower case, with or without marks behind it, is one piece to the pre-tokenizer, and its letters are what
they are to the normaliser: such words go to the library's BPE model straight away. Whether a file does split, lower-case and spell
bytes in this way is tried on a set of probes when it is loaded; if not, whole texts are encoded one by one. So are
texts that may hold one of the special strings.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat
from operator import attrgetter

import numpy as np

from spindlewatch.llm.common import per_worker

#: Chunks a worker remembers; beyond, it forgets all but the first, which hold the frequent ones.
CACHE_CHUNKS, KEPT_CHUNKS = 1_000_000, 600_000
BLOCK_CHARS = 1 << 21
#: Separators that ``str.split`` knows and the tokenizer's ``\s`` does not.
ODD = re.compile("[\x1c-\x1f]")
#: Marks that the pre-tokenizer never joins with the letter or digit before them.
MARKS = ".,;:!?)"
#: A word of lower-case Latin letters and the marks behind it.
WORD = re.compile(f"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([{re.escape(MARKS)}]*)")
#: Texts on which a file must agree with what is assumed here.
PROBES = (
    "Plain words, split at white space: each one alone!  Straße\tÀ L'ÉTÉ\u00a0naïve.\ncafé) øre; ÿ? don't they'll 1234 a1b2 x_y "
    "((odd)) ... \u0130. \u0130\u0307! e\u0301\u0301. \ufb01! \u4e2d\u6587.text \U0001f600; \x1c\x85 z",
    "", " ", "a", "THE END.",
)
#: A character that is a token of its own between two spaces.
SEPARATOR = "\0"
PLAIN = re.compile(r"[ \t\n\r\f\v]+")


def _chunks(text: str) -> list[str]:
    """``text`` at white space; in lower case, as the tokenizer has it, where all characters are in the Latin-1 range."""
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return PLAIN.split(text) if ODD.search(text) else text.split()


_ID = attrgetter("id")


def _shown(byte: int) -> str:
    """The character a byte stands as in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(byte) if byte in prints else chr(256 + sum(b not in prints for b in range(byte)))


class WordCoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_head = os.path.commonprefix(self.specials)
        separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = separator[0] if separator else -1
        self.spelled = str.maketrans({c: "".join(_shown(b) for b in chr(c).encode()) for c in range(0x80, 0x100)})
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # of chunk i: ids[ends[i] : ends[i + 1]]
        self.by_words = len(separator) == 1
        self.by_words = self.by_words and all(  # the probes themselves are encoded by words
            self.encode([t])[0].tolist() == self._whole(t).tolist() for t in PROBES
        )

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks. Marks behind a word are always pieces of their own: both are put together from the two."""
        words, others, both = {}, [], []
        for chunk in chunks:
            found = WORD.fullmatch(chunk)
            if found is None:
                others.append(chunk)
                continue
            core, tail = found.groups()
            words[core] = None
            if tail:
                others.append(tail)
                both.append((chunk, core, tail))
        self._encode([c for c in dict.fromkeys(others) if c not in self.number])
        new = [w for w in words if w not in self.number]
        if new:
            pieces = list(map(self.model.tokenize, [w if w.isascii() else w.translate(self.spelled) for w in new]))
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            ids = np.fromiter(map(_ID, chain.from_iterable(pieces)), np.uint32, int(sizes.sum()))
            self._store(new, ids, sizes)
        if both:
            pairs = np.array([self.number[x] for _, *ends in both for x in ends])
            ids, sizes = self._gather(pairs)
            self._store([c for c, _, _ in both], ids, sizes[::2] + sizes[1::2])

    def _encode(self, chunks: list[str]) -> None:
        """Encode chunks, many in one call: a separator that none of them holds stands between them."""
        plain = [c for c in chunks if SEPARATOR not in c]
        for begin in range(0, len(plain), 4096):
            some = plain[begin : begin + 4096]
            found = self.tokenizer.encode_batch_fast([f" {SEPARATOR} ".join([*some, ""])], add_special_tokens=False)[0].ids
            ids = np.fromiter(found, np.uint32, len(found))
            stops = np.flatnonzero(ids == self.separator)
            self._store(some, ids[ids != self.separator], np.diff(stops, prepend=-1) - 1)
        for chunk in chunks:
            if SEPARATOR in chunk:
                ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, np.uint32)
                self._store([chunk], ids, np.array([len(ids)]))

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of chunks by number, one after another, and how many each has)."""
        starts = self.ends[which]
        sizes = self.ends[which + 1] - starts
        first = np.cumsum(sizes) - sizes
        take = np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(starts - first, sizes)
        return self.ids[take], sizes

    def _store(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.number)
        begin = int(self.ends[first])
        ends = begin + np.cumsum(sizes)
        while first + len(chunks) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[begin : ends[-1]] = ids
        self.ends[first + 1 : first + 1 + len(chunks)] = ends
        self.number.update(zip(chunks, range(first, first + len(chunks)), strict=True))

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, number of ids of each chunk)."""
        if len(self.number) > CACHE_CHUNKS:
            for chunk in list(self.number)[KEPT_CHUNKS:]:
                del self.number[chunk]
        which = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(which < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys([chunks[i] for i in missing])))
            which[missing] = [self.number[chunks[i]] for i in missing]
        return self._gather(which)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        words: list[str] = []
        counts: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            ids, sizes = self._chunk_ids(words)
            per = np.zeros(len(counts) + 1, np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            per[1:] = ends[np.cumsum(counts)]
            out.extend(ids[per[i] : per[i + 1]] for i in range(len(counts)))
            words.clear()
            counts.clear()
            size = 0

        for text in texts:
            if size and size + len(text) > BLOCK_CHARS:
                flush()
            # in any case, as chunks come in lower case
            if not self.by_words or (self.special_head in text and any(x in text.lower() for x in self.specials)):
                if counts:
                    flush()
                out.append(self._whole(text))
                continue
            if len(text) > BLOCK_CHARS:
                if counts:
                    flush()
                out.append(self._long(text))
                continue
            chunks = _chunks(text)
            words.extend(chunks)
            counts.append(len(chunks))
            size += len(text)
        if counts:
            flush()
        return out

    def _long(self, text: str) -> np.ndarray:
        """A text longer than a block, block by block, cut at white space."""
        parts, begin = [], 0
        while begin < len(text):
            end = min(begin + BLOCK_CHARS, len(text))
            if end < len(text) and (cut := PLAIN.search(text, end)) is not None:
                end = cut.start()
            elif end < len(text):
                end = len(text)
            part = text[begin:end]
            parts.append(self._chunk_ids(_chunks(part))[0])
            begin = end
        return np.concatenate(parts)


def coder(path: str) -> WordCoder:
    """The coder of a file, once per Python worker."""
    return per_worker(("words", path), lambda: WordCoder(path))
