"""Token ids by words against the library on whole texts, over letters whose case changes and special strings."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spindlewatch.llm import word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(1)
    cased = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (chr(i).lower() != chr(i) or chr(i).upper() != chr(i))]
    out = [f"a{c}{m} {c}{m} x" for c in cased for m in word_ids.MARKS]
    pool = cased[:400] + list("abcXYZ 0123 \t\n.,;:!?)('\"<|>éßÀÿİ̇́\0\x1c\x85  ") * 8
    out += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    return out + ["x<|endoftext|>y <|startoftext|>.", "<|ENDOFTEXT|>", "<|", "a" * 3000 + " " + "é" * 2000, "w, " * 100_000, "İ."]


@pytest.mark.parametrize("block", [word_ids.BLOCK_CHARS, 50])
def test_ids_are_those_of_the_library(monkeypatch, block):
    monkeypatch.setattr(word_ids, "BLOCK_CHARS", block)
    library, own = Tokenizer.from_file(PATH), word_ids.WordCoder(PATH)
    assert own.by_words
    all_texts = texts()
    for begin in range(0, len(all_texts), 500):
        some = all_texts[begin : begin + 500]
        want = [e.ids for e in library.encode_batch_fast(some, add_special_tokens=False)]
        assert [x.tolist() for x in own.encode(some)] == want


def test_a_file_that_splits_otherwise_is_used_on_whole_texts(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]  # no lower case
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    own = word_ids.WordCoder(str(path))
    assert not own.by_words
    some = ["Plain Words, THE end.", "", "x<|endoftext|>"]
    assert [x.tolist() for x in own.encode(some)] == [
        e.ids for e in Tokenizer.from_file(str(path)).encode_batch_fast(some, add_special_tokens=False)
    ]
