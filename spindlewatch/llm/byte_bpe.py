"""Byte-level BPE by a local rank file: encoding to ids, raw-byte decoding.

Method: the tiktoken library does the merges. A long text is cut beforehand at boundaries no match of the
split pattern can cross, so that one call never holds a whole huge text.

Defined results: a null text counts as empty and gives no ids; repeated rows give repeated results; an empty
table gives an empty table; input columns other than the text are kept, also if they are called like ours.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.llm.common import per_worker

#: A single space between two characters that are not white space. Only matches made of white space, or ones
#: that begin with the space, hold a space, so none of the pattern's matches reaches over this place.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
PIECE_CHARS = 1 << 16


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, once per Python worker."""
    return per_worker(("tiktoken", path, pattern), lambda: _load(path, pattern))


def _load(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """``text`` in order, cut at safe boundaries after about ``limit`` characters each."""
    out, begin = [], 0
    while len(text) - begin > limit:
        cut = SAFE_CUT.search(text, begin + limit)
        if cut is None:
            break
        out.append(text[begin : cut.start()])
        begin = cut.start()
    out.append(text[begin:])
    return out


def encode(enc, text: str, limit: int = PIECE_CHARS) -> list[int]:
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, limit) for i in enc.encode_ordinary(piece)]


def decode(enc, ids) -> bytes:
    """The raw bytes of ids; a single id need not be valid UTF-8."""
    return enc.decode_bytes(ids)


def encode_column(
    df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", limit: int = PIECE_CHARS
) -> DataFrame:
    """``df`` with the ids of its text as array<int> in column ``out``, which replaces one of that name."""

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        enc = encoding(path, pattern)
        return texts.map(lambda t: np.asarray(encode(enc, t or "", limit), dtype=np.int32))

    return df.withColumn(out, ids_of(F.col(text)))


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of its ids in column ``out``; null ids give empty bytes."""

    @F.pandas_udf("binary")
    def bytes_of(column):
        enc = encoding(path, pattern)
        return column.map(lambda i: b"" if i is None else decode(enc, i.tolist()))

    return df.withColumn(out, bytes_of(F.col(ids)))


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, and SHA-256 of the ids (little-endian unsigned 32 bit) and of the decoded bytes.

    Encodes, decodes and digests in one pass; ids never leave the task.
    """

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column(1):
                ids = encode(enc, value.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(decode(enc, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
