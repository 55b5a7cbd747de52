"""The registered queries of this subpackage; their DuckDB checks are in ``checks``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.llm import (
    bagminhash,
    byte_bpe,
    chat_format,
    conversation_repair,
    embedding_dedup,
    gnat,
    html_extract,
    langid,
    nn_descent,
    packing,
    pii,
    suffix_dedup,
    training_order,
)
from spindlewatch.llm.checks import CHECKS as CHECKS
from spindlewatch.llm.common import table
from spindlewatch.session import shared_path


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(table(spark, folder, "pages"))


def op2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest other vectors of each vector whose id is divisible by 50."""
    return nn_descent.nearest(table(spark, folder, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def op3_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return bagminhash.near_duplicates(table(spark, folder, "documents"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into windows of 2048 ids."""
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of equal label."""
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted, then read back from text and mask."""
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat_format.read_back(chat_format.format_trees(chat_format.as_trees(rows)))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op8_training_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as sequences in training order, read back from the shards."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    target = shared_path(spark, "training-order")
    training_order.write_shards(table(spark, folder, "documents"), target, path, public_tokenizers.PATTERN, seed=20240229)
    rows = training_order.read_shards(spark, target)
    return rows.select(
        F.col("key").alias("doc_id"), F.col("number").cast("bigint").alias("number"), "position", "shard",
        F.col("n_ids").cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
    )


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts of the base kinds, digest of their spans, all spans."""
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("pii", lambda s: s["kind_order"] < len(pii.BASE))
    return found.select(
        "doc_id",
        *(count(kind) for kind in pii.BASE),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
    )


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, by a model that never saw the held-out ones."""
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit_documents(docs, eligible=F.coalesce(~held_out, F.lit(True)))
    rows = langid.predict(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"),
    )


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation damaged, then repaired by its cheapest edits."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    worse = conversation_repair.damage(rows)
    found = conversation_repair.reports(conversation_repair.repair(worse)).join(
        conversation_repair.gaps(worse).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left"
    ).withColumnRenamed("conv_id", "with_rows")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("with_rows")), "left").select(
        "conv_id", *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages of 400 bytes that start anywhere else too."""
    classes, members = suffix_dedup.classes_and_members(table(spark, folder, "documents"))
    digests = classes.select("h1", "h2", "n_bytes", "starts", "stops", F.sha2("kept", 256).alias("kept_sha256"))
    lengths = F.zip_with("starts", "stops", lambda a, b: (b - a).cast("bigint"))
    return members.join(digests, ["h1", "h2"]).select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"), "kept_sha256",
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of each row whose id is divisible by 50, on whole-number vectors and labels with some noise."""
    rows = table(spark, folder, "embeddings").filter(gnat.finite("embedding"))
    rows = rows.select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("embedding"),
    )
    return gnat.hard_negatives(rows, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_nearest": op2_nearest,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_chat": op6_chat,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_training_order": op8_training_order,
    "op9_pii": op9_pii,
    "op10_language": op10_language,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
