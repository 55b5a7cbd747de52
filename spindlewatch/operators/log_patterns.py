"""Log messages clustered into templates, and templates that come up anew.

Numbers are masked first; what is left to find are variable words: names, files, addresses. Different masked messages (not
lines) are put into groups by their number of words, and a group is split, again and again, at the position whose words say least,
that is where few words take most of the messages: with N messages and S the sum of squared word counts, N * N / S is the
effective number of words there, and a position splits while that is at most the square root of N. Whole numbers
decide, so results do not hang on rounding. Positions that still differ within a group at the end are variables. Templates that
differ at one position only are then merged there if at least ``merge_at`` of them do, found by equal keys with
that position left out, not by comparing pairs.

Everything is a grouping or a join; what is gathered in one row is one message's words. Each round is written to the shared
folder, since it is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindlewatch.operators.alerts import log_template
from spindlewatch.session import shared_path

VARIABLE = "<*>"


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(message: Column) -> Column:
    """The words of a message with numbers masked; empty for a null one."""
    return F.filter(F.split(F.coalesce(log_template(message), F.lit("")), "\\s+"), lambda x: x != "")


def _split_once(messages: DataFrame) -> DataFrame:
    """Groups split at the position of least effective words, where that is low enough."""
    counts = messages.select("grp", F.posexplode("words").alias("pos", "word")).groupBy("grp", "pos", "word").agg(
        F.count(F.lit(1)).alias("c")
    )
    squares = counts.groupBy("grp", "pos").agg(
        F.count(F.lit(1)).alias("d"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s")
    )
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    choice = squares.filter((F.col("d") > 1) & (n * n * n <= s * s)).groupBy("grp").agg(
        F.max(F.struct("s", (-F.col("pos")).alias("at"))).alias("best")
    ).select("grp", (-F.col("best.at")).alias("at"))
    word = F.element_at("words", F.col("at") + 1)
    grp = F.when(F.col("at").isNull(), F.col("grp")).otherwise(F.concat_ws(" ", "grp", F.col("at").cast("string"), word))
    return messages.join(choice, "grp", "left").select("text", "words", grp.alias("grp"))


def _templates(messages: DataFrame) -> DataFrame:
    """(grp, template) with the words all messages of a group share."""
    places = messages.select("grp", F.posexplode("words").alias("pos", "word")).groupBy("grp", "pos").agg(
        F.min("word").alias("low"), F.max("word").alias("high")
    )
    shown = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(VARIABLE)
    return places.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("word")))).alias("p")).select(
        "grp", F.transform("p", lambda x: x["word"]).alias("template")
    )


def _merge_once(named: DataFrame, merge_at: int) -> DataFrame:
    """(grp, template) with templates merged that differ at one position, the one most of them share."""
    places = named.select("template").distinct().select("template", F.posexplode("template").alias("pos", "word"))
    left_out = F.concat(F.slice("template", 1, F.col("pos")), F.array(F.lit(VARIABLE)), F.expr("slice(template, pos + 2, size(template))"))
    keyed = places.select("template", "pos", left_out.alias("merged"))
    sizes = keyed.groupBy("pos", "merged").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= merge_at)
    best = keyed.join(sizes, ["pos", "merged"]).groupBy("template").agg(
        F.max(F.struct("c", (-F.col("pos")).alias("at"), "merged")).alias("best")
    ).select("template", F.col("best.merged").alias("merged"))
    return named.join(best, "template", "left").select("grp", F.coalesce("merged", "template").alias("template"))


def message_templates(
    log: DataFrame, message: str = "error_msg", depth: int = 4, merge_at: int = 5, merges: int = 2
) -> DataFrame:
    """(text, template) for every different message, ``text`` being the message with numbers masked."""
    texts = log.select(F.array_join(words(F.col(message)), " ").alias("text")).distinct()
    cut = F.filter(F.split("text", " "), lambda x: x != "")
    messages = _kept(texts.select("text", cut.alias("words"), F.size(cut).cast("string").alias("grp")), "log-messages")
    for _ in range(depth):
        messages = _kept(_split_once(messages), "log-groups")
    named = _templates(messages)
    for _ in range(merges):
        named = _merge_once(_kept(named, "log-templates"), merge_at)
    found = messages.join(named, "grp", "left")
    return _kept(found.select("text", F.coalesce(F.array_join("template", " "), F.lit("")).alias("template")), "log-found")


def assign_templates(log: DataFrame, templates: DataFrame, message: str = "error_msg") -> DataFrame:
    """The log lines with their ``template``; lines of messages that ``templates`` does not know have null."""
    text = F.array_join(words(F.col(message)), " ")
    known = templates.select(F.col("text").alias("_text"), "template")
    return log.withColumn("_text", text).join(known, "_text", "left").drop("_text")


def pattern_counts(assigned: DataFrame) -> DataFrame:
    """Lines and first and last time of each template."""
    return assigned.groupBy("template").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def new_patterns(assigned: DataFrame, history_seconds: int = 600, seconds: int = 60) -> DataFrame:
    """Windows in which a template shows up that no line of the ``history_seconds`` before them had.

    The log's first ``history_seconds`` are taken as known. ``silent_seconds`` is null for a template never seen before. What is
    ordered is a template's windows, not its lines.
    """
    size = f"{seconds} seconds"
    counts = assigned.groupBy(F.window("timestamp", size).alias("_w"), "template").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("_w.start").alias("window_start"), "template", "n"
    )
    begun = counts.agg(F.unix_seconds(F.min("window_start")).alias("_begun"))
    at = F.unix_seconds("window_start")
    silent = at - F.lag(at).over(W.partitionBy("template").orderBy("window_start")) - seconds
    return (
        counts.withColumn("silent_seconds", silent)
        .filter((at - begun.scalar() >= history_seconds) & (F.col("silent_seconds").isNull() | (F.col("silent_seconds") >= history_seconds)))
    )
