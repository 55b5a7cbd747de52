"""Chat formatting of reply trees, with DataFrame operations only.

Method: messages form trees by their parent. Iterative self-joins double the reach of a jump table (node -> the
ancestor 2^k above it), so depth d takes log2(d) rounds. A pass from the longest jump down gives every leaf its
depth and the sum of scores up to the root; branches are ranked by that sum; the chosen leaves' paths are enumerated
with the same jumps and each path becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message. Inside texts and roles, ``<``, any backslashes and
``|`` get one backslash more after the ``<``, so no text holds a control string; line feeds in roles become
``<|nl|>``. Both are undone when the output is read.

Defined results: null texts and roles count as empty; null scores as 0; a null tree id is one tree of its own; a parent
that does not exist (or null) makes a root; messages whose ancestors form a ring have no root and are left out; of
messages with the same id in a tree the least by (parent, role, text) counts; among equal branch scores the smaller
leaf id goes first; an empty table gives an empty table; other columns are ignored. One conversation is one value, so
its rows meet in one task; conversations do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindlewatch.llm.common import written

# Fixed values of the template.
START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _nodes(messages: DataFrame) -> DataFrame:
    """tree, node, parent, role, text, score: one row a node, parents that do not exist set to null."""
    rows = messages.select(
        F.col("tree_id").alias("tree"), F.col("node_id").alias("node"), F.col("parent_id").alias("parent"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).filter("node IS NOT NULL")
    one = rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    rows = one.select("tree", "node", "m.*")
    known = rows.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    return rows.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left").select(
        "tree", "node", F.col("p").alias("parent"), "role", "text", "score"
    )


def _step(rows: DataFrame, jump: DataFrame, at: str, how: str) -> DataFrame:
    jump = jump.select(F.col("tree").alias("jt"), F.col("node").alias("jn"), F.col("up").alias("ju"), F.col("gain").alias("jg"))
    return rows.join(jump, F.col("tree").eqNullSafe(F.col("jt")) & (F.col(at) == F.col("jn")), how)


def branches(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """Root-to-leaf paths: tree, leaf, rank (from 1), branch_score, depth, position (from 0), role, text.

    ``per_tree`` keeps the best branches of each tree; None keeps all.
    """
    nodes = written(_nodes(messages), "chat-nodes")
    # of each node: the ancestor 2^k above, and the scores of the 2^k nodes below that ancestor
    jumps = [nodes.filter("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("gain"))]
    most = nodes.count()
    while (1 << len(jumps)) <= most:
        last = jumps[-1]
        longer = written(
            _step(last, last, "up", "inner").select("tree", "node", F.col("ju").alias("up"), (F.col("gain") + F.col("jg")).alias("gain")),
            "chat-jumps",
        )
        if longer.isEmpty():
            break
        jumps.append(longer)
    inner = nodes.select(F.col("tree").alias("jt"), F.col("parent").alias("jn")).filter("jn IS NOT NULL")
    leaves = nodes.join(inner, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("node") == F.col("jn")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("depth")
    )
    for k in range(len(jumps) - 1, -1, -1):
        leaves = _step(leaves, jumps[k], "at", "left").select(
            "tree", "leaf", F.coalesce("ju", "at").alias("at"), (F.col("total") + F.coalesce("jg", F.lit(0.0))).alias("total"),
            (F.col("depth") + F.when(F.col("ju").isNotNull(), F.lit(1 << k)).otherwise(0)).alias("depth"),
        )
    roots = nodes.filter("parent IS NULL").select(F.col("tree").alias("jt"), F.col("node").alias("jn"), "score")
    leaves = leaves.join(roots, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("at") == F.col("jn"))).select(
        "tree", "leaf", (F.col("total") + F.col("score")).alias("branch_score"), "depth"
    )
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    if per_tree is not None:
        leaves = leaves.filter(F.col("rank") <= per_tree)
    paths = leaves.select("*", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("below"))
    for k, jump in enumerate(jumps):
        above = _step(paths, jump, "node", "inner")
        paths = paths.unionByName(
            above.select(*leaves.columns, F.col("ju").alias("node"), (F.col("below") + (1 << k)).alias("below"))
        )
        paths = written(paths, "chat-paths")
    said = nodes.select(F.col("tree").alias("jt"), F.col("node").alias("jn"), "role", "text")
    return paths.join(said, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("node") == F.col("jn"))).select(
        "tree", "leaf", "rank", "branch_score", (F.col("depth") + 1).alias("depth"),
        (F.col("depth") - F.col("below")).alias("position"), "role", "text",
    )


def format_paths(paths: DataFrame) -> DataFrame:
    """One row a path: tree, leaf, rank, branch_score, formatted, loss_spans (start and length in ``formatted``)."""
    turns = paths.select(
        "tree", "leaf", "rank", "branch_score", "position", (F.col("role") == TRAINED_ROLE).alias("trained"),
        F.concat(F.lit(START), F.regexp_replace(escape(F.col("role")), "\n", LINE), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head") + F.length("body") + F.lit(len(END))
    turns = turns.select(
        "tree", "leaf", "rank", "branch_score", "position", "trained",
        F.concat("head", "body", F.lit(END)).alias("turn"),
        (F.sum(size.cast("bigint")).over(before) - F.length("body") - F.lit(len(END))).alias("start"),
        F.length("body").cast("bigint").alias("length"),
    )
    grouped = turns.groupBy("tree", "leaf", "rank", "branch_score").agg(
        F.sort_array(F.collect_list(F.struct("position", "turn", "trained", "start", "length"))).alias("turns")
    )
    return grouped.select(
        "tree", "leaf", "rank", "branch_score",
        F.concat_ws("", F.transform("turns", lambda t: t["turn"])).alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["trained"]),
            lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
        ).alias("loss_spans"),
    )


def format_trees(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """Messages (tree_id, node_id, parent_id, role, text, score) as formatted conversations; see ``format_paths``."""
    return format_paths(branches(messages, per_tree))


def read_back(formatted: DataFrame) -> DataFrame:
    """The formatted conversations with ``turns`` (role, text) and ``loss_text`` read from text and mask."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: F.startswith(p, F.lit(START)))
    opened = F.transform(pieces, lambda p: F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1))
    turns = F.transform(
        F.arrays_zip(pieces.alias("piece"), opened.alias("role")),
        lambda t: F.struct(
            unescape(F.regexp_replace(t["role"], r"<\|nl\|>", "\n")).alias("role"),
            unescape(F.substr(t["piece"], F.length(t["role"]) + F.lit(len(START) + 2))).alias("text"),
        ),
    )
    loss = F.transform(
        "loss_spans",
        lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    return formatted.withColumns({"turns": turns, "loss_text": F.concat_ws("", loss)})


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees in which each row replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node_id", F.row_number().over(order))
    return rows.select(
        F.col("conv_id").alias("tree_id"), "node_id",
        F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"),
    )
