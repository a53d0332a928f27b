"""Chat formatting of reply trees: every root-to-leaf path becomes one conversation.

Paths are enumerated by iterative self-joins with doubling steps: after k rounds a leaf knows its
nearest 2^k ancestors, so a thread of n turns takes about log2(n) rounds.  Branches are ranked by
the sum of their scores, and each path is written as

    ### role: text</turn>\\n

with control strings inside roles and texts escaped reversibly: a backslash as \\b, "### " as \\h,
"</turn>" as \\t, and in roles ":" as \\c.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TURN, STOP = "### ", "</turn>"
_NONE = -(2**63)


def escape(c: Column) -> Column:
    for find, put in (("\\", "\\b"), (TURN, "\\h"), (STOP, "\\t")):
        c = F.replace(c, F.lit(find), F.lit(put))
    return c


def unescape(c: Column) -> Column:
    # every backslash in escaped text leads one of four pairs, so the order is free but for the last
    for put, find in (("\\c", ":"), ("\\h", TURN), ("\\t", STOP), ("\\b", "\\")):
        c = F.replace(c, F.lit(put), F.lit(find))
    return c


def _paths(nodes: DataFrame) -> DataFrame:
    """conv, leaf, node, up (steps above the leaf) of all root-to-leaf paths of (conv, node, parent)."""
    has = nodes.select("conv", F.col("node").alias("parent")).distinct()
    links = nodes.join(has, ["conv", "parent"], "left_semi").select("conv", "node", F.col("parent").alias("over"))
    inner = nodes.where("parent IS NOT NULL").select("conv", F.col("parent").alias("node")).distinct()
    leaves = nodes.join(inner, ["conv", "node"], "left_anti")
    paths = written(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    links = written(links)
    step, total = 1, nodes.count()
    while step <= total and not links.isEmpty():
        further = paths.join(links, ["conv", "node"]).select("conv", "leaf", F.col("over").alias("node"), (F.col("up") + step).alias("up"))
        paths = written(paths.unionByName(further))
        above = links.select("conv", F.col("node").alias("over"), F.col("over").alias("far"))
        links = written(links.join(above, ["conv", "over"]).select("conv", "node", F.col("far").alias("over")))
        step *= 2
    return paths


def format_trees(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, leaf_id, branch_rank, score, n_turns, formatted, loss_mask for every root-to-leaf path.

    ``messages``: conv_id, msg_id, parent_id, role, text, score; (conv_id, msg_id) names a message, and
    rows that repeat it count once (the first by parent, role, text).  A message whose parent is null or
    missing is a root; messages that only form a cycle have no leaf and so stand on no path.  Null roles and texts are empty, a null score is 0,
    rows without a msg_id are left out.  Branches of a conversation rank by score, ties by leaf_id.

    loss_mask: for each turn {turn_start, start, stop} in code points of ``formatted``; the text of a turn
    of ``loss_role`` lies under the mask, other turns have start = stop.  Empty input gives an empty table; other
    columns are not read.  A path is one row of the result, so its turns meet in one task; paths share turns, so a
    tree like a comb, with a leaf at each of n turns, has n^2 / 2 turns in its paths, and as many are written.
    """
    one = Window.partitionBy("conv", "node").orderBy("parent", "role", "text", "score")
    rows = messages.where("msg_id IS NOT NULL").select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NONE)).alias("conv"), F.col("msg_id").cast("long").alias("node"), F.col("parent_id").cast("long").alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    paths = _paths(rows.select("conv", "node", "parent"))
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    body = escape(F.col("text"))
    turn = paths.join(rows, ["conv", "node"]).select(
        "conv", "leaf", "up", "score", F.concat(head, body, F.lit(STOP + "\n")).alias("segment"), F.char_length(head).cast("long").alias("head"), F.when(F.col("role") == loss_role, F.char_length(body)).otherwise(0).cast("long").alias("under"),
    )
    path = Window.partitionBy("conv", "leaf").orderBy(F.desc("up"))
    start = F.coalesce(F.sum(F.char_length("segment")).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    turn = turn.withColumn("at", start)
    mask = F.struct(F.col("at").alias("turn_start"), (F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.col("head") + F.col("under")).alias("stop"))
    whole = turn.groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "segment", mask.alias("mask")))).alias("turns"), F.sum("score").alias("score"), F.count("*").alias("n_turns"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf"))
    return whole.select(
        F.when(F.col("conv") != _NONE, F.col("conv")).alias("conv_id"), F.col("leaf").alias("leaf_id"), rank.alias("branch_rank"), "score", "n_turns",
        F.array_join("turns.segment", "").alias("formatted"), F.col("turns.mask").alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns array<struct<role, text, loss>> parsed from ``formatted`` and ``loss_mask`` alone."""
    chunks = F.split("formatted", F.lit(STOP + "\n"))
    pair = F.arrays_zip(F.slice(chunks, F.lit(1), F.size(chunks) - 1).alias("chunk"), F.col("loss_mask").alias("mask"))

    def parse(p: Column) -> Column:
        chunk, m = p["chunk"], p["mask"]
        role = F.substring_index(chunk, ": ", 1)
        return F.struct(
            unescape(F.substr(role, F.lit(len(TURN) + 1))).alias("role"),
            unescape(F.substr(chunk, F.char_length(role) + 3)).alias("text"),
            unescape(F.substr(chunk, (m["start"] - m["turn_start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int"))).alias("loss"),
        )

    return formatted.withColumn("_pairs", pair).withColumn("turns", F.transform("_pairs", parse)).drop("_pairs")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    """Each conversation is a thread: the parent of a turn is the turn before it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    threads = rows.unionByName(extra).select("conv_id", F.row_number().over(order).cast("long").alias("msg_id"), "role", "text", F.lit(0.0).alias("score"))
    threads = threads.withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))
    out = read_back(format_trees(threads))
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
