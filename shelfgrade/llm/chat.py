"""Reply trees as conversations.

``root_to_leaf_paths`` lists, for every leaf of every tree, its ancestors up to the root. It joins the
replies with themselves by doubled jumps: after round k each leaf has its ancestors up to distance 2^k, so
that a thread of n replies takes log2(n) rounds, each a join on (tree, node), which no hot tree can skew.
``best_paths`` ranks the branches of a tree by their mean score, and ``format_paths`` writes each chosen
branch as one conversation.

Template of a turn: ``<|im_start|>``, role, newline, text, ``<|im_end|>``, newline. Within texts and roles a
backslash is doubled and ``<|`` becomes ``<\\|``; within roles a newline becomes ``<\\/``. No control string can
then occur inside a text, and ``read_turns`` gets roles and texts back exactly.

Defined results: a missing text or role is empty; a missing score counts 0; a reply whose parent is missing
from its tree is a root; equal scores rank the longer branch first, then the smaller leaf; branches that
hang off a cycle of replies have no root and give no conversation; empty tables give empty results. Node
numbers must be unique within a tree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfgrade.staging import stage

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def root_to_leaf_paths(replies: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every leaf's ancestors, ``up`` steps above it (0: itself).

    ``replies`` has the columns tree, node and parent.
    """
    links = replies.select("tree", F.col("parent").alias("node"), F.col("node").alias("child")).where("node IS NOT NULL")
    known = replies.select("tree", "node")
    jumps = stage(links.join(known, ["tree", "node"]).select("tree", F.col("child").alias("node"), F.col("node").alias("to")), "jumps")
    parents = jumps.frame.select("tree", F.col("to").alias("node")).distinct()
    leaves = known.join(parents, ["tree", "node"], "left_anti")
    paths = stage(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths").frame
    rounds, reach = 1 + math.ceil(math.log2(max(1, jumps.rows) + 1)), 1
    while jumps.rows and rounds:
        further = paths.join(jumps.frame, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up"))
        paths = paths.unionByName(stage(further, "paths").frame)
        second = jumps.frame.select("tree", F.col("node").alias("to"), F.col("to").alias("beyond"))
        jumps = stage(jumps.frame.join(second, ["tree", "to"]).select("tree", "node", F.col("beyond").alias("to")), "jumps")
        reach, rounds = 2 * reach, rounds - 1
    if jumps.rows:  # a cycle
        endless = paths.join(jumps.frame, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
        paths = paths.join(endless, ["tree", "leaf"], "left_anti")
    return paths


def best_paths(paths: DataFrame, replies: DataFrame, keep: int | None = 1) -> DataFrame:
    """The ``keep`` best branches of each tree (all for None), as paths with their rank."""
    scored = paths.join(replies.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    branches = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.count("*").alias("length"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("length"), "leaf")
    ranked = branches.select("tree", "leaf", "score", F.row_number().over(order).alias("rank"))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    return paths.join(ranked, ["tree", "leaf"])


def format_paths(paths: DataFrame, replies: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss_spans): one conversation per branch.

    ``loss_spans`` holds the turn (from 0), start and end (exclusive, in code points of ``formatted``) of
    every assistant text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = replies.select("tree", "node", (role == "assistant").alias("loss"), _escape_role(role).alias("role"), escape(text).alias("text"))
    piece = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n")).alias("piece")
    size = F.length("role") + F.length("text") + len(START) + len(END) + 2
    # The path is summed up in order, so that a turn knows where it starts in the conversation.
    so_far = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)
    placed = paths.select("tree", "leaf", "node", "up").join(turns, ["tree", "node"]).withColumn("end", F.sum(size).over(so_far) - len(END) - 1)
    one = F.struct((-F.col("up")).alias("at"), piece, "loss", (F.col("end") - F.length("text")).alias("start"), "end")
    gathered = placed.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    numbered = F.transform("turns", lambda t, i: F.struct(t["loss"].alias("loss"), i.alias("turn"), t["start"].alias("start"), t["end"].alias("end")))
    spans = F.transform(F.filter(numbered, lambda t: t["loss"]), lambda t: F.struct(t["turn"].alias("turn"), t["start"].alias("start"), t["end"].alias("end")))
    return gathered.select("tree", "leaf", F.array_join("turns.piece", "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring_index(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p)), END, 1)).alias("text"),
        ),
    )


def read_loss(turns: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, from a column of ``read_turns``."""
    return F.array_join(F.transform(loss_spans, lambda span: turns[span["turn"]]["text"]), "")
