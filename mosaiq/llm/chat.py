"""Chat formatting of reply trees.

Messages point to the message they answer. Iterative self-joins double the known part
of every path each round (the ancestors 1, 2, 4, ... steps up), so the rounds grow
with the logarithm of the depth. Each leaf names one branch, from its root to it;
branches are ranked by the sum of their messages' scores, and each chosen branch is
formatted as one conversation.

Template, a turn:

    <turn role=ROLE>
    TEXT
    </turn>

Inside roles and texts a backslash is written \\b, "<" is \\l and ">" is \\g, so the
template's own strings never occur there, and reading back gives the same texts.
The loss mask is a list of spans of code points over the formatted text: the texts of
assistant turns.

Null role or text is empty; a null conversation id is a conversation of its own; turns
that repeat are put in order of turn (null last), role and text; a message whose parent
is missing is a root; messages that only lead round in a circle have no leaf and so no
branch. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.text import bind, cut, portions, running
from mosaiq.plans.lineage import Rounds

# What is written for each character that the template uses.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, MIDDLE, CLOSE = "<turn role=", ">\n", "\n</turn>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def chained(turns: DataFrame) -> DataFrame:
    """Messages ``(conv_id, id, parent, score, role, text)`` of plain conversations: each turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("id"))
    return numbered.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def branches(messages: DataFrame) -> DataFrame:
    """``(conv_id, leaf, id, up)``: every message of each root-to-leaf path, ``up`` steps above its leaf."""
    rounds = Rounds(messages.sparkSession)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    nodes = messages.select("conv_id", "id")
    answered = messages.where("parent is not null").select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).distinct()
    parents = messages.where("parent is not null").select("conv_id", "id", F.col("parent").alias("above"))
    known = nodes.select(F.col("conv_id").alias("c"), F.col("id").alias("p")).distinct()
    jumps = parents.join(known, same("conv_id", "c") & (F.col("above") == F.col("p")), "left_semi")
    leaves = nodes.join(answered, same("conv_id", "c") & (F.col("id") == F.col("p")), "left_anti").distinct()
    paths = leaves.select("conv_id", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    most = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    for k in range(ceil(log2(most)) if most > 1 else 0):
        jumps, paths = rounds.cut(jumps, paths)
        step = jumps.select(F.col("conv_id").alias("c"), F.col("id").alias("p"), "above")
        higher = paths.join(step, same("conv_id", "c") & (F.col("id") == F.col("p"))).select("conv_id", "leaf", F.col("above").alias("id"), (F.col("up") + 2**k).alias("up"))
        paths = paths.unionByName(higher)
        jumps = jumps.join(step.withColumnRenamed("above", "next"), same("conv_id", "c") & (F.col("above") == F.col("p"))).select("conv_id", "id", F.col("next").alias("above"))
    return paths


def formatted(messages: DataFrame, best: int | None = None) -> DataFrame:
    """``(conv_id, leaf, rank, score, formatted, mask)`` of each conversation's ``best`` branches (all, if none is given)."""
    told = messages.select(F.col("conv_id").alias("c"), F.col("id").alias("p"), "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    paths = branches(messages).join(told, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("id") == F.col("p")))
    turn = F.struct((-F.col("up")).alias("at"), escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), F.col("role").alias("raw_role"))
    whole = paths.groupBy("conv_id", "leaf").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    opened = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE))
    text = F.array_join(F.transform("turns", lambda t: F.concat(opened(t), t["text"], F.lit(CLOSE))), "")
    ends = running(F.transform("turns", lambda t: F.length(opened(t)) + F.length(t["text"]) + len(CLOSE)))
    end = lambda e, k: (F.element_at(e, k + 1) - len(CLOSE)).cast("int")
    spans = bind(ends, lambda e: F.transform("turns", lambda t, k: F.struct((end(e, k) - F.length(t["text"])).alias("start"), end(e, k).alias("end"), t["raw_role"].alias("role"))))
    mask = F.transform(F.filter(spans, lambda s: s["role"] == TRAINED_ROLE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return ranked.select("conv_id", "leaf", "rank", "score", text.alias("formatted"), mask.alias("mask"))


def read_back(text: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, MIDDLE, 1)
        body = F.substring(piece, F.length(role) + len(MIDDLE) + 1, F.length(piece))
        return F.struct(unescaped(F.substring(role, len(OPEN) + 1, F.length(role))).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.filter(F.split(text, f"\\Q{CLOSE}\\E"), lambda p: p != ""), turn)


def trained_text(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return bind(portions(text), lambda parts: F.array_join(F.transform(mask, lambda s: unescaped(cut(parts, s["start"], s["end"]))), ""))
