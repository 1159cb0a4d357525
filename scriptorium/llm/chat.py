"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as assistant, the others as named
users and system turns as they are; the loss mask covers the text and end mark of the assistant's turns.

The result has one row per turn and perspective with its place in the rendered dialogue, so a conversation of any length
is never in one task: offsets are prefix sums within blocks of BLOCK turns plus prefix sums over blocks.
`dialogues` joins the segments of conversations into strings.

Defined cases: null role is `unknown`, null text is empty, a null turn comes first, a null conv_id is a conversation of its
own; ties and repeated rows of a turn are ordered by role and text and all kept; a conversation of system turns alone has no perspective.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, role, name, segment, start, mask_start, mask_end (code points; equal where masked out)."""
    turns = conversations.select(
        F.struct(F.coalesce("conv_id", F.lit(0)).alias("id"), F.col("conv_id").isNull().alias("none")).alias("k"), "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("name"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)), F.lit(-(1 << 40))).alias("block"),
    )
    speakers = turns.where(F.col("name") != SYSTEM).select("k", F.col("name").alias("perspective")).distinct()
    rows = turns.join(speakers, "k")
    own = F.col("name") == F.col("perspective")
    role = F.when(F.col("name") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    head = F.concat(F.lit(START), role, F.when(role == "user", F.concat(F.lit(" name="), F.col("name"))).otherwise(F.lit("")), F.lit("\n"))
    rows = rows.select("k", "conv_id", "perspective", "turn", "block", "name", role.alias("role"), F.concat(head, "text", F.lit(END)).alias("segment"), F.length(head).cast("bigint").alias("head"))
    rows = rows.withColumn("size", F.length("segment").cast("bigint"))
    sums = rows.groupBy("k", "perspective", "block").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("k", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("k", "perspective", "block", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("k", "perspective", "block").orderBy("turn", "name", "segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("upto", F.sum("size").over(inside)).join(before, ["k", "perspective", "block"])
    start = F.col("before") + F.col("upto") - F.col("size")
    own = F.col("role") == "assistant"
    return out.select(
        "conv_id", "perspective", "turn", "role", "name", "segment", start.alias("start"),
        F.when(own, start + F.col("head")).otherwise(start).alias("mask_start"), F.when(own, start + F.col("size")).otherwise(start).alias("mask_end"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, dialogue and masks of conversations that fit in a row (their segments are gathered)."""
    g = segments.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end"))).alias("s"))
    masks = F.filter(F.transform("s", lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))), lambda m: m["start"] < m["end"])
    return g.select("conv_id", "perspective", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("dialogue"), masks.alias("masks"))


def op9(conversations: DataFrame) -> DataFrame:
    return rotate(conversations).select("conv_id", "perspective", "turn", "role", "name", "segment", "start", "mask_start", "mask_end")
