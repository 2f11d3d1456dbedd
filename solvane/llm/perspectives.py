"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that
speaker as the assistant, all other speakers as named users, and system turns as
they are.  What the assistant says, with its end mark, is trained on; the mask is
given as offsets in code points.

The rendering comes as segments, a row for each perspective and turn, in place
and with offsets, so that a conversation of any length is spread over tasks:
running sums go over blocks of turns first and over the blocks' totals then.

Defined results: a null or empty text is an empty turn; a null or blank role is
the speaker "unknown"; rows with a null conv_id are one conversation; a
conversation of system turns only has no participants and no rows; turns of the
same number follow each other by speaker, then by text; repeated rows are turns
of their own; a null turn comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in one block.
BLOCK_TURNS = 1000
# Marks of the rendering.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def rotated(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, perspective, position, turn, speaker, header, segment, start, end, train_start, train_end.

    Segments of one perspective in order of position, put together, are the
    rendered dialogue; start, end, train_start and train_end are offsets in it
    (ends exclusive), the last two null where nothing is trained on.
    """
    role = F.trim(F.col("`role`"))
    turns = conversations.select(
        F.col("`conv_id`").alias("conv_id"),
        F.col("`turn`").cast("long").alias("turn"),
        F.when(role.isNull() | (role == ""), "unknown").otherwise(role).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))))
    # distinct pairs are summed before the shuffle; a conversation's own speakers then meet each of its blocks
    speakers = turns.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    blocks = turns.select(F.col("conv_id").alias("c"), "block").distinct()
    parties = blocks.join(speakers, F.col("c").eqNullSafe(F.col("conv_id"))).select("c", F.col("block").alias("b"), "perspective")
    rows = turns.join(parties, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")

    mine = F.col("speaker") == F.col("perspective")
    header = F.when(F.col("speaker") == SYSTEM, F.lit(f"{OPEN}{SYSTEM}\n")).when(mine, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), "speaker", F.lit("\n")))
    rows = rows.withColumn("header", header).withColumn("segment", F.concat("header", "text", F.lit(f"{CLOSE}\n")))
    rows = rows.withColumn("size", F.char_length("segment").cast("long"))
    key = ["conv_id", "perspective", "block"]
    inside = Window.partitionBy(*key).orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("turn", "speaker", "text")))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key).agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    base = totals.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("chars"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns"))
    rows = rows.join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    end = F.col("chars") + F.col("end")
    start = end - F.col("size")
    trained = lambda x: F.when(mine & (F.col("speaker") != SYSTEM), x)
    return rows.select(
        "conv_id",
        "perspective",
        (F.col("turns") + F.col("nth") - 1).alias("position"),
        "turn",
        "speaker",
        "header",
        "segment",
        start.alias("start"),
        end.alias("end"),
        trained(start + F.char_length("header")).alias("train_start"),
        trained(end - 1).alias("train_end"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, spans): whole rendered dialogues, one row each, for conversations that fit in a row."""
    items = F.array_sort(F.collect_list(F.struct("position", "segment", "train_start", "train_end")))
    each = segments.groupBy("conv_id", "perspective").agg(items.alias("items"))
    spans = F.transform(F.filter("items", lambda x: x["train_start"].isNotNull()), lambda x: F.struct(x["train_start"].alias("start"), x["train_end"].alias("end")))
    return each.select("conv_id", "perspective", F.array_join("items.segment", "").alias("text"), spans.alias("spans"))
