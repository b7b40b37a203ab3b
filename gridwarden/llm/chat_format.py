"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that participant as the
assistant and all others as named users. The result has one row a turn and perspective: the
rendered piece, its place in the rendered dialogue, and the span that a model is trained on,
which is the text of the assistant's turns with the closing mark. Pieces in order of
`char_start` make up the dialogue, so a long conversation is never gathered into one row; the
places come from sums over chunks of turns and running sums within a chunk, so not even its
lengths meet in one task. Chunks are cut by the place of a turn among all turns in order, so any
number of turns may have the same number, or none.

Defined results: turns are ordered by number, role and text, equal rows repeatedly; a null turn
comes first. A null role is the participant `unknown`, null text is empty, rows with a null
conversation form one conversation. Names are cut to letters, digits, `_` and `-`; what is not
of these becomes `_`, so names that differ in nothing else look the same. Marks in a text are broken up by a space, so text cannot forge a turn.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.operators.numbering import number_rows
from gridwarden.session import written

START, END = "<|im_start|>", "<|im_end|>"
CHUNK = 512  # turns whose lengths one window sees


def _clean(text: Column) -> Column:
    text = F.replace(text, F.lit("<|im_"), F.lit("<| im_"))
    return text


def rotate(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """conv_id, perspective, turn, speaker, piece, char_start, char_end (of the piece),
    train_start, train_end (null for turns of others)."""
    turns = conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col("conv_id"), F.col("turn"), F.col("speaker"), F.col("text"), F.col("nth")]
    turns = number_rows(turns.withColumn("nth", F.monotonically_increasing_id()), order, "place").drop("nth")
    turns = written(turns.withColumn("chunk", F.expr(f"place div {chunk}")), "turns")
    people = turns.groupBy("conv_id", "speaker").agg(F.count("*").alias("n")).select(
        F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")
    )
    own = F.col("speaker") == F.col("perspective")
    name = F.regexp_replace("speaker", r"[^A-Za-z0-9_-]", "_")
    head = F.when(own, F.lit(f"{START}assistant\n")).otherwise(
        F.concat(F.lit(f"{START}user name="), name, F.lit("\n"))
    )
    pieces = (
        turns.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
        .withColumn("head", head)
        .withColumn("piece", F.concat("head", _clean(F.col("text")), F.lit(f"{END}\n")))
        .withColumn("size", F.length("piece").cast("long"))
    )
    totals = pieces.groupBy("conv_id", "perspective", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("chunk").alias("k"),
        F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("chunk_start"),
    )
    upto = (
        Window.partitionBy("conv_id", "perspective", "chunk")
        .orderBy("place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("c"))
        & (F.col("perspective") == F.col("p"))
        & (F.col("chunk") == F.col("k"))
    )
    placed = pieces.withColumn("upto", F.sum("size").over(upto)).join(starts, same).withColumn(
        "char_end", F.col("chunk_start") + F.col("upto")
    )
    start = F.col("char_end") - F.col("size")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "piece",
        start.alias("char_start"), "char_end",
        F.when(own, start + F.length("head")).alias("train_start"),
        F.when(own, F.col("char_end") - 1).alias("train_end"),
    )
