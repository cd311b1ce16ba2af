"""Chat formatting with multi-party perspective rotation (operator 2), DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with this
speaker as the assistant and the others as named users.  A rendering is a table
of its turns with their places in the whole text, so that a conversation of any
length needs no task that holds all of it; ``mask`` and the span
[train_begin, train_end) mark what the perspective's own speaker says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm import common

# Fixed values of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: Stands for a speaker whose role is NULL.
NOBODY = "unknown"


def rotate(turns: DataFrame, system: str = "system") -> DataFrame:
    """One row per conversation, perspective and turn.

    Columns: conv_id, perspective, turn, speaker, role (system, assistant or
    user), segment (the turn's text in the template), begin and end (its place
    in the rendering, in characters), mask (True for the perspective's own
    turns), train_begin and train_end (the own words with their closing mark;
    else NULL).  Turns with the role ``system`` keep it in every rendering and
    are no participant; a conversation of system turns alone gives no rows.  A
    NULL role speaks as ``unknown``, a NULL text is empty, NULL conversations
    form one, a NULL turn number comes first; equal numbers follow each other by
    speaker and text, repeated rows count as often as they come.  The template's
    opening ``<|`` is broken up inside texts and speakers' names, and line ends in
    names become spaces, so neither can forge a turn; ``speaker`` and
    ``perspective`` are the names as given.  Other columns are not read."""
    picked = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                          F.coalesce(F.col("role").cast("string"), F.lit(NOBODY)).alias("speaker"),
                          F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("words"))
    people = picked.where(F.col("speaker") != system).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = picked.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    shown = F.replace(F.translate("speaker", LINE_ENDS, " " * len(LINE_ENDS)), F.lit("<|"), F.lit("< |"))
    name = F.when(F.col("speaker").isin(system) | own, F.lit("")).otherwise(F.concat(F.lit(" name="), shown))
    seen = seen.withColumns({"role": role, "head": F.concat(F.lit(OPEN), role, name, F.lit("\n"))})
    seen = seen.withColumns({"segment": F.concat("head", "words", F.lit(CLOSE + "\n")), "mask": own & (F.col("speaker") != system)})
    order = [F.col(c) for c in ("conv_id", "perspective", "turn", "speaker", "words")]
    placed = common.prefix_sums(seen, order, {"_at": F.length("segment")}, "dialogues")
    first = placed.groupBy(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_perspective")).agg(F.min("_at").alias("_first"))
    placed = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_perspective")))
    begin = F.col("_at") - F.col("_first")
    train = begin + F.length("head")
    return placed.select("conv_id", "perspective", "turn", "speaker", "role", "segment", begin.alias("begin"),
                         (begin + F.length("segment")).alias("end"), "mask",
                         F.when(F.col("mask"), train).alias("train_begin"),
                         F.when(F.col("mask"), train + F.length("words") + len(CLOSE)).alias("train_end"))


def renderings(rotated: DataFrame) -> DataFrame:
    """Whole texts: conv_id, perspective, text, spans to train on.

    For conversations that fit into a row; the turns of one are brought together."""
    turns = F.sort_array(F.collect_list(F.struct("begin", "segment", "train_begin", "train_end", "mask")))
    both = rotated.groupBy("conv_id", "perspective").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["mask"]),
                        lambda t: F.struct(t["train_begin"].alias("begin"), t["train_end"].alias("end")))
    return both.select("conv_id", "perspective", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"),
                       spans.alias("spans"))
