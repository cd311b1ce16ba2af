"""Mixing sources to target weights (operator 9), DataFrame functions only.

Every document gets a key that a hash of its id gives.  The documents are
range-sorted by (source, key), distributed prefix sums of their sizes place each
one on its source's line, and the line is cut at the source's exact budget.  A
budget above the source's size goes round the line again (epochs).  A hot source
is spread over as many range partitions as its rows need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailycast.llm import common


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size; one row each) with ``target``, in words.

    Sources in code-point order, NULL last, take the ``weights`` in turn.  The
    sum of all sizes is shared by weight; no target exceeds ``epochs`` times its
    source's size, and the excess is shared again by weight.  That is: in the
    order of limit / weight, a source keeps its limit while its fair share of
    what is left lies above it."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("_r", F.row_number().over(by_name)).withColumn(
        "_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_r") - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumns({"_left": F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
                                 "_weights": F.sum("_w").over(after)})
    ranked = ranked.withColumn("_full", F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("_w"))
    open_left = F.first(F.when(~F.col("_full"), F.struct("_left", "_weights")), ignorenulls=True).over(whole)
    ranked = ranked.withColumn("_open", open_left)
    share = F.col("_open._left") * F.col("_w") / F.col("_open._weights")
    return ranked.select("source", "source_size",
                         F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def draw_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 9) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``size`` counts words (NULL text: 0); ``taken`` counts the words that the mix
    takes of it, repeats included: whole epochs plus what lies below the cut,
    which may go through one document of each source.  A NULL source is a source;
    NULL ids share one key; repeated rows count as often as they come; an empty
    table gives no rows; other columns are not read."""
    return _plan(docs, weights, epochs, seed).select("doc_id", "source", "size", "source_size", "target", "taken")


def _plan(docs: DataFrame, weights: tuple[int, ...], epochs: int, seed: int, *keep: str) -> DataFrame:
    """``mix`` with the columns ``keep`` of ``docs``, which also order rows of the same id and size."""
    sizes = common.staged(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"),
                                      common.word_count(F.col("text").cast("string")).alias("size"), *keep), "mix-sizes")
    table = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    by_name = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_first", F.coalesce(F.sum("source_size").over(by_name), F.lit(0)))
    order = [F.col("source").isNull(), F.col("source"), draw_key(F.col("doc_id"), seed), F.col("doc_id"), F.col("size"), *map(F.col, keep)]
    placed = common.prefix_sums(sizes, order, {"_before": F.col("size")}, "mix-order")
    placed = placed.withColumnRenamed("source", "_source")
    both = placed.join(table, F.col("_source").eqNullSafe(F.col("source")))
    budget = F.round("target").cast("long")
    rest = budget - F.col("_epochs") * F.col("source_size")
    both = both.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_before") - F.col("_first"))))
    return both.select("doc_id", "source", "size", "source_size", "target", *keep,
                       (F.col("_epochs") * F.col("size") + cut).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 9) -> DataFrame:
    """The documents of the mix: ``docs``' own columns, a row for each epoch that takes the document.

    The document at a source's cut keeps its first words only (its text up to the
    end of the last of them).  Each row goes by a key of its own, so rows with a
    NULL or repeated doc_id each get what the mix takes of them; documents
    without words are kept once, since no budget decides on them."""
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    # the key is written with the rows, so that both readers see the same one
    rows = common.staged(docs.withColumns({"_hash": F.xxhash64(*plain), "_row": F.monotonically_increasing_id()}), "mix-rows")
    plan = _plan(rows, weights, epochs, seed, "_hash", "_row").select("_row", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    both = rows.join(plan, "_row")
    times = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.ceil(F.col("_taken") / F.col("_size"))).cast("int")
    both = both.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    left = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")
    pieces = F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{common.WORD})"), F.lit(1))  # each word with the space before it
    part = F.array_join(F.slice(pieces, F.lit(1), left.cast("int")), "")
    cut = left < F.col("_size")
    out = {"text": F.when(cut, part).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut, F.length(part).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return both.withColumns(out).select(*docs.columns)
