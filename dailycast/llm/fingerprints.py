"""I-Match fingerprints (operator 4), DataFrame functions only.

The lexicon holds the terms whose inverse document frequency lies in a band; the
band's lower frequency is a share of all documents, so the lexicon's size is
bounded by the mean number of terms per document over that share, whatever the
corpus.  A document's in-band terms are sorted and made distinct; each randomised
subset of the lexicon keeps some of them, and the hash of what it keeps is one
part of the fingerprint.  Two fingerprints are as alike as the share of their
parts that agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dailycast.llm import common

#: Shares of documents that hold a term: the band's limits.
LOW, HIGH = 0.005, 0.2
#: How many subsets keep one term in how many.
SUBSETS = ((4, 4), (60, 128))
PARTS = sum(n for n, _ in SUBSETS)
#: A part whose subset keeps no term.
NONE = "-"
#: In-band terms that fill fewer parts than these, and are less than half of the text's terms, give way to all of them.
FILLED = 2


def terms(text: Column) -> Column:
    """Hashes of a text's distinct words in lower case (64 bits)."""
    found = F.array_distinct(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return F.transform(found, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms with a document frequency inside the band, over all documents."""
    n = docs.count()
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col("text").cast("string")), r"[\x20\x09-\x0D]+"))).alias("w")).where("w <> ''")
    counts = words.groupBy(F.xxhash64("w").alias("term")).count()
    band = counts.where((F.col("count") >= math.ceil(low * n)) & (F.col("count") <= math.floor(high * n)))
    return sorted(r["term"] for r in band.select("term").collect())  # bounded by mean terms per document / low


def _constant(numbers: list[int]) -> Column:
    """One array literal (the optimiser folds it once; a column per number would be planned one by one)."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>") if numbers else F.array().cast("array<bigint>")


def _parts(own: Column) -> Column:
    """The fingerprint's parts: hashes of the sorted terms that each randomised subset keeps."""
    def keep(terms_: Column, number: Column) -> Column:
        mask, below = F.lit(SUBSETS[-1][1] - 1), PARTS
        for many, one_in in reversed(SUBSETS):
            mask = F.when(number < below, one_in - 1).otherwise(mask)
            below -= many
        return F.xxhash64(F.filter(terms_, lambda t: F.xxhash64(t, number).bitwiseAND(mask) == 0))

    # the terms are repeated (by reference) rather than captured, else they would be worked out again for every subset
    hashes = F.transform(F.array_repeat(own, PARTS), keep)
    nothing = F.xxhash64(F.array().cast("array<bigint>"))
    return F.transform(hashes, lambda h: F.when(h == nothing, F.lit(NONE)).otherwise(F.right(F.lower(F.hex(h)), F.lit(8))))


def _filled(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda p: p != NONE))


def _whole(own: Column) -> Column:
    """A print whose first part is the hash of all terms, for texts of which no subset keeps any."""
    return F.concat(F.array(F.right(F.lower(F.hex(F.xxhash64(own))), F.lit(8))), F.array_repeat(F.lit(NONE), PARTS - 1))


def with_parts(rows: DataFrame, texts: list[str], kept: Column) -> DataFrame:
    """``rows`` with the parts of each text column in its place.

    The terms are those in the band, sorted.  If they fill fewer than ``FILLED``
    parts and are less than half of the text's terms, the text uses all of its
    terms, so that it still differs from others; if no part is filled then, the first one is the hash of them all, so that only a
    text without terms has an empty print.  Each step is a projection of its
    own, so that none is worked out twice."""
    rest = [c for c in rows.columns if c not in texts]
    rows = rows.select(*rest, *(terms(F.col(c)).alias(c) for c in texts))
    rows = rows.select(*rest, *texts, *(F.array_intersect(kept, F.col(c)).alias(f"_{c}") for c in texts))
    rows = rows.select(*rest, *(F.sort_array(c).alias(c) for c in texts), *(_parts(F.sort_array(f"_{c}")).alias(f"_{c}") for c in texts),
                       *((F.size(f"_{c}") * 2 >= F.size(c)).alias(f"_half_{c}") for c in texts))
    rows = rows.select(*rest, *texts, *(F.when((_filled(F.col(f"_{c}")) >= FILLED) | F.col(f"_half_{c}"), F.col(f"_{c}")).otherwise(_parts(F.col(c))).alias(f"_{c}")
                                        for c in texts))
    empty = [(_filled(F.col(f"_{c}")) == 0) & (F.size(c) > 0) for c in texts]
    return rows.select(*rest, *(F.when(e, _whole(F.col(c))).otherwise(F.col(f"_{c}")).alias(c) for e, c in zip(empty, texts)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that are not empty in both; without any, 1 if the prints are equal."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == NONE) & (y == NONE), F.lit(None)).otherwise((x == y).cast("int")))
    used = F.filter(both, lambda x: x.isNotNull())
    agree = F.aggregate(used, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(used) > 0, agree / F.size(used)).otherwise((a == b).cast("double"))


def _in_block() -> WindowSpec:
    """Within a block, documents in descending doc_id, then the copy of the next block's first one."""
    return Window.partitionBy("b").orderBy("copy", F.col("doc_id").desc_nulls_last(), "_h")


def with_next(docs: DataFrame, copies: bool = False) -> DataFrame:
    """doc_id, text (NULL: empty) and next_text: the text of the next document in descending doc_id.

    ``copies`` leaves the copied rows in (copy = 1, in the order of ``_in_block``)
    for other values of the next document.

    After the last comes the first.  NULL ids come last; rows of one id follow
    each other by their text's hash.  Texts move once: the ids alone are sorted
    into ranges first, each range's rows meet in one group, and the first row of
    each range is copied to the range before it."""
    picked = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    picked = picked.withColumn("_h", F.xxhash64("text"))
    n = common.shuffle_partitions(docs.sparkSession)
    down = [F.col("doc_id").desc_nulls_last(), F.col("_h")]
    keys = picked.select("doc_id", "_h").repartitionByRange(n, *down).withColumn("_part", F.spark_partition_id())
    first = F.min(F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), F.col("_h").alias("h")))
    firsts = sorted(((r["f"][0], r["f"][1] or 0, r["f"]["h"]) for r in keys.groupBy("_part").agg(first.alias("f")).collect()))
    if not firsts:
        empty = picked.select("doc_id", "text", F.col("text").alias("next_text"))
        return empty.withColumns({"b": F.lit(0), "copy": F.lit(0), "_h": F.lit(0)}) if copies else empty
    # one boundary per partition of the shuffle; looked up through two short arrays
    step = max(1, math.isqrt(len(firsts)))
    groups = [firsts[i:i + step] for i in range(0, len(firsts), step)]

    def lit(key) -> Column:
        return F.struct(F.lit(key[0]), F.lit(key[1]).cast("long"), F.lit(key[2]).cast("long"))

    me = F.struct(F.col("doc_id").isNull(), F.coalesce(-F.col("doc_id"), F.lit(0).cast("long")), F.col("_h"))
    outer = F.greatest(F.size(F.filter(F.array(*(lit(g[0]) for g in groups)), lambda b: b <= F.col("_me"))), F.lit(1))
    inner = F.element_at(F.array(*(F.array(*map(lit, g)) for g in groups)), F.col("_outer"))
    ranged = picked.withColumn("_me", me).withColumn("_outer", outer)
    ranged = ranged.withColumn("_group", inner).withColumn(
        "_block", (F.col("_outer") - 1) * step + F.greatest(F.size(F.filter("_group", lambda b: b <= F.col("_me"))), F.lit(1)) - 1)
    is_first = F.element_at("_group", F.col("_block") - (F.col("_outer") - 1) * step + 1) == F.col("_me")
    before = F.pmod(F.col("_block") - 1, F.lit(len(firsts)))
    places = F.when(is_first, F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("copy")), F.struct(before.alias("b"), F.lit(1).alias("copy")))).otherwise(
        F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("copy"))))
    spread = ranged.withColumn("_place", F.explode(places)).select("doc_id", "text", "_h", "_place.b", "_place.copy")
    rows = spread.withColumn("next_text", F.lead("text").over(_in_block()))
    return rows if copies else rows.where("copy = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The parts of every text's fingerprint: doc_id, parts."""
    kept = _constant(lexicon(docs, low, high))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return with_parts(docs.select(F.col("doc_id").cast("long"), text.alias("parts")), ["parts"], kept)


def edited_fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text, its edited text, and how near they are.

    The edited text has its last floor(n_chars / 2) characters replaced by as
    many from the beginning of the next document (descending doc_id, cyclic; or
    all of it if shorter).  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (parts joined by ':'), near_edited, near_next.  NULL texts
    count as empty and share one fingerprint; repeated rows are documents of
    their own; a lone document is its own next one; an empty table gives no rows;
    other columns are not read."""
    kept = _constant(lexicon(docs, low, high))
    rows = with_next(docs, copies=True).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", F.when(F.col("copy") == 0, edited).otherwise(F.lit("")))
    rows = rows.select("b", "copy", "doc_id", "_h", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "text", "edited")
    rows = with_parts(rows, ["text", "edited"], kept)
    rows = rows.withColumn("next_parts", F.lead("text").over(_in_block())).where("copy = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", F.array_join("text", ":").alias("fingerprint"),
                       F.array_join("edited", ":").alias("edited_fingerprint"),
                       likeness(F.col("text"), F.col("edited")).alias("near_edited"),
                       likeness(F.col("text"), F.col("next_parts")).alias("near_next"))
