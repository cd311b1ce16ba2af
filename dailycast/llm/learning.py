"""What both classifiers share: which rows they may learn from, and bounded samples of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for rows kept out of learning: crc32 of the id's text modulo ``folds`` is ``fold`` (NULL id: False)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample_ids(ids: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` distinct doc_id, the first by a hash of the id: the same ones on each run."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    return ids.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(limit)
