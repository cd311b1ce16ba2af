"""Stupid-backoff scores of every document against all other documents (operator 5).

The count tables of all orders are spread over hash ranges (see ``exchange``);
the documents' n-grams are joined to them by hash, and the logarithms are summed
per document.  A document's own n-grams are taken off the counts first, since
its own text would make each of its n-grams known."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm import common, exchange, words

PARTIAL = "doc_id long, n_words long, log_sum double, n_single long, hits array<long>"


def _orders(h: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tuple(x) for x in (words.grams(h, first, n) for n in range(1, order + 1))]


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """One row per document: doc_id, n_words, log_score, mean_log_score, hits (words scored at each order).

    Words are runs of anything but ASCII white space, with A-Z in lower case.
    The counts c are those of all other documents, N their number of words.  A
    word after its history scores c(n-gram) / c(history) at the highest order
    whose n-gram the others hold, times ``alpha`` for each order given up; a
    single word c / N; a word that no other document holds alpha ** order / N
    (with N at least 1).  log_score is the sum of natural logarithms.  Empty and
    NULL texts: 0 words, log_score 0.0, mean NULL.  Repeated rows are documents
    of their own, each the other's corpus.  An empty table gives no rows."""

    def keys_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([g for g, _ in _orders(h, first, order)]), return_counts=True)

    def resolve(chunk: exchange.Chunk, counts_of) -> pa.RecordBatch:
        orders = _orders(chunk.words, chunk.first, order)
        keys, which, own = np.unique(np.concatenate([g for g, _ in orders]), return_inverse=True, return_counts=True)
        total = counts_of(keys, own)
        sizes = np.diff(chunk.first)
        n = len(chunk.words)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(n) - np.repeat(chunk.first[:-1], sizes)
        others, at = [], 0
        for g, f in orders:  # counts without the document's own
            w = which[at:at + len(g)]
            at += len(g)
            pair = np.repeat(np.arange(len(sizes)), np.diff(f)) * np.int64(len(keys)) + w
            _, back, in_doc = np.unique(pair, return_inverse=True, return_counts=True)
            others.append(total[w] - in_doc[back])
        level = np.ones(n, np.int64)
        log = np.where(others[0] > 0, np.log(np.maximum(others[0], 1)), np.log(alpha))  # over N, put in later
        log += (order - 1) * np.log(alpha)
        level[others[0] == 0] = 0
        for k in range(2, order + 1):
            ends = np.flatnonzero(place >= k - 1)  # words with enough history
            held = others[k - 1] > 0
            history = others[k - 2][_history(place, k)]
            at_k = ends[held]
            log[at_k] = np.log(others[k - 1][held] / history[held]) + (order - k) * np.log(alpha)
            level[at_k] = k
        sums = np.bincount(doc, log, len(sizes)).astype(np.float64)
        single = np.bincount(doc, level <= 1, len(sizes)).astype(np.int64)
        hits = [np.bincount(doc, level == k, len(sizes)).astype(np.int64).tolist() for k in range(order + 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(chunk.ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums), pa.array(single, pa.int64()),
             pa.array([list(x) for x in zip(*hits)], pa.list_(pa.int64()))],
            ["doc_id", "n_words", "log_sum", "n_single", "hits"])

    found = common.staged(exchange.with_corpus_counts(docs, keys_of, resolve, PARTIAL), "backoff")
    words_in_all = found.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    rest = F.greatest(F.lit(words_in_all) - F.col("n_words"), F.lit(1)).cast("double")
    score = F.col("log_sum") - F.col("n_single") * F.log(rest)
    return found.select("doc_id", "n_words", score.alias("log_score"),
                        F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log_score"), "hits")


def _history(place: np.ndarray, k: int) -> np.ndarray:
    """For each k-gram, the number of the (k-1)-gram that ends just before its last word."""
    number = np.cumsum(place >= k - 2) - 1  # of the (k-1)-gram that ends at each word
    return number[np.flatnonzero(place >= k - 1) - 1]
