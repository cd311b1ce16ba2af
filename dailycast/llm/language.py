"""Language identification (operator 8).

Sparse multinomial logistic regression on TF-IDF weights of hashed character
n-grams.  Document counts of the n-grams cover every document that may be learnt
from; the weights are fitted by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of each language; a temperature, fitted on a part
of the sample kept aside, calibrates the probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dailycast.llm import common, learning

#: Hash places of n-grams, and lengths of n-grams in characters.
BITS, SIZES = 14, (1, 2, 3)
UNKNOWN = "und"


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash places of a whole text's character n-grams, in lower case, and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    count = np.zeros(1 << BITS, np.int64)
    for n in SIZES:
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= c[k:len(c) - n + 1 + k] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        count += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(count)
    return at, count[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(count)) * idf[at]
    return v / max(1e-12, float(np.sqrt(v @ v)))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # places and a bias, by language
    temperature: float = 1.0

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, count = places(text)
        p = softmax(self.logits(at, weigh(at, count, self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0,
             l1: float = 0.02, l2: float = 0.1, epochs: int = 3, seed: int = 8) -> np.ndarray:
    """Per-coordinate FTRL-proximal with L1 and L2 penalties; rows are (places, weights, class)."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    rng = np.random.default_rng(seed)

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v, y = rows[i]
            at, v = np.append(at, size - 1), np.append(v, 1.0)
            w = solved(z[at], n[at])
            error = softmax(v @ w)
            error[y] -= 1
            g = np.outer(v, error)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return solved(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every place, over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)  # the last place counts documents
        for batch in batches:
            for text in batch.column(0):
                at, _ = places(text.as_py() or "")
                total[at] += 1
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["place", "df"])

    rows = docs.select("text").mapInArrow(count, "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()
    df = np.zeros((1 << BITS) + 1)
    for r in rows:  # at most one row per place
        df[r["place"]] = r["df"]
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def train(docs: DataFrame, per_language: int = 500) -> Model:
    """Fit on at most ``per_language`` documents of each language, none held out; a fifth of them set the temperature."""
    common.python_ready(docs.sparkSession)
    usable = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).where(
        "doc_id is not null and lang is not null and text is not null").where(~learning.held_out(F.col("doc_id")))
    idf = inverse_frequencies(usable)
    ids = usable.select("doc_id", "lang", F.xxhash64(F.lit(81), "doc_id").alias("_h"))
    for group in (["lang", F.pmod("_h", F.lit(16))], ["lang"]):  # first in parts of a language, so that none meets in one task whole
        order = Window.partitionBy(*group).orderBy("_h", "doc_id")
        ids = ids.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language).drop("_r")
    # the ids are bounded by the number of languages times per_language; a repeated id gives each of its rows
    texts = usable.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [places(t) if has_letter(t) else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"),
                 pa.array([None if f is None else f[0].astype("<u2").tobytes() for f in found], pa.binary()),
                 pa.array([None if f is None else f[1].astype("<u4").tobytes() for f in found], pa.binary())],
                ["doc_id", "lang", "at", "count"])

    rows = texts.select("doc_id", "lang", "text").mapInArrow(sparse, "doc_id long, lang string, at binary, count binary")
    rows = sorted((r for r in rows.collect() if r["at"] is not None), key=lambda r: (r["doc_id"], r["lang"], bytes(r["at"])))
    languages = sorted({r["lang"] for r in rows})
    made = []
    for r in rows:
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        made.append((at, weigh(at, np.frombuffer(r["count"], "<u4"), idf), languages.index(r["lang"])))
    aside = [x for i, x in enumerate(made) if i % 5 == 4]
    model = Model(languages, idf, np.zeros(((1 << BITS) + 1, max(1, len(languages)))))
    if languages:
        model.weights = fit_ftrl([x for i, x in enumerate(made) if i % 5 != 4], len(languages))
    if aside:
        logits = np.stack([model.logits(at, v) for at, v, _ in aside])
        model.temperature = fit_temperature(logits, np.asarray([y for *_, y in aside]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document's whole text."""
    common.python_ready(docs.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"),
                                              pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col("doc_id").cast("long"), learning.held_out(F.col("doc_id")).alias("held_out"),
                         F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_language(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """Fit and predict: one row per document (doc_id, held_out, lang_pred, score).

    Texts that are NULL, empty or without a letter are ``und`` with score 0, as
    are all texts if there is nothing to learn from.  A NULL lang or doc_id is
    never learnt from; repeated rows get equal results; an empty table gives no
    rows; other columns are not read."""
    return predict(docs, train(docs, per_language))


def keep_identified(docs: DataFrame, least: float = 0.5, per_language: int = 500) -> DataFrame:
    """``docs``, with all of their columns, without texts that are ``und`` or whose best language stays below ``least``."""
    model = train(docs, per_language)
    if not model.languages:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (model.predict(t.as_py()) for t in batch.column("text"))
            yield batch.filter(pa.array([name != UNKNOWN and p >= least for name, p in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
