"""Quality classifier by positive-unlabelled learning (operator 6).

Trusted positives are documents that the labels mark as good; the unlabelled
sample is web text as it comes.  A small network over whole-text features
minimises the non-negative unbiased risk

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

with the logistic loss l, so that its sigmoid estimates the chance of a good
document.  Where the second term falls below zero the step goes back up its
gradient, which keeps the network from learning the unlabelled sample by heart.
Spark computes the features of a bounded sample for the fit, and of every
document for the scores; the fitted model is a few kilobytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dailycast.llm import common, learning, words

#: Classes of bytes whose shares of a text are features.
_CLASS = np.full(256, 6)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:'\"-()?", b"!", b"|", [10], [32, 9, 11, 12, 13])):
    _CLASS[list(_bytes)] = _k if _k < 6 else _k + 1
_CLASS[128:] = 9
CLASSES = 10
#: Bytes of text whose features are worked out at a time.
PART = 4 << 20


def features(texts: list[bytes]) -> np.ndarray:
    """One row of numbers per text; they look at the text alone.  A text without words gives zeros."""
    data, begins = words.joined(texts)
    starts, ends = words.spans(data)
    hashes = words.hash_spans(np.frombuffer(data.tobytes().translate(words.UPPER), np.uint8), starts, ends)
    first = np.searchsorted(starts, begins)
    lengths = ends - starts
    last_sign = np.isin(_CLASS[data[ends - 1]] if len(ends) else np.empty(0, int), (4, 5, 6))
    grams, gram_first = words.grams(hashes, first, 3)
    out = np.zeros((len(texts), CLASSES + 11))
    for i, t in enumerate(texts):
        s, e = first[i], first[i + 1]
        n = e - s
        if not n:
            continue
        share = np.bincount(_CLASS[data[begins[i]:begins[i] + len(t)]], minlength=CLASSES) / len(t)
        _, times = np.unique(hashes[s:e], return_counts=True)
        g = grams[gram_first[i]:gram_first[i + 1]]
        lines = [x for x in t.split(b"\n") if x.strip()]
        per_line = n / max(1, len(lines))
        size = lengths[s:e]
        out[i] = [*np.sqrt(share), np.log(n), len(times) / n, np.log(len(times) + 1) / np.log(n + 1), times.max() / n,
                  len(np.unique(g)) / len(g) if len(g) else 1.0, len(set(lines)) / max(1, len(lines)), np.log(per_line),
                  size.mean() / 10, size.std() / 10, last_sign[s:e].mean(), (size == 1).mean()]
    return out


@dataclass
class Model:
    """A network with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        w, b, v, c = self.weights
        return np.tanh(z @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 12, steps: int = 600,
             rate: float = 0.02, decay: float = 1e-3, seed: int = 6) -> Model:
    """Minimise the non-negative unbiased risk by Adam over the whole sample."""
    both = np.concatenate([positive, unlabelled])
    model = Model(both.mean(0), both.std(0) + 1e-3, [])
    zp, zu = (np.clip((x - model.mean) / model.scale, -6, 6) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    d = both.shape[1]
    model.weights = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]

    def back(z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients of a mean loss whose slope at each row's output is given."""
        inner = np.outer(slope, model.weights[2]) * (1 - h * h)
        return [z.T @ inner, inner.sum(0), h.T @ slope, np.array([slope.sum()])]

    for step in range(1, steps + 1):
        w, b, v, c = model.weights
        hp, hu = np.tanh(zp @ w + b), np.tanh(zu @ w + b)
        fp, fu = hp @ v + c, hu @ v + c
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up = [x - y for x, y in zip(back(zu, hu, su / len(su)), back(zp, hp, prior * sp / len(sp)))]
        grads = [-g for g in up] if negative < 0 else [x + y for x, y in zip(up, back(zp, hp, -prior * (1 - sp) / len(sp)))]
        for k, g in enumerate(grads):
            g = g + decay * model.weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model.weights[k] = model.weights[k] - rate * (first[k] / (1 - 0.9 ** step)) / (
                np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _tail_shares(positive: np.ndarray, unlabelled: np.ndarray, seen: tuple[np.ndarray, np.ndarray], tails: np.ndarray) -> np.ndarray:
    """Shares of unlabelled rows above the values that leave the shares ``tails`` of the positives above them.

    The values are outputs of a logistic regression that tells the ``seen`` positives from the ``seen`` unlabelled rows."""
    both = np.concatenate(seen)
    mean, scale = both.mean(0), both.std(0) + 1e-9

    def wide(x: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / scale, -6, 6)
        return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)

    z, y = wide(both), np.arange(len(both)) < len(seen[0])
    weight = np.where(y, 0.5 / len(seen[0]), 0.5 / len(seen[1]))
    w = np.zeros(z.shape[1])
    for _ in range(25):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + 1e-3 * w
        w = w - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(w)), slope)
    at = np.quantile(wide(positive) @ w, 1 - tails)
    return 1 - np.searchsorted(np.sort(wide(unlabelled) @ w), at) / len(unlabelled)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from these two alone.

    Above any value of a score lies the same share of all positives, trusted or
    not; so the share of unlabelled rows above it, divided by the share of trusted
    positives above it, is at least the prior, and equals it where no negative lies
    above.  The least ratio is taken over tails of 75 to 98 % of the positives
    (smaller ones are noisy).  Each half of the rows is scored by a regression that
    has seen the other half only."""
    tails = np.linspace(0.75, 0.98, 24)
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    halves = [(positive[k::2], unlabelled[k::2]) for k in (0, 1)]
    shares = (_tail_shares(*halves[0], halves[1], tails) + _tail_shares(*halves[1], halves[0], tails)) / 2
    return float(np.min(shares / tails))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, prior: float | None = None) -> Model | None:
    """Fit on at most ``sample`` trusted positives and twice as many unlabelled documents, none held out.

    ``prior`` is the share of good documents in web text; by default it is
    estimated from the positives and the unlabelled documents (labels of bad
    ones are not used).  Without a positive or a document: None."""
    spark = docs.sparkSession
    common.python_ready(spark)
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(
        "doc_id is not null and quality = 1").where(~learning.held_out(F.col("doc_id")))
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    free = picked.where(~learning.held_out(F.col("doc_id")))
    good = learning.sample_ids(usable.join(free.select("doc_id"), "doc_id", "left_semi"), sample, 61)
    ids = good.withColumn("kind", F.lit(1)).union(learning.sample_ids(free, 2 * sample, 62).withColumn("kind", F.lit(0)))
    # the ids are bounded by the sample size; repeated ids give one row each
    texts = picked.where("text is not null").join(F.broadcast(ids), "doc_id")
    texts = texts.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(F.xxhash64("text")))).where("_r = 1")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(words.texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"),
                                              pa.array(rows.tolist(), pa.list_(pa.float64()))], ["doc_id", "kind", "x"])

    rows = texts.select("doc_id", "kind", "text").mapInArrow(measure, "doc_id long, kind int, x array<double>").collect()
    rows.sort(key=lambda r: (r["kind"], r["doc_id"]))
    sides = [np.asarray([r["x"] for r in rows if r["kind"] == k]) for k in (1, 0)]
    if not all(map(len, sides)):
        return None
    if prior is None:
        prior = estimate_prior(*sides)
    return fit_nnpu(*sides, prior=min(max(float(prior), 0.01), 0.99))


def _scores(model: Model | None, column: pa.Array) -> np.ndarray:
    """Scores of a column of texts, in pieces of bounded size."""
    texts = words.texts_of(column)
    scores, at = np.full(len(texts), 0.5), 0
    while model is not None and at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PART):
            size += len(texts[end])
            end += 1
        scores[at:end] = model.score(features(texts[at:end]))
        at = end
    words.give_back()
    return scores


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document (without a model: score 0.5)."""
    common.python_ready(docs.sparkSession)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                                              pa.array((scores >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col("doc_id").cast("long"), learning.held_out(F.col("doc_id")).alias("held_out"),
                         F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = 8000, threshold: float = 0.7) -> DataFrame:
    """Fit and score: one row per document (doc_id, held_out, score, predicted).

    Scores come from the text alone.  NULL and empty texts score like a text
    without words; a NULL doc_id is not held out and never learnt from; repeated
    rows each get their (equal) score; an empty table gives no rows; other
    columns are not read."""
    return score(docs, train(docs, labels, sample), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 8000, threshold: float = 0.7) -> DataFrame:
    """``docs``, with all of their columns, without the documents predicted bad.  Without a model all stay."""
    model = train(docs, labels, sample)
    if model is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column("text")) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
