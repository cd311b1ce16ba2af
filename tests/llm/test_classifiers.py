import random
import zlib

import numpy as np
import pytest

from dailycast.llm import language, quality


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def prose(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."


def corpus(seed=1):
    rng = random.Random(seed)
    syll = {"en": "th er on an re he in ed nd ha".split(), "xx": "ka lo mi zu pe ro ti wa no shi".split(), "ée": "é è ou eau ç ment".split()}
    vocab = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(1, 4))) for _ in range(400)] for k, v in syll.items()}
    rows = []
    for i in range(500):
        lang = rng.choice(list(vocab))
        t = prose(rng, vocab[lang], rng.randrange(15, 150))
        good = rng.random() < 0.8
        if not good:
            t = rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", " | "), " ".join([t.split()[0]] * 60), t.replace(" ", "$$$ ")])
        rows.append((i, t, lang, int(good)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    odd = [(900, None, None), (901, "", "en"), (902, " \n", "en"), (903, "1234 5678 ...", "en"), (None, rows[0][1], "en"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(i, t, lang, 3, "c") for i, t, lang, _ in rows] + [(*r, 3, "c") for r in odd],
                                 "doc_id long, text string, lang string, score int, held_out string")
    labels = spark.createDataFrame([(i, g, 0) for i, _, _, g in rows] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels, len(odd)


def test_quality_on_held_out_rows(tables):
    rows, docs, labels, odd = tables
    got = quality.classify_quality(docs, labels).collect()
    assert len(got) == len(rows) + odd
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (fold(r.doc_id) == 2) for r in got if r.doc_id is not None) and by[None].held_out is False
    held = [(by[i], g) for i, _, _, g in rows if fold(i) == 2]
    assert np.mean([r.predicted == g for r, g in held]) >= 0.9
    assert by[900].score == by[901].score == by[902].score


def test_quality_never_sees_held_out_labels(tables):
    rows, docs, labels, _ = tables
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id or -1, r.score) for r in quality.classify_quality(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_quality_without_labels_or_rows(tables, spark):
    _, docs, labels, _ = tables
    assert {r.score for r in quality.classify_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify_quality(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_nnpu_risk_finds_the_prior():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (3000, 2)), rng.normal(-2, 1, (3000, 2))
    unlabelled = np.concatenate([good[:1400], bad[:600]])
    model = quality.fit_nnpu(good[1400:], unlabelled, 0.7)
    assert model.score(unlabelled).mean() == pytest.approx(0.7, abs=0.06)
    assert (model.score(bad[600:]) < 0.5).mean() > 0.95


@pytest.mark.parametrize("share", [0.2, 0.5, 0.86])
def test_prior_from_positives_and_unlabelled_rows_alone(share):
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1.5, 1, (9000, 4)), rng.normal(-1.5, 1, (9000, 4))
    n = int(6000 * share)
    unlabelled = np.concatenate([good[:n], bad[:6000 - n]])
    assert quality.estimate_prior(good[6000:], unlabelled) == pytest.approx(share, abs=0.05)


def test_labels_of_bad_documents_are_not_used(tables):
    rows, docs, labels, _ = tables
    a, b = (sorted((r.doc_id or -1, r.score) for r in quality.classify_quality(docs, x).collect()) for x in (labels, labels.where("quality = 1")))
    assert a == b


def test_language_on_held_out_rows(tables):
    rows, docs, _, odd = tables
    got = language.identify_language(docs).collect()
    assert len(got) == len(rows) + odd
    by = {r.doc_id: r for r in got}
    held = [(by[i], lang) for i, _, lang, _ in rows if fold(i) == 2]
    assert np.mean([r.lang_pred == lang for r, lang in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert {(by[i].lang_pred, by[i].score) for i in (900, 901, 902, 903)} == {("und", 0.0)}


def test_language_without_anything_to_learn(tables):
    _, docs, _, _ = tables
    from pyspark.sql import functions as F
    assert {r.lang_pred for r in language.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify_language(docs.limit(0)).count() == 0


def test_ngram_places_by_hand():
    at, count = language.places("aAaa")
    assert count.sum() == 4 + 3 + 2 and len(at) == 3
    assert len(language.places("")[0]) == 0


def test_temperature_and_penalties():
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1, 1], 20000)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert language.fit_temperature(3 * np.log(p), y) == pytest.approx(3, rel=0.1)
    rows = [(np.array([k, 5 + int(rng.integers(200))]), np.array([1.0, 0.2]), k) for k in rng.integers(0, 3, 600)]
    dense, sparse = language.fit_ftrl(rows, 3, l1=0.0), language.fit_ftrl(rows, 3, l1=0.5)
    assert (sparse != 0).sum() < (dense != 0).sum()
    assert all(sparse[k].argmax() == k for k in range(3))
