import math
import random
import re
from collections import Counter

import pytest

from helpers_llm import WORDS, docs  # noqa: F401

from dailycast.llm import queries, scoring


def brute(texts, order, alpha=0.4):
    toks = [re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    per = [Counter(tuple(t[i:i + n]) for n in range(1, order + 1) for i in range(len(t) - n + 1)) for t in toks]
    total = sum(per, Counter())
    out = []
    for t, own in zip(toks, per):
        n_all = max(1, sum(map(len, toks)) - len(t))
        s = 0.0
        for i in range(len(t)):
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(t[i - k + 1:i + 1])
                c = total[g] - own[g]
                if c:
                    below = n_all if k == 1 else total[g[:-1]] - own[g[:-1]]
                    s += math.log(alpha ** (order - k) * c / below)
                    break
            else:
                s += math.log(alpha ** order / n_all)
        out.append((len(t), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("chunk", [40, 8 << 20])
def test_brute_force(spark, docs, order, chunk, monkeypatch):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("a b c D e f g h".split()) for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    texts += ["", None, " \t\n", "a", texts[0], texts[0], "unseen word here"]
    monkeypatch.setattr(scoring.exchange.with_corpus_counts, "__defaults__", (chunk, "doc_id", "text"))
    got = {r.doc_id: r for r in scoring.backoff_scores(docs(texts), order).collect()}
    assert len(got) == len(texts)
    for i, (n, s) in enumerate(brute(texts, order)):
        assert got[i].n_words == n
        assert got[i].log_score == pytest.approx(s, abs=1e-9)
        assert (got[i].mean_log_score is None) == (n == 0)
        assert sum(got[i].hits) == n


def test_empty_table_and_null_id(docs):
    assert scoring.backoff_scores(docs([]).limit(0)).count() == 0
    assert sorted(r.doc_id is None for r in scoring.backoff_scores(docs([(None, "a b"), (1, "a b")])).collect()) == [False, True]


def test_registered_query_scores_trigrams(docs, tmp_path):
    texts = ["the cat sat on the mat", "a cat sat on the hat", "the dog lay on the mat", "the cat sat by the dog", "on the", None]
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op5_backoff_scores(docs(texts).sparkSession, str(tmp_path)).collect()}
    want = brute(texts, 3)
    assert [got[i].log_score for i in range(len(texts))] == pytest.approx([s for _, s in want], abs=1e-9)
    assert want[0][1] != pytest.approx(brute(texts, 2)[0][1])
    assert len(got[0].hits) == 4 and got[0].hits[3] > 0
