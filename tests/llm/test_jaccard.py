import random
import re

import pytest

from helpers_llm import WORDS, docs  # noqa: F401

from dailycast.llm import graph, jaccard


def shingles(text, n=5):
    t = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(t) < n:
        return {tuple(t)}
    return {tuple(t[i:i + n]) for i in range(len(t) - n + 1)}


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, size=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    out = []
    for _ in range(size):
        kind = rng.random()
        if out and kind < 0.5:  # edit an earlier text, lightly or heavily
            t = list(rng.choice(out))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(t)
        elif kind < 0.6:
            out.append(passage + [rng.choice(vocab) for _ in range(rng.randrange(20))])
        else:
            out.append([rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 6, 30, 80, 200]))])
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(docs, seed):
    texts = corpus(seed)
    texts += ["", None, " \n", "same short", "Same  SHORT", texts[0], texts[0].upper()]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (7, texts[2]), (7, texts[2])]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_chain_of_near_copies(docs):
    """Links reach along a chain whose ends are not similar."""
    base = [f"a{i}" for i in range(100)]
    rows = []
    for k in range(12):
        t = list(base)
        t[:2 * k] = [f"b{i}" for i in range(2 * k)]
        rows.append((50 - k, " ".join(t)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert len({c for *_, c in got}) == 1


def test_large_group_without_an_original(docs):
    rng = random.Random(5)
    base = [f"a{i}" for i in range(60)]
    rows = []
    for k in range(150):
        t = list(base)
        t[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(t)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(docs):
    assert jaccard.jaccard_components(docs([]).limit(0)).count() == 0


def test_one_per_group_keeps_columns(docs):
    t = " ".join(f"w{i}" for i in range(30))
    kept = jaccard.one_per_group(docs([t, t, "other words here", None, t + " x"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert kept.columns == docs([]).columns


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 5), (3, 4), (4, 4), (20, 30)], "a long, b long")
    assert {r.node: r.component for r in graph.components(links).collect()} == {
        9: 5, 8: 5, 7: 5, 6: 5, 5: 5, 3: 3, 4: 3, 20: 20, 30: 20}


def test_one_per_group_of_repeated_rows_and_null_ids(docs):
    t, u, v = (" ".join(f"{c}{i}" for i in range(30)) for c in "tuv")
    kept = jaccard.one_per_group(docs([(4, t), (4, t), (4, t + " x"), (None, t), (None, u), (None, u), (9, u), (None, v), (None, v + " x"),
                                       (None, None), (5, ""), (5, "")]))
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept.collect()) == [(0, ""), (0, "v"), (4, "t"), (5, ""), (5, ""), (9, "u")]
