"""Toivonen's mining against counting everything in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers_llm import docs  # noqa: F401

from dailycast.llm import phrases, words


def brute(rows, min_count, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    often = {g: c for g, c in f.items() if c >= min_count}
    out = {}
    for (lang, g), a in often.items():
        if len(g) == 1:
            continue
        inside = [c for (x, h), c in often.items() if x == lang and len(h) > len(g)
                  and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))]
        if any(100 * c >= 80 * a for c in inside):
            continue
        score, k, l, r = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, of in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(of)[:top]))


def table(spark, rows):
    data = [(i, lang, t, 1, 2, "x", 3) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, lang string, text string, w1 long, n long, word string, a int")


def corpus(n, seed, vocab="a b c d é F gg h. i, j".split()):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(vocab))]
    out = []
    for _ in range(n):
        text = rng.choice([" ", "  ", "\t"]).join(rng.choices(vocab, weights, k=rng.randrange(25)))
        out.append((rng.choice(["en", "en", "de", None]), text + rng.choice(["", ". ", "\n", " \x0bq r s t u v"])))
    return out


def got(frame):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize("min_count, sample, chunk", [(4, 1, 8 << 20), (4, 8, 300), (9, 3, 50), (3, 50, 8 << 20)])
def test_brute_force(spark, min_count, sample, chunk):
    rows = corpus(150, min_count) + [("en", None), ("en", ""), (None, " ,.; "), ("und", "a b c d a b c d")] * 3
    want = brute(rows, min_count)
    assert len(want) > 20
    assert got(phrases.collocations(table(spark, rows), min_count, sample=sample, chunk=chunk)) == want
    assert got(phrases.collocations(table(spark, rows), min_count, 5, sample, chunk)) == brute(rows, min_count, 5)


def test_full_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLOTS", 64)
    rows = corpus(200, 3, [f"w{i}" for i in range(300)])
    assert got(phrases.collocations(table(spark, rows), 2)) == brute(rows, 2)


def test_an_empty_sample_leaves_all_to_the_expansion_passes(spark, monkeypatch):
    rows = corpus(80, 5)
    passes = []
    plain = phrases.count_phrases
    monkeypatch.setattr(phrases, "count_phrases", lambda *a, **k: passes.append(a[3]) or plain(*a, **k))
    frame = table(spark, rows)
    assert got(phrases.collocations(frame, 4, sample=10 ** 9)) == brute(rows, 4)
    assert passes == [(2,), (2, 3, 4), (3, 4)]


def test_words_with_one_id_are_found_and_get_another_seed(spark, monkeypatch):
    plain = words.hash_spans
    monkeypatch.setattr(words, "hash_spans", lambda d, s, e, seed=0: plain(d, s, e, seed) % np.uint64(5) if seed == 0 else plain(d, s, e, seed))
    t = phrases.tokens(["en"], [b"a b c d e f g h i j k"], 0)
    assert len(set(t.ids.tolist())) <= 5
    assert len(set(phrases.tokens(["en"], [b"a b c d e f g h i j k"], 1).ids.tolist())) == 11


def test_long_texts_are_cut_where_a_piece_ends(spark):
    rows = [("en", "one two three, four five. " * 700), ("en", "x" * 5000 + " y z " * 900)]
    assert got(phrases.collocations(table(spark, rows), 5, chunk=1000)) == brute(rows, 5)


def test_empty_table(spark):
    frame = phrases.collocations(table(spark, []), 2)
    assert frame.count() == 0 and frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_one_batch_counts_each_collision_apart():
    """Words that share an id come out as rows of their own, so the word table shows them."""
    t = phrases.tokens(["en", "de"], [b"x y x", b"x"], 0)
    assert len(set(t.ids.tolist())) == 3 and t.piece.tolist() == [0, 0, 0, 1]
