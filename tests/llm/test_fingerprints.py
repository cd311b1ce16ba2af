import hashlib

import pytest

from helpers_llm import docs  # noqa: F401

from dailycast.llm import fingerprints as fp


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def corpus():
    import random
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 7, 60, 200]))) for _ in range(60)]
    return texts + ["", None, " \n", "日本 é x", texts[5], texts[5], "zzz only here", "yyy only there", "odd"]


def test_edited_texts_and_likeness(docs):
    texts = corpus()
    ids = [3 * i - 40 for i in range(len(texts))]
    got = rows_of(fp.edited_fingerprints(docs(list(zip(ids, texts)))))
    assert len(got) == len(texts)
    order = sorted(zip(ids, texts), reverse=True)
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
        after_print = got[order[(k + 1) % len(order)][0]].fingerprint
        if after == t:
            assert r.fingerprint == after_print and r.near_next == 1
    assert len({got[ids[texts.index(t)]].fingerprint for t in texts[60:64]}) == 2  # the empty ones, and one with words


def test_subsets_by_hand(spark, docs):
    """Parts are hashes of the sorted in-band terms that a subset keeps."""
    texts = [f"common a{i % 5} b{i % 7} only{i}" for i in range(70)]
    table = docs(texts)
    kept = set(fp.lexicon(table, 0.1, 0.5))
    words = [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(7)]
    from pyspark.sql import functions as F
    frame = spark.createDataFrame([(w,) for w in words + ["common", "only3"]], "w string").select("w", F.xxhash64("w").alias("h"))
    term = {r.w: r.h for r in frame.collect()}
    assert kept == {term[w] for w in words}
    parts = {r.doc_id: r.parts for r in fp.fingerprints(table, 0.1, 0.5).collect()}
    assert all(len(p) == fp.PARTS for p in parts.values())
    assert parts[0] == parts[35] and parts[0] != parts[1]  # only the out-of-band terms differ
    own = sorted([term["a0"], term["b0"]])
    seeds = [(n, m) for n, m in enumerate((m for many, m in fp.SUBSETS for _ in range(many)))]
    for n, one_in in seeds:
        pick = spark.range(1).select(F.array(*map(F.lit, own)).cast("array<bigint>").alias("a")).select(
            F.filter("a", lambda t: F.xxhash64(t, F.lit(n)).bitwiseAND(F.lit(one_in - 1)) == 0).alias("a")).select(
            "a", F.xxhash64("a").alias("h")).first()
        assert parts[0][n] == (fp.NONE if not pick.a else format(pick.h & 0xFFFFFFFF, "08x"))


@pytest.mark.parametrize("n", [1, 2, 3, 25])
def test_next_document_is_cyclic(docs, n):
    got = rows_of(fp.with_next(docs([(i, f"t{i}") for i in range(n)])))
    assert {d: r.next_text for d, r in got.items()} == {i: f"t{(i - 1) % n}" for i in range(n)}


def test_null_id_comes_last_and_empty_table(docs):
    got = rows_of(fp.with_next(docs([(1, "a"), (None, "b"), (2, "c")])))
    assert (got[2].next_text, got[1].next_text, got[None].next_text) == ("a", "b", "c")
    assert fp.edited_fingerprints(docs([]).limit(0)).count() == 0
    assert len(fp.edited_fingerprints(docs([(1, "a"), (1, "a")])).collect()) == 2


def test_every_text_with_words_has_a_print_of_its_own(docs):
    """Also those of which no subset keeps a term."""
    texts = [f"u{i}" for i in range(120)] + ["", None, " \n"]
    prints = [tuple(r.parts) for r in sorted(fp.fingerprints(docs(texts)).collect(), key=lambda r: r.doc_id)]
    assert all(set(p) != {fp.NONE} for p in prints[:120]) and len(set(prints[:120])) == 120
    assert all(set(p) == {fp.NONE} for p in prints[120:])
    assert fp.LOW <= 0.005


def test_too_few_in_band_terms_give_way_to_all_terms(docs):
    texts = [f"m{i % 16} " + " ".join(f"{c}{i}" for c in "pqrstuvw") for i in range(160)]
    prints = [tuple(r.parts) for r in sorted(fp.fingerprints(docs(texts), 0.05, 0.5).collect(), key=lambda r: r.doc_id)]
    shared = [p for p in prints if prints.count(p) > 1]  # only by a common term that fills enough parts
    assert all(sum(x != fp.NONE for x in p) >= fp.FILLED for p in shared)
    assert len(set(prints)) > 16
