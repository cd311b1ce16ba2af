"""Words that a linear hash cannot tell apart, in every operator that finds words by their hash."""

import numpy as np
import pytest

from helpers_llm import docs  # noqa: F401

from dailycast.llm import jaccard, packing, records, scoring, tokens, words
from test_records_packing import crc, library

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(SWAP)
    return t


PAIRS = [(thue_morse(n), thue_morse(n).translate(SWAP)) for n in (8, 16, 64, 512, 1024, 2048)]


def test_hashes_differ_and_bytes_are_compared(monkeypatch):
    texts = [w.encode() for p in PAIRS for w in p] + [b"x" * n for n in range(1, 600)] + [b"y" * 7 + b"\x00" * n for n in range(9)]
    data, _ = words.joined(texts)
    starts, ends = words.spans(data)
    assert len(np.unique(words.hash_spans(data, starts, ends))) == len(texts)
    same = words.same_spans(data, starts, ends, data, starts[::-1], ends[::-1])
    assert same.tolist() == [a == b for a, b in zip(texts, texts[::-1])]
    plain = words.hash_spans
    monkeypatch.setattr(words, "hash_spans", lambda *a: plain(*a) % np.uint64(7))  # most words share their hash
    enc = tokens.Encoder(tokens.vocabulary())
    rows = ["the cat, the dog", "a b c", "dog cat", "", "the cat"]
    assert [[*map(int, x), tokens.END] for x in enc.encode([r.encode() for r in rows])] == library(rows)


@pytest.mark.parametrize("pair", PAIRS[-2:])
def test_operators_keep_such_words_apart(docs, pair):
    a, b = (" ".join([w] * 8) for w in pair)
    rows = {r.doc_id: r for r in jaccard.jaccard_components(docs([(1, a), (2, b)])).collect()}
    assert [rows[i].component_id for i in (1, 2)] == [1, 2]
    hits = {r.doc_id: r.hits for r in scoring.backoff_scores(docs([(1, a), (2, b)]), 1).collect()}
    assert hits == {1: [8, 0], 2: [8, 0]}
    want = [crc(x) for x in library([a, b])]
    assert [r.ids_crc32 for r in sorted(records.record_table(docs([(1, a), (2, b)])).collect())] == want
    by = {}
    for r in sorted(packing.pack_documents(docs([(1, a), (2, b)])).collect()):
        by.setdefault(r.doc_id, []).append(r.length)
    assert {k: sum(v) for k, v in by.items()} == dict(zip((1, 2), map(len, library([a, b]))))
