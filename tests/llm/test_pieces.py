"""Backtracking encoder against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from helpers_llm import docs  # noqa: F401

from dailycast.llm import pieces, words

TEXTS = ["", None, " ", "  ", "a", " a", "a  b", "x ", "\x00x", "a\tb\nc\r\n", "é ﬁ \xa0x", "hello <s> </s> <unk> <0x0A>", "▁x ▁▁", "日本語😀 テキスト",
         "​﻿ a", "don't stop  now,    please", " " * 15 + "x", " " * 31, "aaaaaaaaaaaaaaaaaaaa", "word " * 3000, "x" * 20000, "ab" * 9000 + " " * 70]


@pytest.fixture(scope="module")
def table():
    return pieces.pieces(pieces.model_bytes())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())


def random_texts(n):
    rng = random.Random(5)
    vocab = pieces.pieces(pieces.model_bytes()).text[259:]
    signs = [*"abcdefghist  .,'\n\t0123", "é", "日", "😀", "ß", "▁", "  ", "   "]
    for _ in range(n):
        yield "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        yield "".join(rng.choice(vocab) for _ in range(rng.randrange(12))).replace("▁", rng.choice([" ", ""]))
        yield "".join(rng.choice("etainos") for _ in range(rng.randrange(40)))


def test_ids_equal_the_library(table, library):
    for t in [t or "" for t in TEXTS] + list(random_texts(3000)) + [" " * n + "xyz" * (n % 3) for n in range(80)]:
        assert table.encode(t) == library.encode(t), t
    assert [*table.encode("the end"), table.end] == library.encode("the end", add_eos=True)


def test_many_texts_at_once(table, library, monkeypatch):
    texts = [(t or "").encode() for t in TEXTS] + [t.encode() for t in random_texts(400)] + [b"bad \xff\xc3 bytes"]
    want = [library.encode(t.decode("utf-8", "replace"), add_eos=True) for t in texts]
    for _ in range(2):  # new units, then known ones
        assert [x.tolist() for x in table.encode_all(texts)] == want
    plain = words.hash_spans
    monkeypatch.setattr(words, "hash_spans", lambda *a: plain(*a) % np.uint64(97))  # most units share their hash
    table.forget()
    assert [x.tolist() for x in table.encode_all(texts)] == want
    table.forget()


def test_backtracking_equals_plain_merging(table):
    rng = random.Random(2)
    for _ in range(1500):
        run = "".join(rng.choice(["in", "er", "t", "h", "e", "s", "a", "▁"]) for _ in range(rng.randrange(1, 25)))
        assert table._run(run) == table.merge(run)


def test_decoding_equals_the_library(table, library):
    rng = random.Random(7)
    for t in [t or "" for t in TEXTS] + list(random_texts(300)):
        ids = [*table.encode(t), table.end]
        assert table.decode(ids) == library.decode(ids)
    for _ in range(800):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000), 28705]) for _ in range(rng.randrange(8))]
        assert table.decode(ids) == library.decode(ids), ids


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_of_odd_rows(docs, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "same"), (3, "same"), (None, "no id")]
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.piece_digests(docs(rows)).collect())
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((str(d), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want)
    assert pieces.piece_digests(docs([]).limit(0)).count() == 0


def test_round_trip_through_the_tables(docs):
    rows = {r.doc_id: r for r in pieces.decode(pieces.encode(docs(TEXTS))).collect()}
    assert {i: rows[i].text for i in rows} == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Pieces(b"")
