import random
import shutil
import zlib
from collections import defaultdict

import numpy as np
import pytest

from helpers_llm import docs  # noqa: F401

from dailycast.llm import packing, records, tokens

TEXTS = ["Don't stop'S 's. a'b’c", "", None, "  \t", "İstanbul ﬁne naïve été. x̸=", "<|endoftext|> hi <|ENDOFTEXT|>", "日本語テキスト、です。",
         "a.b,c--d'e''s", "\x1cab\x85cd ef", "3.14 ①②③ 'll you'LL e.'s", "é.'s É, ×, ÷; ñ!?", "word " * 9000, "x" * 70000 + " y"]


def library(texts):
    tok = tokens.encoder(tokens.vocabulary()).tokenizer
    return [tok.encode(t or "", add_special_tokens=False).ids + [tokens.END] for t in texts]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_ids_equal_the_library():
    rng = random.Random(3)
    signs = list("abcXYZ01 .,'!-é\n\tßÉ|<") + ["the ", "can't", "日", "́"]
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(300)]
    enc = tokens.encoder(tokens.vocabulary())
    got = [[*map(int, x), tokens.END] for x in enc.encode([(t or "").encode() for t in texts])]
    assert got == library(texts)


def test_record_table_round_trip(spark, docs):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(7, "same"), (7, "same"), (None, "no id")]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in records.record_table(docs(rows)).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0]))
    want, at = [], 0
    for (d, _), ids in zip(rows, library([t for _, t in rows])):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_shuffled_read_returns_every_record(spark, docs, tmp_path):
    path = str(tmp_path / "r")
    records.write_records(docs(TEXTS), path, records_per_file=3)
    index = records.write_index(spark, path, path + "-index")
    orders = []
    for seed in (1, 2, 1):
        rows = records.read_shuffled(spark, path, index, seed).collect()
        orders.append([r.doc_id for r in rows])
        assert {r.doc_id: r.ids for r in rows} == dict(enumerate(library(TEXTS)))
    assert orders[0] == orders[2] != orders[1]


def test_damage_is_found():
    data = bytearray(records.frame(5, np.asarray([1, 2, 3], np.uint32), 2) + b"\n")
    doc, ids, end = records.unframe(memoryview(bytes(data)), 0)
    assert (doc, ids.tolist(), end) == (5, [1, 2, 3], len(data))
    for at in range(len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(bad)), 0)


def check_packing(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for of in places.values():
        of.sort()
        assert of[0][0] == 0 and sum(n for _, n in of) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(of, of[1:]))
    return len(places)


def test_pieces_and_places(docs):
    texts = TEXTS + ["one two three"] * 30
    rows = packing.pack_documents(docs(texts), 256).collect()
    ids = library(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(by) == len(texts)
    for d, of in by.items():
        of.sort(key=lambda r: r.piece)
        assert [r.piece for r in of] == list(range(len(of)))
        assert [(r.start, r.length) for r in of] == [(a, min(256, len(ids[d]) - a)) for a in range(0, len(ids[d]), 256)]
        assert [r.ids_crc32 for r in of] == [crc(ids[d][a:a + 256]) for a in range(0, len(ids[d]), 256)]
    n = check_packing(rows, 256)
    assert n <= sum(map(len, ids)) / 256 * 1.02 + 2


def test_plan_is_close_to_the_bound_and_pairs_large_items_at_most_twice():
    rng = random.Random(1)
    for _ in range(20):
        counts = defaultdict(int)
        for _ in range(3000):
            counts[min(100, 1 + int(rng.expovariate(1 / 25)))] += 1
        runs = packing.plan(counts, 100)
        bins = defaultdict(list)
        for length, of in runs.items():
            assert sum(times for _, times, _, _ in of) == counts[length]
            for _, times, first, offset in of:
                for k in range(times):
                    bins[first + k].append((offset, length))
        for of in bins.values():
            assert sum(n for _, n in of) <= 100 and sum(n > 100 / 3 for _, n in of) <= 2
        assert len(bins) <= -(-sum(k * n for k, n in counts.items()) // 100) * 1.03 + 1


def test_empty_table(docs):
    none = docs([]).limit(0)
    assert packing.pack_documents(none).count() == 0
    assert records.record_table(none).count() == 0


def test_split_number_beside_a_uuid_that_looks_like_one(spark, docs, tmp_path):
    path = str(tmp_path / "r")
    records.write_records(docs(TEXTS).coalesce(1), path, records_per_file=2)
    for f in list((tmp_path / "r").glob("part-*")):
        shutil.copy(f, f.with_name(f"part-{f.name[5:10]}-0a1b2c3d-c1ef-4a5b-8c7d-c2a1b2c3d4e5{f.name[f.name.rindex('-c'):]}"))
    index = records.build_index(spark, path).where("file like '%-0a1b2c3d-%'")
    assert {r.split for r in index.collect()} >= {0}
    assert all(r.split == int(r.file[-7:-4]) for r in index.collect())
    start, at = {r.doc_id: r.start for r in records.read_ordered(index).collect()}, 0
    for i, ids in enumerate(library(TEXTS)):
        assert start[i] == at
        at += len(ids)
