"""Each stage against a brute-force version over what its predecessor kept."""

import re
from collections import Counter

import pytest
from helpers_llm import WORDS
from test_jaccard import brute
from test_mixing import reshared
from test_records_packing import check_packing, library

import corpus_pipeline as pipe
from dailycast.llm import common, language, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = common.table(spark, SF, "documents"), []
    out.append(docs)
    for _, stage in pipe.STAGES:
        docs = common.staged(stage(spark, docs, SF), "t")
        out.append(docs)
    return out


def test_order_and_columns(kept):
    assert [f.__name__ for _, f in pipe.STAGES] == ["good_quality", "known_language", "one_of_each_group", "mixed", "packed"]
    assert all(d.schema == kept[0].schema for d in kept[:5])


def test_rejected_documents_go(kept, spark):
    labels = common.table(spark, SF, "labels")
    bad = {r.doc_id for r in quality.classify_quality(kept[0], labels).collect() if not r.predicted}
    assert sorted(r.doc_id for r in kept[1].collect()) == sorted(r.doc_id for r in kept[0].collect() if r.doc_id not in bad)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    stay = {r.doc_id for r in kept[1].select("doc_id").collect()}
    assert sum(i in stay for i, q in truth.items() if q) >= 0.97 * sum(truth.values())
    found = {r.doc_id: r for r in language.identify_language(kept[1]).collect()}
    assert {r.doc_id for r in kept[2].collect()} == {i for i, r in found.items() if r.lang_pred != "und" and r.score >= 0.5}


def test_one_of_each_group(kept):
    rows = [(r.doc_id, r.text) for r in kept[2].collect()]
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted(d for d, _, c in brute(rows) if c == d)


def test_mix_meets_targets(kept):
    size = Counter()
    for r in kept[3].collect():
        size[r.source] += len(re.findall(WORDS, r.text))
    taken = Counter()
    for r in kept[4].collect():
        taken[r.source] += len(re.findall(WORDS, r.text))
    for s, t in reshared(dict(size)).items():
        assert abs(taken[s] - t) <= 0.5


def test_packing_holds_every_token(kept):
    rows = kept[5].collect()
    want = Counter()
    for r, ids in zip((mixed := kept[4].collect()), library([r.text for r in mixed])):
        want[r.doc_id] += len(ids)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    assert check_packing(rows, 4096) <= sum(want.values()) / 4096 * 1.03 + 1


def test_run_gives_the_last_stage(kept, spark):
    assert sorted(map(tuple, pipe.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(
        map(tuple, kept[5].select("doc_id", "piece", "length", "ids_crc32").collect()))
