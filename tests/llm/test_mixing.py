import re
from collections import defaultdict

import duckdb
import pytest

from helpers_llm import WORDS

from dailycast.llm import mixing, queries


def reshared(sizes, weights=(5, 2, 1), limit=3):
    """Targets by sharing the excess again until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= limit * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(limit * sizes[s])
            left -= limit * sizes[s]
        free -= over
    return target


def make(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], "doc_id long, text string, source string, size int, target string")


ROWS = ([(i, "w " * (i % 40), "a") for i in range(60)] + [(100 + i, "v " * 7, "b") for i in range(300)] + [(500 + i, "u\n" * 3, "Z") for i in range(9)]
        + [(600, None, "empty"), (601, "", "empty"), (602, "one two", None), (602, "one two", None), (None, "no id here", None), (603, "x " * 5000, "é")])


def test_targets_and_exact_budgets(spark):
    rows = mixing.mix(make(spark, ROWS)).collect()
    assert len(rows) == len(ROWS)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = reshared(dict(size))
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 0.5
    assert sorted(r.size for r in rows) == sorted(len(re.findall(WORDS, t or "")) for _, t, _ in ROWS)
    assert rows == rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix(make(spark, ROWS)).collect()))


def test_sql(spark):
    con = duckdb.connect()
    con.register("documents", make(spark, ROWS).toArrow())
    want = con.execute(queries.ORACLE_SQL["op9_mix_sources"]).fetchall()
    got = [tuple(r) for r in mixing.mix(make(spark, ROWS)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_mixed_documents(spark):
    rows = [r for r in ROWS if r[0] is not None][:-3]
    docs = make(spark, rows)
    plan = {r.doc_id: r for r in mixing.mix(docs).collect()}
    got = defaultdict(list)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id].append(len(re.findall(WORDS, r.text or "")))
    for d, p in plan.items():
        assert sum(got[d]) == p.taken
        if p.size == 0:
            assert got[d] == [0]


def test_empty_table(spark):
    assert mixing.mix(make(spark, [])).count() == 0
    assert mixing.mix(make(spark, [(1, None, "a"), (2, "", None)])).agg({"taken": "sum"}).first()[0] == 0


def test_mixed_documents_null_and_repeated_ids(spark):
    """Each row follows its own plan, whatever its id, and a cut text keeps its white space."""
    rows = [(None, f"n{i}\n " * (i % 9 + 1), "ab"[i % 2]) for i in range(60)] + [(7, f" r{i}\t\ts" * (i % 5), "abc"[i % 3]) for i in range(60)]
    docs = make(spark, rows)
    want = defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.taken
    texts = {(d, s): [] for d, _, s in rows}
    for d, t, s in rows:
        texts[d, s].append(t)
    out = [tuple(r) for r in mixing.mixed_documents(docs).collect()]
    cuts = 0
    taken, target = defaultdict(int), defaultdict(int)
    for d, t, s, _, _ in out:
        n = len(re.findall(WORDS, t))
        taken[s] += n
        assert any(x.startswith(t) and len(re.findall(WORDS, x)) >= n for x in texts[d, s])
        cuts += t not in texts[d, s]
    for (_, s, _), n in want.items():
        target[s] += n
    assert dict(taken) == dict(target) and cuts <= 3
    assert sum(t == "" for _, t, *_ in out) == sum(t == "" for _, t, _ in rows)
    assert sorted(map(str, out)) == sorted(map(str, (tuple(r) for r in mixing.mixed_documents(docs).collect())))
