import numpy as np
import pytest

from dailycast.llm import neighbours


def brute(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = min(fine.get(i, v), v)
    out = {}
    for q, a in fine.items():
        if q % every == 0:
            near = [(-float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), i) for i, b in fine.items() if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted((round(s, 9), i) for s, i in near)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")


def corpus(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    v = (centres[rng.integers(8, size=n)] + 0.7 * rng.normal(size=(n, d))).astype(np.float32)
    return [(i, x.tolist()) for i, x in enumerate(v)]


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard_rows", [100, 5000])
def test_factor_one_is_exact(spark, shard_rows):
    rows = corpus(900, 12, 1) + [(2000 + i, [1.0] * 12) for i in range(400)] + [(3000 + i, [float(i + 1)] * 12) for i in range(20)]
    rows += [(5000, None), (5050, [0.0] * 12), (5100, [float("nan")] + [1.0] * 11), (5150, [None] + [1.0] * 11), (None, [1.0] * 12),
             (5200, [1.0, 2.0]), (5250, [1.0, 2.5]), (5300, [float("inf")] + [1.0] * 11), (50, rows[50][1])]
    found = got(neighbours.nearest(frame(spark, rows), 5, 50, 1.0, shard_rows, 7))
    want = {q: v for q, v in brute(rows, 5, 50).items() if v}
    assert found.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in near], q
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in near], abs=1e-9)


def test_recall_at_the_production_factor(spark):
    rows = corpus(4000, 64, 2)
    found, want = got(neighbours.nearest(frame(spark, rows), shard_rows=1000)), brute(rows, 5, 50)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_rows(spark):
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(0, [1.0])])).count() == 0
    assert got(neighbours.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]))) == {0: [(1, pytest.approx(0.5 ** 0.5))]}
