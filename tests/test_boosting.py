"""Histogram booster against a plain booster that scans all rows of a node for every cut."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dailycast.plans import boosting as bo

FEATURES = ["a", "b", "c", "d"]


def rows_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c, d = rng.randrange(12), rng.random(), rng.choice([None, 1.0, 2.0, 5.0]), rng.choice([None, rng.random()])
        y = 100 * (a > 5) + 30 * b + (20 if c is None else c) + (0 if d is None else 10 * d) + rng.random()
        out.append((float(a), b, c, d, y, i % 5 == 0, i * 7919))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "a double, b double, c double, d double, target double, held_out boolean, key long").repartition(parts)


def soft(g, alpha):
    return math.copysign(max(abs(g) - alpha, 0), g)


def plain_boost(rows, cuts, p):
    """Trees as nested tuples, predictions and held-out errors, by scanning."""
    train = [r for r in rows if not r[5]]
    base = sum(r[4] for r in train) / len(train)
    pred = [base] * len(rows)
    errors, trees = [], []

    def leaf(own, res):
        g, h = sum(res[i] for i in own), len(own)
        return -p.learning_rate * soft(g, p.reg_alpha) / (h + p.reg_lambda) if h else 0.0

    def gain_of(own, res, f, cut, left_null):
        left = [i for i in own if (rows[i][f] is None and left_null) or (rows[i][f] is not None and rows[i][f] <= cut)]
        right = [i for i in own if i not in set(left)]
        s = lambda ix: soft(sum(res[i] for i in ix), p.reg_alpha) ** 2 / (len(ix) + p.reg_lambda)
        return 0.5 * (s(left) + s(right) - s(own)), left, right

    def choose(nodes, res, columns):
        best = None
        for f in columns:
            for cut in cuts[f]:
                for left_null in (False, True):
                    found = [gain_of(own, res, f, cut, left_null) for own in nodes]
                    if p.symmetric:
                        if all(not l or not r for _, l, r in found):
                            continue
                        total = sum(g for g, l, r in found if l and r)
                    else:
                        if any(len(x) < max(p.min_child_weight, 1e-300) for _, l, r in found for x in (l, r)):
                            continue
                        total = found[0][0]
                    if best is None or total > best[0] + 1e-9:
                        best = (total, f, cut, left_null, [(l, r) for _, l, r in found])
        return best if best and best[0] > bo.LEAST_GAIN else None

    for k in range(p.rounds):
        key = np.array([r[6] for r in rows], np.int64)
        take = bo.sampled(key, p.subsample, p.seed, k)
        res = [q - r[4] for q, r in zip(pred, rows)]
        own = [i for i in range(len(rows)) if take[i] and not rows[i][5]]
        columns = bo.columns_of(p, len(FEATURES), k).tolist()
        level, paths = [(own, ())], []
        for _ in range(p.depth):
            following = []
            if p.symmetric:
                best = choose([o for o, _ in level], res, columns)
                if best is None:
                    break
                for (o, path), (l, r) in zip(level, best[4]):
                    following += [(l, path + ((best[1:4], True),)), (r, path + ((best[1:4], False),))]
            else:
                for o, path in level:
                    best = choose([o], res, columns)
                    if best is None:
                        paths.append((path, leaf(o, res)))
                    else:
                        l, r = best[4][0]
                        following += [(l, path + ((best[1:4], True),)), (r, path + ((best[1:4], False),))]
            level = following
            if not level:
                break
        paths += [(path, leaf(o, res)) for o, path in level]
        trees.append(paths)

        def goes(r, test):
            f, cut, left_null = test
            return left_null if r[f] is None else r[f] <= cut

        for i, r in enumerate(rows):
            pred[i] += next(v for path, v in paths if all(goes(r, t) == side for t, side in path))
        out = [i for i, r in enumerate(rows) if r[5]]
        errors.append(math.sqrt(sum((pred[i] - rows[i][4]) ** 2 for i in out) / len(out)))
    return pred, errors, trees


PROFILES = {
    "plain": bo.BoostParams(rounds=6, learning_rate=0.3, depth=3, reg_lambda=0.5, bins=16),
    "sampled, L1 and L2": bo.BoostParams(rounds=8, learning_rate=0.2, depth=4, subsample=0.8, colsample=0.8, reg_alpha=0.5, reg_lambda=0.5, bins=16),
    "least weight": bo.BoostParams(rounds=4, learning_rate=0.3, depth=3, min_child_weight=6, bins=8),
    "symmetric": bo.BoostParams(rounds=5, learning_rate=0.3, depth=3, reg_lambda=3.0, bins=8, symmetric=True),
}


@pytest.mark.parametrize("name", PROFILES)
def test_equals_a_plain_booster(spark, name):
    p, rows = PROFILES[name], rows_of(70)
    df = frame(spark, rows)
    cuts = bo.cut_points(df.where("not held_out"), FEATURES, p.bins)
    pred, errors, trees = plain_boost(rows, cuts, p)
    model = bo.fit(df, FEATURES, p, task_rows=20, local_rows=15)  # levels first, then the rest below small nodes
    got = {r.key: r.prediction for r in bo.with_prediction(df, model.trees, FEATURES).collect()}
    assert [got[r[6]] for r in rows] == pytest.approx(pred, abs=1e-8)
    assert model.held_out_rmse == pytest.approx(errors, abs=1e-8)
    assert [int((model.trees.feature[a:b] < 0).sum()) for a, b in zip(model.trees.roots, [*model.trees.roots[1:], len(model.trees.feature)])] == \
        [len(t) for t in trees]


def test_the_model_does_not_depend_on_the_partitioning(spark):
    rows, p = rows_of(300, 4), bo.BoostParams(rounds=5, depth=4, subsample=0.7, colsample=0.7, bins=16)
    a = bo.fit(frame(spark, rows, 1), FEATURES, p).trees
    # more tasks than partial sums on the driver; levels only, small nodes in tasks, all in tasks
    for task_rows, local_rows in ((13, 0), (40, 30), (80, 1000)):
        b = bo.fit(frame(spark, rows, 7), FEATURES, p, task_rows, local_rows).trees
        for x in ("feature", "value", "cut", "missing_left", "left", "cover"):
            assert getattr(a, x).tolist() == getattr(b, x).tolist()


def test_early_stopping_keeps_the_best_round_of_one_fit(spark):
    rng = random.Random(3)
    rows = [(*r[:4], rng.gauss(0, 50) + r[4] * 0.05, *r[5:]) for r in rows_of(120, 9)]
    p = bo.BoostParams(rounds=40, learning_rate=0.5, depth=4, bins=16)
    full = bo.fit(frame(spark, rows), FEATURES, p).held_out_rmse
    stopped = bo.fit(frame(spark, rows), FEATURES, bo.BoostParams(**{**p.__dict__, "patience": 4}))
    best = 0
    for i, e in enumerate(full):  # the whole curve, then the rule
        if e < full[best]:
            best = i
        elif i - best >= 4:
            break
    assert stopped.best_round == best and stopped.trees.n_trees == best + 1 < 40
    assert stopped.held_out_rmse == full[:len(stopped.held_out_rmse)]


def test_odd_inputs(spark):
    p = bo.BoostParams(rounds=3, depth=3, bins=8)
    rows = rows_of(30)
    with pytest.raises(ValueError):
        bo.fit(frame(spark, rows).where("false"), FEATURES, p)
    one = bo.fit(frame(spark, rows[1:2]), FEATURES, p)
    assert one.trees.base == pytest.approx(rows[1][4], abs=1e-7) and one.held_out_rmse == [] and set(one.trees.feature) == {-1}
    same = frame(spark, [(None, None, None, None, 5.0, False, i) for i in range(9)])
    assert bo.fit(same, FEATURES, p).trees.predict(np.full((2, 4), np.nan)).tolist() == [5.0, 5.0]
    no_target = frame(spark, [*rows, (1.0, 1.0, 1.0, 1.0, None, False, 1)])
    assert bo.fit(no_target, FEATURES, p).trees.base == bo.fit(frame(spark, rows), FEATURES, p).trees.base


def test_saved_and_loaded(spark, tmp_path):
    df = frame(spark, rows_of(60))
    model = bo.fit(df, FEATURES, bo.BoostParams(rounds=4, depth=3, bins=8))
    bo.save(spark, model, str(tmp_path / "m"), {"note": "x"})
    again, about = bo.load(spark, str(tmp_path / "m"))
    assert about["note"] == "x" and again.params == model.params and again.features == FEATURES
    X = np.array([[3.0, 0.5, np.nan, 0.1], [11.0, np.nan, 2.0, np.nan]])
    assert again.trees.predict(X).tolist() == model.trees.predict(X).tolist()
    assert sum(model.importances) == pytest.approx(1.0)
    assert bo.with_prediction(df.limit(0), model.trees, FEATURES).count() == 0
    assert df.where(F.col("c").isNull()).count() > 0
