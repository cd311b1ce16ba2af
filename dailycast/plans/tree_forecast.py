"""Recursive forecast scored by a trained Spark ML tree ensemble.

JVM models cannot be called from Python workers, and a per-day loop of
Spark jobs would cost one job per forecast day.  Instead the fitted GBT is
read back from its saved node table into flat numpy arrays (size bounded by
``numTrees * 2^(maxDepth+1)`` and checked before it is broadcast), and one
``mapInPandas`` advances all outlets of an Arrow batch day by day together:
each day is one vectorized pass over (rows x trees).

The state (one row per outlet, from :func:`forecast_state`) is computed by
Catalyst, encoded by the pipeline's own indexer stage, and carries the day
spine and its calendar features as arrays, so Python only does the tree
arithmetic and the lag/average roll.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.functions.columns import calendar_struct, day_spine
from dailycast.operators.forecast import PREDICTED, ForecastSpec, forecast_state, spread
from dailycast.operators.split import OUTLET_CODE
from dailycast.operators.encoding import VALUE
from dailycast.plans.profiles import BoostedModel
from dailycast.plans.train import NULL_SENTINEL
from dailycast.schema import CALENDAR_COLUMNS, DATE, HISTORY_KEEP, OUTLET
from dailycast.session import scratch_path, ship_package

MAX_NODES = 2_000_000        # broadcast bound: ~45 bytes a node, one copy per Python worker
ROW_CHUNK_CELLS = 4_000_000  # rows x trees traversed at once inside a batch


class TreeEnsemble:
    """Flat arrays of a regression tree ensemble (Spark GBT layout)."""

    def __init__(self, feature, threshold, left, right, value, roots, weights, cat_keys, n_cat, depth):
        self.feature = feature        # int32, -1 at leaves
        self.threshold = threshold    # float64
        self.left = left              # int64 global node ids
        self.right = right
        self.value = value            # float64 leaf / node prediction
        self.roots = roots            # int64, one per tree
        self.weights = weights        # float64, one per tree
        self.cat_keys = cat_keys      # sorted int64: node * n_cat + category going left
        self.n_cat = n_cat            # int64 per node (0 = continuous split)
        self.depth = depth

    @property
    def n_trees(self) -> int:
        return len(self.roots)

    @classmethod
    def from_gbt(cls, spark: SparkSession, gbt: GBTRegressionModel, path: str | None = None,
                 n_trees: int | None = None) -> TreeEnsemble:
        """Read the node table of a GBT model (saved under ``path`` in the
        shared folder if not saved yet).  Raises if the ensemble exceeds
        :data:`MAX_NODES` (it would not fit a broadcast)."""
        if path is None:
            path = scratch_path(spark, "gbt")
            gbt.write().overwrite().save(path)
        weights = np.asarray(gbt.treeWeights, dtype=np.float64)
        n_trees = len(weights) if n_trees is None else min(n_trees, len(weights))
        nodes = spark.read.parquet(f"{path}/data").where(F.col("treeID") < n_trees)
        total = nodes.count()
        if total > MAX_NODES:
            raise ValueError(f"tree ensemble has {total} nodes (> {MAX_NODES}); too large to broadcast")
        pdf = nodes.select(
            "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("value"),
            F.col("nodeData.leftChild").alias("l"), F.col("nodeData.rightChild").alias("r"),
            F.col("nodeData.split.featureIndex").alias("f"),
            F.col("nodeData.split.leftCategoriesOrThreshold").alias("lc"),
            F.col("nodeData.split.numCategories").alias("nc"),
        ).toPandas().sort_values(["treeID", "id"], kind="stable").reset_index(drop=True)
        sizes = pdf.groupby("treeID")["id"].max().reindex(range(n_trees)).to_numpy() + 1
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        off = offsets[pdf["treeID"].to_numpy()]
        glob = off + pdf["id"].to_numpy()
        n = int(sizes.sum())
        feature = np.full(n, -1, np.int32)
        threshold = np.zeros(n)
        left = np.arange(n, dtype=np.int64)
        right = np.arange(n, dtype=np.int64)
        value = np.zeros(n)
        n_cat = np.zeros(n, np.int64)
        leaf = pdf["l"].to_numpy() < 0
        inner = ~leaf
        value[glob] = pdf["value"].to_numpy()
        feature[glob[inner]] = pdf["f"].to_numpy()[inner]
        left[glob[inner]] = off[inner] + pdf["l"].to_numpy()[inner]
        right[glob[inner]] = off[inner] + pdf["r"].to_numpy()[inner]
        nc = pdf["nc"].to_numpy()
        lcs = pdf["lc"].to_numpy()
        cont = inner & (nc < 0)
        threshold[glob[cont]] = np.array([v[0] for v in lcs[cont]], dtype=np.float64)
        cat = inner & (nc >= 0)
        keys = []
        if cat.any():
            kmax = int(nc[cat].max())
            n_cat[glob[cat]] = kmax
            for g, cats in zip(glob[cat], lcs[cat]):
                keys.extend(int(g) * kmax + int(c) for c in cats)
        cat_keys = np.array(sorted(keys), dtype=np.int64)
        return cls(feature, threshold, left, right, value, offsets.copy(), weights[:n_trees], cat_keys,
                   n_cat, int(gbt.getMaxDepth()))

    def predict(self, X: np.ndarray) -> np.ndarray:
        """Sum of weighted tree outputs for the rows of ``X`` (features in
        the assembler's order)."""
        m = X.shape[0]
        out = np.empty(m)
        step = max(1, ROW_CHUNK_CELLS // max(1, self.n_trees))
        for a in range(0, m, step):
            out[a:a + step] = self._predict_chunk(X[a:a + step])
        return out

    def _predict_chunk(self, X: np.ndarray) -> np.ndarray:
        m = X.shape[0]
        idx = np.broadcast_to(self.roots, (m, self.n_trees)).copy()
        rows = np.arange(m)[:, None]
        has_cat = len(self.cat_keys) > 0
        for _ in range(self.depth + 1):
            f = self.feature[idx]
            inner = f >= 0
            if not inner.any():
                break
            x = X[rows, np.where(inner, f, 0)]
            go_left = x <= self.threshold[idx]
            if has_cat:
                kc = self.n_cat[idx]
                is_cat = inner & (kc > 0)
                if is_cat.any():
                    key = idx[is_cat] * kc[is_cat] + x[is_cat].astype(np.int64)
                    pos = np.searchsorted(self.cat_keys, key)
                    pos = np.minimum(pos, len(self.cat_keys) - 1)
                    go_left[is_cat] = self.cat_keys[pos] == key
            nxt = np.where(go_left, self.left[idx], self.right[idx])
            idx = np.where(inner, nxt, idx)
        return self.value[idx] @ self.weights


def forecast_state_for_model(features: DataFrame, model: PipelineModel | BoostedModel, spec: ForecastSpec,
                             sentinel: float = NULL_SENTINEL) -> DataFrame:
    """State rows encoded by the model's own indexer, NULL features filled
    with the training sentinel, plus the day spine and calendar arrays."""
    state = forecast_state(features, spec)
    if isinstance(model, BoostedModel):
        state = model.encode(state).withColumnRenamed(VALUE, OUTLET_CODE)
        sentinel = float("nan")  # its trees know missing values
    else:
        state = model.stages[0].transform(state)
    state = spread(state)  # after the outlets' join, which may deal rows out by size
    days = day_spine(F.col("pred_start"), F.col("pred_end"))
    def field(c):
        return lambda d: calendar_struct(d, spec.weekend_days)[c]
    cal = {f"cal_{c}": F.transform(days, field(c)) for c in CALENDAR_COLUMNS}
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(sentinel))
            for c in ("lag_1", "lag_7", "lag_14", "ma_7", "ma_14")}
    return state.withColumns(fill).select(
        OUTLET, F.col(OUTLET_CODE).cast("double").alias("code"), *fill.keys(),
        F.transform("hist", lambda v: F.coalesce(v, F.lit(sentinel))).alias("hist"),
        days.alias("days"), *[v.alias(k) for k, v in cal.items()])


def _roll(ens: TreeEnsemble, pdf: pd.DataFrame) -> pd.DataFrame:
    n = len(pdf)
    if n == 0:
        return pd.DataFrame({OUTLET: [], DATE: [], PREDICTED: []})
    horizon = pdf["days"].map(len).to_numpy()
    hmax = int(horizon.max())

    def pad(col, dtype):
        mat = np.zeros((n, hmax), dtype=dtype)
        for i, v in enumerate(pdf[col]):
            mat[i, :len(v)] = v
        return mat
    cal = {c: pad(f"cal_{c}", np.float64) for c in CALENDAR_COLUMNS}
    days = np.zeros((n, hmax), dtype="datetime64[us]")
    for i, v in enumerate(pdf["days"]):
        days[i, :len(v)] = np.asarray(v, dtype="datetime64[us]")
    code = pdf["code"].to_numpy(np.float64)
    l1, l7, l14 = (pdf[c].to_numpy(np.float64).copy() for c in ("lag_1", "lag_7", "lag_14"))
    ma7, ma14 = pdf["ma_7"].to_numpy(np.float64).copy(), pdf["ma_14"].to_numpy(np.float64).copy()
    buf = np.zeros((n, HISTORY_KEEP))           # right-aligned history
    hlen = np.zeros(n, np.int64)
    for i, v in enumerate(pdf["hist"]):
        v = np.asarray(v, np.float64)[-HISTORY_KEEP:]
        buf[i, HISTORY_KEEP - len(v):] = v
        hlen[i] = len(v)
    cols = np.arange(HISTORY_KEEP)
    out_o, out_d, out_y = [], [], []
    outlets = pdf[OUTLET].to_numpy()
    for k in range(hmax):
        act = horizon > k
        a = np.flatnonzero(act)
        X = np.column_stack([code[a]] + [cal[c][a, k] for c in CALENDAR_COLUMNS]
                            + [l1[a], l7[a], l14[a], ma7[a], ma14[a]])
        y = ens.predict(X)
        out_o.append(outlets[a])
        out_d.append(days[a, k])
        out_y.append(y)
        l14[a], l7[a], l1[a] = l7[a], l1[a], y
        b = buf[a]
        b[:, :-1] = b[:, 1:]
        b[:, -1] = y
        buf[a] = b
        hl = np.minimum(hlen[a] + 1, HISTORY_KEEP)
        hlen[a] = hl
        ma7[a] = b[:, -7:].sum(axis=1) / np.minimum(hl, 7)
        mask = cols[None, :] >= (HISTORY_KEEP - hl)[:, None]
        ma14[a] = np.where(mask, b, 0.0).sum(axis=1) / hl
    return pd.DataFrame({OUTLET: np.concatenate(out_o), DATE: np.concatenate(out_d),
                         PREDICTED: np.concatenate(out_y)})


def forecast_with_trees(features: DataFrame, model: PipelineModel | BoostedModel, spec: ForecastSpec,
                        ensemble: TreeEnsemble | None = None, sentinel: float = NULL_SENTINEL) -> DataFrame:
    """M12 scored by the pipeline's GBT or a boosted profile: ``Outlet, Date, Predicted Sales``."""
    spark = features.sparkSession
    ship_package(spark)
    ens = model.boosted.trees if isinstance(model, BoostedModel) else ensemble or TreeEnsemble.from_gbt(spark, model.stages[-1])
    bc = spark.sparkContext.broadcast(ens)
    state = forecast_state_for_model(features, model, spec, sentinel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = bc.value
        for pdf in batches:
            yield _roll(e, pdf)

    schema = f"{OUTLET} string, {DATE} timestamp_ntz, `{PREDICTED}` double"
    return state.mapInPandas(run, schema)
