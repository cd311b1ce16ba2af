"""Histogram gradient boosting of squared error as Spark jobs (M5-M8).

* Features are cut at quantiles once; every row is kept as one byte per feature.
  NULL is a bin of its own, and every split learns the side it takes.
* Rows that the session's tasks can hold at once are boosted by ``lockstep``: tasks
  of one job go through many rounds and exchange sums.  More rows, or a session
  without such tasks, take a job per level, as follows; the trees are the same.
* A tree grows level by level.  Each level is one job: tasks sum gradients and
  counts of their rows by (node, feature, bin), and the sums of all tasks meet in
  a tree-shaped reduction.  The driver sees sums only (nodes x features x bins,
  whatever the number of rows) and picks each node's split by the second-order
  gain with L1 and L2 penalties.
* Nodes with at most ``LOCAL_ROWS`` rows leave that loop, as in the PLANET paper
  (Panda et al., 2009): one more job deals the rows of such nodes out by node, and
  tasks grow the rest below each of them.  A table that is one such node and lies
  in one partition runs several rounds a job.  Splits are found by the same code
  from the same sums, so the trees do not depend on the bound.
* Rows of the held-out side travel along.  The job that begins a round also
  returns their error under the trees so far, so early stopping needs no second
  fit and no pass of its own: the ensemble is cut at its best round.
* Gradients are rounded to multiples of a step chosen so that all sums are exact:
  a model does not depend on how its rows were dealt to tasks.
* The rows' predictions are carried from round to round as a persisted table and
  checkpointed every few rounds, so a lost executor repeats a few rounds' work."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.session import scratch_path, shared_dir, ship_package

#: Rows of a task (and of a stored block), rounds between checkpoints, partial sums that may come to the driver at once.
TASK_ROWS, BLOCK_ROWS, KEEP_ROUNDS, PARTIALS = 1 << 18, 1 << 16, 25, 16
#: Rows of a node below which one task grows the rest.
LOCAL_ROWS = 1 << 16
#: Rows from which a batch is scored tree by tree.
TREEWISE_ROWS = 640
#: Least gain of a split.
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 1000
    learning_rate: float = 0.05
    depth: int = 8
    subsample: float = 1.0
    colsample: float = 1.0
    min_child_weight: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    seed: int = 42
    bins: int = 64
    symmetric: bool = False     # one split for a whole level
    patience: int | None = None


@dataclass
class Trees:
    """Nodes of all trees: children of a leaf are the leaf itself; NaN goes left where ``missing_left``."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    @property
    def n_trees(self) -> int:
        return len(self.roots)

    def first(self, n: int) -> "Trees":
        end = int(self.roots[n]) if n < self.n_trees else len(self.feature)
        cut = {k: getattr(self, k)[:end] for k in ("feature", "cut", "missing_left", "left", "right", "value", "gain", "cover")}
        return Trees(**cut, roots=self.roots[:n], base=self.base, depth=self.depth)

    def predict(self, X: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
        out = np.full(len(X), self.base)
        if self.n_trees:
            step = max(1, cells // self.n_trees)
            for a in range(0, len(X), step):
                part = X[a:a + step]
                found = self._by_row(part) if len(part) < TREEWISE_ROWS else self._by_tree(part)
                out[a:a + step] += found.sum(axis=1)
        return out

    def _by_row(self, part: np.ndarray) -> np.ndarray:
        """Each row's leaf values, all trees at once."""
        at = np.broadcast_to(self.roots, (len(part), self.n_trees)).copy()
        rows = np.arange(len(part))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            x = part[rows, np.maximum(f, 0)]
            with np.errstate(invalid="ignore"):
                go = np.where(np.isnan(x), self.missing_left[at], x <= self.cut[at])
            at = np.where(go, self.left[at], self.right[at])
        return self.value[at]

    def _by_tree(self, part: np.ndarray) -> np.ndarray:
        """The same tree by tree: one tree's nodes stay in the processor's cache."""
        flat, place, gaps = np.ascontiguousarray(part).reshape(-1), np.arange(len(part)) * part.shape[1], bool(np.isnan(part).any())
        out = np.empty((len(part), self.n_trees))
        for i, (a, b) in enumerate(zip(self.roots, [*self.roots[1:], len(self.feature)])):
            feature, cut, missing_left = np.maximum(self.feature[a:b], 0).astype(np.intp), self.cut[a:b], self.missing_left[a:b]
            child = np.stack([self.right[a:b] - a, self.left[a:b] - a], axis=1).reshape(-1)
            at = np.zeros(len(part), np.intp)
            for _ in range(self.depth):
                x = flat.take(feature.take(at) + place)
                go = x <= cut.take(at)
                if gaps:
                    go = np.where(np.isnan(x), missing_left.take(at), go)
                at = child.take(2 * at + go)
            out[:, i] = self.value[a:b].take(at)
        return out


@dataclass
class Grown:
    """One tree in terms of bins while it grows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    sums: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.0)])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def split(self, node: int, feature: int, bin_: int, missing_left: bool, gain: float, sums: tuple) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node], self.gain[node] = feature, bin_, missing_left, gain
        self.left[node], self.right[node] = a, a + 1
        for child, own in ((a, sums[0]), (a + 1, sums[1])):
            self.feature.append(-1)
            self.bin.append(0)
            self.missing_left.append(False)
            self.left.append(child)
            self.right.append(child)
            self.gain.append(0.0)
            self.sums.append(own)
        return a, a + 1

    def graft(self, node: int, other: "Grown") -> None:
        """Put another tree's nodes below a leaf of this one."""
        places, todo = {0: node}, [0]
        for i in todo:
            if other.feature[i] >= 0:
                l, r = other.left[i], other.right[i]
                places[l], places[r] = self.split(places[i], other.feature[i], other.bin[i], other.missing_left[i], other.gain[i],
                                                  (other.sums[l], other.sums[r]))
                todo += [l, r]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int16), np.array(self.bin, np.int16), np.array(self.missing_left, bool),
                np.array(self.left, np.int32), np.array(self.right, np.int32))


def route(bins: np.ndarray, tree: tuple[np.ndarray, ...], missing: int, depth: int) -> np.ndarray:
    """The node that each binned row (one row of ``bins`` per feature) has reached."""
    feature, bin_, missing_left, left, right = tree
    at = np.zeros(bins.shape[1], np.int32)
    rows = np.arange(bins.shape[1])
    for _ in range(depth):
        own = bins[np.maximum(feature[at], 0), rows]
        go = np.where(own == missing, missing_left[at], own <= bin_[at])
        at = np.where(go, left[at], right[at])
    return at


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sampled(key: np.ndarray, share: float, seed: int, round_: int) -> np.ndarray:
    """Which rows a round takes: decided by each row's own key, whatever task it is in."""
    if share >= 1:
        return np.ones(len(key), bool)
    salt = _mix(np.array([(seed * 0x9E3779B97F4A7C15 + round_) & 0xFFFFFFFFFFFFFFFF], np.uint64))
    return (_mix(key.view(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) < share * 2.0 ** 53


def columns_of(params: BoostParams, n: int, round_: int) -> np.ndarray:
    """The features a round's tree may use."""
    k = max(1, int(params.colsample * n))
    return np.sort(np.random.default_rng([params.seed, round_]).permutation(n)[:k])


def soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def score(g: np.ndarray, h: np.ndarray, p: BoostParams) -> np.ndarray:
    """What a leaf with these sums takes off the loss, twice."""
    size = np.abs(g)
    if p.reg_alpha:
        size -= p.reg_alpha
        np.maximum(size, 0.0, out=size)
    size *= size
    size /= h + p.reg_lambda if p.reg_lambda > 0 else np.maximum(h, 1e-300)
    return size


def leaf_value(g: float, h: float, p: BoostParams) -> float:
    return 0.0 if h <= 0 else float(-p.learning_rate * soft(np.float64(g), p.reg_alpha) / (h + p.reg_lambda))


def best_splits(g: np.ndarray, h: np.ndarray, n_cuts: np.ndarray, p: BoostParams) -> list[tuple | None]:
    """Each node's best split from its sums by (feature, bin), the last bin holding the NULLs.

    A split is (feature's index, bin, NULLs go left, gain, left sums, right sums).
    Equal gains take the first feature, then the lowest bin, then NULLs right.
    ``symmetric``: all nodes take the one split with the largest total gain."""
    total_g, total_h = g[:, :1].sum(axis=2)[..., None], h[:, :1].sum(axis=2)[..., None]
    lg, lh = np.cumsum(g[..., :-1], axis=2), np.cumsum(h[..., :-1], axis=2)
    if h[..., -1].any():
        lg, lh = np.stack([lg, lg + g[..., -1:]], axis=3), np.stack([lh, lh + h[..., -1:]], axis=3)  # NULLs right, NULLs left
    else:
        lg, lh = lg[..., None], lh[..., None]
    rg, rh = total_g[..., None] - lg, total_h[..., None] - lh
    gain = 0.5 * (score(lg, lh, p) + score(rg, rh, p) - score(total_g, total_h, p)[..., None])
    allowed = (np.arange(lg.shape[2])[None, :] < n_cuts[:, None])[None, ..., None]
    if p.symmetric:
        empty = (lh == 0) | (rh == 0)
        gain = np.where(empty, 0.0, gain).sum(axis=0, keepdims=True)
        gain = np.where(allowed & ~empty.all(axis=0, keepdims=True), gain, -np.inf)
    else:
        fits = (lh >= max(p.min_child_weight, 1e-300)) & (rh >= max(p.min_child_weight, 1e-300))
        gain = np.where(allowed & fits, gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    out: list[tuple | None] = []
    for i in range(len(g)):
        k = int(at[0 if p.symmetric else i])
        best = float(flat[0 if p.symmetric else i, k])
        if not best > LEAST_GAIN:
            out.append(None)
            continue
        f, b, d = np.unravel_index(k, gain.shape[1:])
        out.append((int(f), int(b), bool(d), best / (len(g) if p.symmetric else 1),
                    (float(lg[i, f, b, d]), float(lh[i, f, b, d])), (float(rg[i, f, b, d]), float(rh[i, f, b, d]))))
    return out


# --- rows ------------------------------------------------------------------------------

def cut_points(df: DataFrame, features: list[str], bins: int, error: float = 1e-4) -> list[np.ndarray]:
    """At most ``bins - 1`` cut points per feature: quantiles of its values (a distributed sketch), each once."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = df.approxQuantile(features, shares, error)
    return [np.unique(np.asarray(v, np.float64)) for v in found]


def to_bins(values: np.ndarray, cuts: np.ndarray, missing: int) -> np.ndarray:
    """The number of cut points below each value; ``missing`` for NaN."""
    out = np.searchsorted(cuts, values, side="left")
    return np.where(np.isnan(values), missing, out).astype(np.uint8)


def binned_blocks(df: DataFrame, features: list[str], cuts: list[np.ndarray], missing: int) -> DataFrame:
    """Packed blocks of rows: bins (feature by feature), target, held-out flags and sampling keys.

    ``df`` has the features (NULL or NaN: missing), ``target``, ``held_out`` and ``key``."""
    ship_package(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                column = [np.asarray(part.column(i).to_numpy(zero_copy_only=False), np.float64) for i in range(len(features) + 1)]
                bins = np.stack([to_bins(c, k, missing) for c, k in zip(column, cuts)])
                rest = [column[-1], part.column("held_out").to_numpy(zero_copy_only=False), part.column("key").to_numpy()]
                data = [pa.array([x.tobytes()], pa.binary()) for x in (bins, *rest)]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *data], ["n", "bins", "target", "held_out", "key"])

    picked = df.select(*(F.col(c).cast("double") for c in features), F.col("target").cast("double"), F.col("held_out").cast("boolean"),
                       F.col("key").cast("long"))
    return picked.mapInArrow(pack, "n int, bins binary, target binary, held_out binary, key binary")


@dataclass
class Block:
    bins: np.ndarray
    target: np.ndarray
    held_out: np.ndarray
    key: np.ndarray
    prediction: np.ndarray


def unpacked(row, base: float, n_features: int) -> Block:
    n = row["n"]
    return Block(np.frombuffer(row["bins"], np.uint8).reshape(n_features, n), np.frombuffer(row["target"], np.float64),
                 np.frombuffer(row["held_out"], bool), np.frombuffer(row["key"], np.int64), np.full(n, base))


@dataclass
class Level:
    """What a job needs: the tree so far, its open nodes and the round's features."""

    tree: tuple[np.ndarray, ...]
    depth: int
    open: np.ndarray
    columns: np.ndarray
    round: int


def sums_by_bin(bins: np.ndarray, grad: np.ndarray, own: np.ndarray, size: int, columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient sums and counts by (node, feature, bin), flat; ``own``: each row's node."""
    wide = len(columns)
    g, h = np.zeros(size * wide * width), np.zeros(size * wide * width)
    own = own * (wide * width)
    for i, f in enumerate(columns):
        at = own + (i * width + bins[f].astype(np.int64))
        g += np.bincount(at, grad, len(g))
        h += np.bincount(at, minlength=len(h))
    return g, h


def picked_rows(b: Block, level: Level, p: BoostParams, missing: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows in open nodes that the round takes: places, open node's number, rounded gradient."""
    slot = np.full(len(level.tree[0]), -1, np.int64)
    slot[level.open] = np.arange(len(level.open))
    own = slot[route(b.bins, level.tree, missing, level.depth)]
    take = np.flatnonzero((own >= 0) & ~b.held_out & sampled(b.key, p.subsample, p.seed, level.round))
    return take, own[take], np.rint((b.prediction[take] - b.target[take]) / step)


def error_sums(blocks: list[Block]) -> np.ndarray:
    """Squared error and number of the held-out rows, and of the others."""
    lost = np.zeros(4)
    for b in blocks:
        square = (b.prediction - b.target) ** 2
        lost += [float(square[b.held_out].sum()), int(b.held_out.sum()), float(square[~b.held_out].sum()), int((~b.held_out).sum())]
    return lost


def level_sums(blocks: list[Block], level: Level, p: BoostParams, missing: int, step: float, errors: bool) -> tuple:
    """(places, gradient sums, counts) of the open nodes' rows by (node, feature, bin), and the errors' sums."""
    size = len(level.open) * len(level.columns) * (missing + 1)
    g, h = np.zeros(size), np.zeros(size)
    for b in blocks:
        take, own, grad = picked_rows(b, level, p, missing, step)
        if len(take):
            more = sums_by_bin(b.bins[:, take], grad, own, len(level.open), level.columns, missing + 1)
            g, h = g + more[0], h + more[1]
    at = np.flatnonzero(h)
    return at.astype(np.int32), g[at], h[at], error_sums(blocks) if errors else np.zeros(4)


def node_rows(blocks: list[Block], level: Level, p: BoostParams, missing: int, step: float) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(node, (bins, rounded gradients)) of the open nodes' rows of a task."""
    found: dict[int, list] = {}
    for b in blocks:
        take, own, grad = picked_rows(b, level, p, missing, step)
        order = np.argsort(own, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if len(part):
                found.setdefault(int(level.open[own[part[0]]]), []).append((b.bins[:, take[part]], grad[part]))
    return [(node, (np.concatenate([x[0] for x in of], axis=1), np.concatenate([x[1] for x in of]))) for node, of in found.items()]


def grown_below(parts: list[tuple[np.ndarray, np.ndarray]], depth: int, columns: np.ndarray, n_cuts: np.ndarray, p: BoostParams,
                missing: int, step: float) -> Grown:
    """The tree over one node's rows (dealt in parts), at most ``depth`` levels deep."""
    bins, grad = np.concatenate([x[0] for x in parts], axis=1), np.concatenate([x[1] for x in parts])
    tree, opened = Grown(), np.array([0])
    tree.sums[0] = (float(grad.sum()) * step, float(len(grad)))
    at, rows = np.zeros(len(grad), np.int64), np.arange(len(grad))
    for level in range(depth):
        slot = np.full(len(tree.feature), -1, np.int64)
        slot[opened] = np.arange(len(opened))
        own = slot[at]
        keep = np.flatnonzero(own >= 0)
        g, h = sums_by_bin(bins[:, keep], grad[keep], own[keep], len(opened), columns, missing + 1)
        shape = (len(opened), len(columns), missing + 1)
        following = split_all(tree, opened, g.reshape(shape) * step, h.reshape(shape), columns, n_cuts, p)
        if not following:
            break
        opened, tree.depth = np.array(following), level + 1
        feature, bin_, missing_left, left, right = tree.arrays()
        mine = bins[np.maximum(feature[at], 0), rows]
        at = np.where(np.where(mine == missing, missing_left[at], mine <= bin_[at]), left[at], right[at])
    return tree


def tree_values(tree: Grown, p: BoostParams) -> np.ndarray:
    """What each node adds to a prediction (0 above the leaves)."""
    return np.array([0.0 if f >= 0 else leaf_value(*s, p) for f, s in zip(tree.feature, tree.sums)])


def more(b: Block, tree: tuple[np.ndarray, ...], values: np.ndarray, depth: int, missing: int) -> Block:
    return Block(b.bins, b.target, b.held_out, b.key, b.prediction + values[route(b.bins, tree, missing, depth)])


def rounds_below(blocks: list[Block], first: int, n: int, n_cuts: np.ndarray, p: BoostParams, missing: int, step: float) -> list[tuple[Grown, np.ndarray]]:
    """``n`` rounds over all rows of a small table: each one's tree, and the errors' sums with it."""
    out = []
    for round_ in range(first, first + n):
        columns = columns_of(p, len(n_cuts), round_)
        picked = node_rows(blocks, Level(Grown().arrays(), 0, np.array([0]), columns, round_), p, missing, step)
        tree = grown_below([x for _, x in picked], p.depth, columns, n_cuts, p, missing, step) if picked else Grown()
        arrays, values = tree.arrays(), tree_values(tree, p)
        blocks = [more(b, arrays, values, tree.depth, missing) for b in blocks]
        out.append((tree, error_sums(blocks)))
    return out


def split_all(tree: Grown, opened, g: np.ndarray, h: np.ndarray, columns: np.ndarray, n_cuts: np.ndarray, p: BoostParams) -> list[int]:
    """Split the open nodes as their sums tell; the new open nodes."""
    following = []
    for node, found in zip(opened, best_splits(g, h, n_cuts[columns], p)):
        if found is not None:
            f, b, d, gain, left, right = found
            following += tree.split(int(node), int(columns[f]), b, d, gain, (left, right))
    return following


def _together(a: tuple, b: tuple) -> tuple:
    at, which = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return (at, np.bincount(which, np.concatenate([a[1], b[1]]), len(at)), np.bincount(which, np.concatenate([a[2], b[2]]), len(at)),
            a[3] + b[3])


class Rows:
    """The training rows as a persisted table of blocks with their predictions so far."""

    def __init__(self, blocks: RDD, base: float, n_features: int, p: BoostParams, missing: int, step: float):
        self.p, self.missing, self.step = p, missing, step
        self.state = blocks.map(lambda row: unpacked(row, base, n_features)).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: RDD | None = None
        self.rounds = 0

    def below(self, level: Level, depths: dict[int, int], n_cuts: np.ndarray, errors: bool) -> tuple[list[tuple[int, Grown]], np.ndarray]:
        """The trees below the open nodes, each grown by one task, and the errors' sums."""
        p, missing, step, state = self.p, self.missing, self.step, self.state
        grow_one = lambda node, parts: grown_below(parts, depths[node], level.columns, n_cuts, p, missing, step)
        if state.getNumPartitions() == 1:  # the rows of every node are in one task already
            def alone(blocks: Iterator[Block]) -> list:
                held = list(blocks)
                found = [(node, grow_one(node, [part])) for node, part in node_rows(held, level, p, missing, step)]
                return [*found, (-1, error_sums(held) if errors else np.zeros(4))]

            found = state.mapPartitions(alone).collect()
        else:
            def dealt(blocks: Iterator[Block]) -> list:
                held = list(blocks)
                return [*node_rows(held, level, p, missing, step), (-1, error_sums(held) if errors else np.zeros(4))]

            tasks = min(len(level.open) + 1, state.getNumPartitions())
            found = (state.mapPartitions(dealt).groupByKey(tasks)
                     .map(lambda x: (x[0], grow_one(x[0], list(x[1]))) if x[0] >= 0 else (-1, sum(x[1]))).collect())
        self._settled()
        return [x for x in found if x[0] >= 0], next(x[1] for x in found if x[0] < 0)

    def _settled(self) -> None:
        if self.before is not None:  # the new predictions are there now
            self.before.unpersist()
            self.before = None

    def sums(self, level: Level, errors: bool = False) -> tuple:
        p, missing, step = self.p, self.missing, self.step
        parts = self.state.mapPartitions(lambda blocks: [level_sums(list(blocks), level, p, missing, step, errors)])
        if parts.getNumPartitions() <= PARTIALS:
            found = parts.collect()
            out = found[0]
            for more in found[1:]:
                out = _together(out, more)
        else:
            out = parts.treeReduce(_together, depth=max(2, math.ceil(math.log(parts.getNumPartitions(), PARTIALS))))
        self._settled()
        return out

    def add(self, trees: list[Grown]) -> None:
        """Add trees to the predictions (with the next job)."""
        p, missing, known = self.p, self.missing, [(t.arrays(), tree_values(t, self.p), t.depth) for t in trees]

        def added(b: Block) -> Block:
            for arrays, values, depth in known:
                b = more(b, arrays, values, depth, missing)
            return b

        self.before = self.state
        self.state = self.state.map(added).persist(StorageLevel.MEMORY_AND_DISK)
        self.rounds += len(trees)
        if self.rounds % KEEP_ROUNDS == 0:
            self.state.checkpoint()

    def together(self, first: int, n: int, n_cuts: np.ndarray) -> list[tuple[Grown, np.ndarray]]:
        """Several rounds in one job, if all rows are in one task."""
        p, missing, step = self.p, self.missing, self.step
        out = self.state.mapPartitions(lambda blocks: rounds_below(list(blocks), first, n, n_cuts, p, missing, step)).collect()
        self._settled()
        return out

    def close(self) -> None:
        self.state.unpersist()
        if self.before is not None:
            self.before.unpersist()


# --- fit -------------------------------------------------------------------------------

@dataclass
class Boosted:
    trees: Trees
    params: BoostParams
    features: list[str]
    train_rmse: list[float]
    held_out_rmse: list[float]
    best_round: int | None

    @property
    def importances(self) -> list[float]:
        """Total gain of each feature's splits, summing to 1."""
        inner = self.trees.feature >= 0
        total = np.bincount(self.trees.feature[inner], self.trees.gain[inner], len(self.features))
        return (total / total.sum()).tolist() if total.sum() > 0 else total.tolist()


def grow(rows: Rows, p: BoostParams, n_cuts: np.ndarray, missing: int, step: float, round_: int, n_rows: int,
         local_rows: int) -> tuple[Grown, np.ndarray]:
    """One tree, and the sums of errors that the first job returned."""
    tree, width = Grown(), missing + 1
    columns = columns_of(p, len(n_cuts), round_)
    opened, depths, lost = [0], {}, None
    tree.sums[0] = (0.0, float(n_rows))
    for depth in range(p.depth):
        small = [i for i in opened if tree.sums[i][1] <= local_rows]
        if p.symmetric and (depth or len(small) < len(opened)):
            small = []  # a level's nodes are split together
        depths.update((i, p.depth - depth) for i in small)
        opened = [i for i in opened if i not in depths]
        if not opened:
            break
        at, g, h, errors = rows.sums(Level(tree.arrays(), depth, np.array(opened), columns, round_), lost is None)
        lost = errors if lost is None else lost
        shape = (len(opened), len(columns), width)
        full_g, full_h = np.zeros(shape), np.zeros(shape)
        full_g.reshape(-1)[at], full_h.reshape(-1)[at] = g * step, h
        if depth == 0:
            tree.sums[0] = (float(full_g[0, 0].sum()), float(full_h[0, 0].sum()))
        opened = split_all(tree, opened, full_g, full_h, columns, n_cuts, p)
        if not opened:
            break
        tree.depth = depth + 1
    if depths:
        level = Level(tree.arrays(), tree.depth, np.array(sorted(depths)), columns, round_)
        found, errors = rows.below(level, depths, n_cuts, lost is None)
        lost = errors if lost is None else lost
        for node, sub in found:
            tree.sums[node] = sub.sums[0]
            tree.graft(node, sub)
            tree.depth = max(tree.depth, p.depth - depths[node] + sub.depth)
    return tree, lost


def all_rounds(rows: Rows, p: BoostParams, n_cuts: np.ndarray, missing: int, step: float, n_rows: int,
               local_rows: int) -> Iterator[tuple[Grown, np.ndarray]]:
    """Each round's tree, and the errors' sums with it."""
    if n_rows <= local_rows and rows.state.getNumPartitions() == 1:
        for first in range(0, p.rounds, KEEP_ROUNDS):
            found = rows.together(first, min(KEEP_ROUNDS, p.rounds - first), n_cuts)
            yield from found
            rows.add([tree for tree, _ in found])
        return
    last = None
    for round_ in range(p.rounds):
        tree, lost = grow(rows, p, n_cuts, missing, step, round_, n_rows, local_rows)
        if last is not None:
            yield last, lost  # the job that began this round had the errors under the last one
        rows.add([tree])
        last = tree
    if last is not None:
        yield last, rows.sums(Level(Grown().arrays(), 0, np.array([0]), np.array([0]), p.rounds), True)[3]


def exact_step(rows: int, largest: float) -> float:
    """A power of two: sums of ``rows`` multiples of it up to ``4 * largest`` are exact in double precision."""
    if rows <= 0 or largest <= 0:
        return 1.0
    return 2.0 ** math.ceil(math.log2(4 * largest * rows) - 52)


#: A tree's nodes as arrays, in the order of ``Trees``.
KINDS = {"feature": np.int32, "cut": np.float64, "missing_left": bool, "left": np.int64, "right": np.int64, "value": np.float64, "gain": np.float64,
         "cover": np.float64}


def laid_out(t: Grown, cuts: list[np.ndarray], p: BoostParams) -> dict[str, np.ndarray]:
    """A grown tree's nodes as arrays, numbered level by level from left to right."""
    order = [0]
    for i in order:
        if t.feature[i] >= 0:
            order += [t.left[i], t.right[i]]
    place = {node: k for k, node in enumerate(order)}
    rows = []
    for i in order:
        f, inner = t.feature[i], t.feature[i] >= 0
        rows.append((f, float(cuts[f][t.bin[i]]) if inner else 0.0, t.missing_left[i], place[t.left[i]] if inner else place[i],
                     place[t.right[i]] if inner else place[i], 0.0 if inner else leaf_value(*t.sums[i], p), t.gain[i], t.sums[i][1]))
    return {k: np.array(v, kind) for (k, kind), v in zip(KINDS.items(), zip(*rows))}


def assembled(trees: list[dict[str, np.ndarray]], p: BoostParams, base: float) -> Trees:
    """All trees' nodes one after the other."""
    sizes = np.array([len(t["feature"]) for t in trees], np.int64)
    roots = np.cumsum(sizes) - sizes
    joined = {k: np.concatenate([*(t[k] for t in trees), np.zeros(0, kind)]).astype(kind, copy=False) for k, kind in KINDS.items()}
    for k in ("left", "right"):
        joined[k] += np.repeat(roots, sizes)
    return Trees(**joined, roots=roots, base=base, depth=p.depth)


def fit(df: DataFrame, features: list[str], p: BoostParams, task_rows: int | None = None, local_rows: int | None = None) -> Boosted:
    """Boost ``df``: ``features`` (numbers; NULL and NaN are missing), ``target``, ``held_out`` and ``key``.

    Rows without a target are left out.  Trees are fitted to the rows that are not
    held out, beginning with their mean; with ``patience`` the fit stops once so
    many rounds bring no lower error on the held-out rows, and the ensemble keeps
    the rounds up to the best one.  No training row raises.  ``task_rows`` and
    ``local_rows`` are for a job per level, and one that is given chooses it."""
    from dailycast.plans import lockstep

    spark = df.sparkSession
    df = df.where(F.col("target").isNotNull() & ~F.isnan("target"))
    own = df.where(~F.col("held_out"))
    t = F.col("target").cast("double")
    facts = own.agg(F.count("*").alias("n"), F.sum(F.col("target").cast("decimal(38,8)")).cast("double").alias("sum"),
                    F.min(t).alias("low"), F.max(t).alias("high")).first()
    if not facts["n"]:
        raise ValueError("there is no row to train on")
    base = facts["sum"] / facts["n"]
    step = exact_step(facts["n"], max(facts["high"] - base, base - facts["low"]))
    cuts = cut_points(own, features, p.bins)
    missing = p.bins
    path = scratch_path(spark, "boost-rows")
    binned_blocks(df, features, cuts, missing).write.parquet(path)
    stored = spark.read.parquet(path)
    total = stored.agg(F.sum("n")).first()[0]
    shared_dir(spark)  # registers the folder for checkpoints
    n_cuts = np.array([len(c) for c in cuts])
    tasks = lockstep.tasks_for(spark, total) if task_rows is None and local_rows is None else 0
    blocks = stored.repartition(tasks or max(1, -(-total // (task_rows or TASK_ROWS))))
    rows = Rows(blocks.rdd, base, len(features), p, missing, step)
    grown: list[dict[str, np.ndarray]] = []  # as arrays: a tree's lists take four times the memory
    held, train, best = [], [], None
    try:
        for tree, lost in (lockstep.all_rounds(spark, rows.state, n_cuts, p, missing, step) if tasks else
                           all_rounds(rows, p, n_cuts, missing, step, facts["n"], LOCAL_ROWS if local_rows is None else local_rows)):
            grown.append(laid_out(tree, cuts, p))
            train.append(math.sqrt(lost[2] / max(lost[3], 1)))
            if lost[1]:
                held.append(math.sqrt(lost[0] / lost[1]))
                if best is None or held[-1] < held[best]:
                    best = len(held) - 1
                elif p.patience and len(held) - 1 - best >= p.patience:
                    break
    finally:
        rows.close()
    trees = assembled(grown, p, base)
    if p.patience and best is not None:
        trees = trees.first(best + 1)
    return Boosted(trees, p, list(features), train, held, best)


# --- scoring and storage ---------------------------------------------------------------

def with_prediction(df: DataFrame, trees: Trees, features: list[str], name: str = "prediction") -> DataFrame:
    """``df`` with the ensemble's prediction for its feature columns (Arrow batches)."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(trees)  # as many nodes as rounds and depth allow, whatever the rows

    @F.pandas_udf("double")
    def predicted(*columns: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns])
        return pd.Series(shared.value.predict(X))

    return df.withColumn(name, predicted(*(F.col(c).cast("double") for c in features)))


NODES = ("tree int, node int, feature int, cut double, missing_left boolean, left int, right int, value double, gain double, cover double")


#: Trees of a stored chunk.
CHUNK_TREES = 100


def save(spark: SparkSession, model: Boosted, path: str, extra: Mapping | None = None) -> None:
    """Node table (a row per node) and a one-row description, as Parquet.

    Chunks of trees go to tasks as Arrow streams and become rows there: rows made in
    the driver would take ten times the memory of the trees."""
    t = model.trees
    end = np.append(t.roots, len(t.feature))

    def chunk(a: int, b: int) -> bytes:
        at, sizes = slice(int(end[a]), int(end[b])), np.diff(end[a:b + 1])
        first = np.repeat(end[a:b], sizes)
        columns = [np.repeat(np.arange(a, b), sizes).astype(np.int32), (np.arange(at.start, at.stop) - first).astype(np.int32), t.feature[at], t.cut[at],
                   t.missing_left[at], (t.left[at] - first).astype(np.int32), (t.right[at] - first).astype(np.int32), t.value[at], t.gain[at], t.cover[at]]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in NODES.split(", ")])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        return out.getvalue().to_pybytes()

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from pa.ipc.open_stream(data.as_buffer())

    chunks = [(chunk(a, min(a + CHUNK_TREES, t.n_trees)),) for a in range(0, t.n_trees, CHUNK_TREES)]
    spark.createDataFrame(chunks, "trees binary").mapInArrow(nodes, NODES).write.mode("overwrite").parquet(f"{path}/nodes")
    about = {"params": asdict(model.params), "features": model.features, "base": t.base, "depth": t.depth, "trees": t.n_trees,
             "train_rmse": model.train_rmse, "held_out_rmse": model.held_out_rmse, "best_round": model.best_round, **(extra or {})}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[Boosted, dict]:
    about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
    table = spark.read.schema(NODES).parquet(f"{path}/nodes").toArrow()  # columns, not a Python object per value
    order = np.lexsort((table["node"].to_numpy(), table["tree"].to_numpy()))
    sizes = np.bincount(table["tree"].to_numpy(), minlength=about["trees"])
    roots = (np.cumsum(sizes) - sizes).astype(np.int64)
    columns = {k: table[k].to_numpy()[order].astype(kind, copy=False) for k, kind in KINDS.items()}
    for k in ("left", "right"):
        columns[k] += np.repeat(roots, sizes)
    trees = Trees(**columns, roots=roots, base=about["base"], depth=about["depth"])
    return Boosted(trees, BoostParams(**about["params"]), about["features"], about["train_rmse"], about["held_out_rmse"], about["best_round"]), about


def row_key(*columns: Column) -> Column:
    """A key that decides a row's sampling, the same wherever the row lies."""
    return F.xxhash64(*columns)
