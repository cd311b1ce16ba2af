"""Boosting rounds of tasks that keep their rows (M5-M8).

A barrier stage starts all its tasks together.  Each one holds its share of the
rows for many rounds, so a tree level costs one exchange of sums and no job:

* A task sums gradients and counts of its rows by (node, feature, bin).  Of two
  siblings only the smaller one is summed, the other is the parent's rest.
* The tasks' sums meet as files in the shared folder, read by every task (a
  barrier's own ``allGather`` takes a second a call).  Their size is bounded by
  nodes x features x bins, whatever the number of rows.
* Every task adds the sums in the same order and finds the same splits by the
  code of ``boosting``; rows go on with their node, so none is routed twice.
* After ``JOB_ROUNDS`` rounds the job ends: rows and predictions are persisted and
  checkpointed, so a lost executor repeats that many rounds at most."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.sql import SparkSession

from dailycast.plans import boosting as bo
from dailycast.session import scratch_path

#: Rows of a task (if there are so many slots), rows that a task may hold, rounds of a job, seconds to wait for a partner.
SHARE_ROWS, HELD_ROWS, JOB_ROUNDS, PATIENCE_S = 1 << 15, 1 << 22, 100, 900


def tasks_for(spark: SparkSession, n_rows: int, held_rows: int = HELD_ROWS) -> int:
    """How many tasks hold ``n_rows`` together; 0 if they cannot all run at once, share no folder or the rows are too many."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true" or conf.get("spark.task.cpus", "1") != "1":
        return 0
    if conf.contains("spark.default.parallelism") or not scratch_path(spark, "sums").startswith(("/", "file:/")):
        return 0
    slots = spark.sparkContext.defaultParallelism
    return min(slots, max(1, -(-n_rows // SHARE_ROWS))) if n_rows <= slots * held_rows else 0


class Partners:
    """All tasks' messages of a step: each one writes its own as a file and reads the others'."""

    def __init__(self, folder: str, task: int, tasks: int):
        self.folder, self.task, self.tasks, self.step = folder, task, tasks, 0
        os.makedirs(folder, exist_ok=True)

    def gather(self, message: bytes) -> list[bytes]:
        if self.tasks == 1:
            return [message]
        name = f"{self.folder}/{self.step}-{self.task}"
        with open(name + ".part", "wb") as f:
            f.write(message)
        os.replace(name + ".part", name)
        found = [message if i == self.task else self._read(f"{self.folder}/{self.step}-{i}") for i in range(self.tasks)]
        if self.step:  # all have written this step, so all have read the one before
            os.remove(f"{self.folder}/{self.step - 1}-{self.task}")
        self.step += 1
        return found

    @staticmethod
    def _read(name: str) -> bytes:
        end = time.monotonic() + PATIENCE_S
        while True:
            try:
                with open(name, "rb") as f:
                    return f.read()
            except FileNotFoundError:
                if time.monotonic() > end:
                    raise TimeoutError(f"no partner has written {name}") from None
                time.sleep(0.0005)


def packed(errors: np.ndarray, g: np.ndarray, h: np.ndarray) -> bytes:
    """Error sums, and the gradient sums and counts where there are rows."""
    at = h > 0
    return b"".join((errors.tobytes(), np.packbits(at).tobytes(), g[at].tobytes(), h[at].astype(np.uint32).tobytes()))


def added(messages: list[bytes], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    errors, g, h = np.zeros(4), np.zeros(cells), np.zeros(cells)
    for m in messages:
        errors += np.frombuffer(m, np.float64, 4)
        n_mask = -(-cells // 8)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8, n_mask, 32), count=cells))
        g[at] += np.frombuffer(m, np.float64, len(at), 32 + n_mask)
        h[at] += np.frombuffer(m, np.uint32, len(at), 32 + n_mask + 8 * len(at))
    return errors, g, h


class Held:
    """A task's rows: one bin number per feature, NULLs behind the feature's last bin."""

    def __init__(self, blocks: list[bo.Block], n_cuts: np.ndarray, p: bo.BoostParams, missing: int, step: float):
        self.p, self.missing, self.step, self.n_cuts = p, missing, step, n_cuts
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])
        self.bins = np.concatenate([*(b.bins for b in blocks), np.zeros((len(n_cuts), 0), np.uint8)], axis=1)
        self.target, self.prediction = (join([getattr(b, c) for b in blocks], np.float64) for c in ("target", "prediction"))
        self.held_out, self.key = join([b.held_out for b in blocks], bool), join([b.key for b in blocks], np.int64)
        self.cells = np.where(self.bins == missing, (n_cuts + 1).astype(np.uint8)[:, None], self.bins)

    def block(self) -> bo.Block:
        return bo.Block(self.bins, self.target, self.held_out, self.key, self.prediction)

    def errors(self) -> np.ndarray:
        return bo.error_sums([self.block()]) if len(self.target) else np.zeros(4)

    def sums(self, rows: np.ndarray, grad: np.ndarray, columns: np.ndarray, starts: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        """Gradient sums and counts of ``rows``, a feature's bins beside the last one's."""
        own = grad[rows]
        for f, a, b in zip(columns, starts, starts[1:]):
            v = self.cells[f][rows].astype(np.intp)
            g[a:b], h[a:b] = np.bincount(v, own, b - a), np.bincount(v, minlength=b - a)

    def divided(self, rows: np.ndarray, taken: int, feature: int, bin_: int, missing_left: bool) -> tuple[tuple, tuple]:
        """A node's rows (those that the round takes come first) and how many are taken, left and right."""
        v = self.cells[feature][rows]
        go = v <= bin_
        if missing_left:
            go |= v == self.n_cuts[feature] + 1
        left = int(np.count_nonzero(go[:taken]))
        return (rows[go], left), (rows[~go], taken - left)

    def wide(self, flat: np.ndarray, columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums by (node, feature, bin) as ``boosting`` has them, the last bin holding the NULLs."""
        out = np.zeros((len(flat), len(columns), self.missing + 1))
        for i, (a, b) in enumerate(zip(starts, starts[1:])):
            out[:, i, :b - a - 1], out[:, i, self.missing] = flat[:, a:b - 1], flat[:, b - 1]
        return out

    def grown(self, round_: int, g: np.ndarray, h: np.ndarray, columns: np.ndarray, starts: np.ndarray, grad: np.ndarray, take: np.ndarray,
              partners: Partners) -> bo.Grown:
        """One tree from the root's sums ``g`` and ``h``; its leaves' values are added to the predictions."""
        p, tree, opened = self.p, bo.Grown(), [0]
        first = slice(0, starts[1])
        tree.sums[0] = (float(g[0, first].sum()) * self.step, float(h[0, first].sum()))
        rows = {0: (np.concatenate([np.flatnonzero(take), np.flatnonzero(~take)]), int(np.count_nonzero(take)))}
        for depth in range(p.depth):
            bo.split_all(tree, opened, self.wide(g, columns, starts) * self.step, self.wide(h, columns, starts), columns, self.n_cuts, p)
            parents = [i for i, node in enumerate(opened) if tree.feature[node] >= 0]
            if not parents:
                break
            tree.depth = depth + 1
            pairs = [(tree.left[opened[i]], tree.right[opened[i]]) for i in parents]
            for i, (l, r) in zip(parents, pairs):
                node = opened[i]
                rows[l], rows[r] = self.divided(*rows.pop(node), tree.feature[node], tree.bin[node], tree.missing_left[node])
            opened = [child for pair in pairs for child in pair]
            if depth + 1 == p.depth:
                break
            small = [0 if tree.sums[l][1] <= tree.sums[r][1] else 1 for l, r in pairs]
            own_g, own_h = np.zeros((len(pairs), starts[-1])), np.zeros((len(pairs), starts[-1]))
            for j, (pair, side) in enumerate(zip(pairs, small)):
                at, taken = rows[pair[side]]
                if taken:
                    self.sums(at[:taken], grad, columns, starts, own_g[j], own_h[j])
            _, less_g, less_h = added(partners.gather(packed(np.zeros(4), own_g.reshape(-1), own_h.reshape(-1))), own_g.size)
            at = 2 * np.arange(len(pairs)) + np.array(small)
            rest = at ^ 1
            before, (g, h) = (g[parents], h[parents]), (np.empty((2 * len(pairs), starts[-1])), np.empty((2 * len(pairs), starts[-1])))
            for new, less, old in ((g, less_g, before[0]), (h, less_h, before[1])):
                new[at] = less.reshape(len(pairs), -1)
                new[rest] = old - new[at]
        values = bo.tree_values(tree, p)
        for node, (at, _) in rows.items():
            self.prediction[at] += values[node]
        return tree

    def rounds(self, first: int, n: int, partners: Partners, best: float, since: int) -> list[tuple[bo.Grown, np.ndarray]]:
        """Rounds ``first`` to ``first + n``, or until the held-out error has not gone below ``best`` for ``patience`` rounds."""
        p, out, last = self.p, [], None
        self.prediction = self.prediction.copy()
        for round_ in range(first, first + n + 1):
            columns = bo.columns_of(p, len(self.n_cuts), round_)
            starts = np.concatenate([[0], np.cumsum(self.n_cuts[columns] + 2)])
            take = ~self.held_out & bo.sampled(self.key, p.subsample, p.seed, round_)
            grad = np.rint((self.prediction - self.target) / self.step)
            g, h = np.zeros(starts[-1]), np.zeros(starts[-1])
            if round_ < first + n:
                self.sums(np.flatnonzero(take), grad, columns, starts, g, h)
            lost, g, h = added(partners.gather(packed(self.errors(), g, h)), starts[-1])
            if last is not None:  # the message that begins a round has the errors under the last one
                out.append((last, lost))
                if lost[1]:
                    e = float(np.sqrt(lost[0] / lost[1]))
                    best, since = (e, 0) if e < best else (best, since + 1)
                    if p.patience and since >= p.patience:
                        break
            if round_ < first + n:
                last = self.grown(round_, g[None], h[None], columns, starts, grad, take, partners)
        return out


def all_rounds(spark: SparkSession, blocks: RDD, n_cuts: np.ndarray, p: bo.BoostParams, missing: int, step: float) -> Iterator[tuple[bo.Grown, np.ndarray]]:
    """Each round's tree, and the errors' sums with it; ``blocks``: one partition per task."""
    best, since, held = float("inf"), 0, blocks
    try:
        for first in range(0, p.rounds, JOB_ROUNDS):
            folder = scratch_path(spark, "boost-sums").replace("file:", "", 1)
            n = min(JOB_ROUNDS, p.rounds - first)

            def job(part: Iterator[bo.Block], folder=folder, first=first, n=n, best=best, since=since) -> list:
                context = BarrierTaskContext.get()
                tasks, own = len(context.getTaskInfos()), uuid.uuid4().hex
                attempt = context.allGather(own)[0] if tasks > 1 else own  # a repeated job reads no older files
                partners = Partners(f"{folder}/{attempt}", context.partitionId(), tasks)
                rows = Held(list(part), n_cuts, p, missing, step)
                found = rows.rounds(first, n, partners, best, since)
                return [rows.block(), found if context.partitionId() == 0 else None]

            before, done = held, held.barrier().mapPartitions(job).persist(StorageLevel.MEMORY_AND_DISK)
            done.checkpoint()
            found = done.filter(lambda x: isinstance(x, list)).collect()[0]
            shutil.rmtree(folder, ignore_errors=True)
            before.unpersist()
            held = done.filter(lambda x: isinstance(x, bo.Block))
            for tree, lost in found:
                if lost[1]:
                    e = float(np.sqrt(lost[0] / lost[1]))
                    best, since = (e, 0) if e < best else (best, since + 1)
                yield tree, lost
    finally:
        held.unpersist()
