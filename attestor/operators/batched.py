"""Many models of one table fitted together: every pass over the rows serves all of them.

A model is a set of features, a mask of the rows it learns from and a way to scale. Logistic models take damped Newton
steps: a pass yields loss, gradient and Hessian of each. Boosted trees grow level by level: a pass yields the histograms of
gradients by model, node, feature and bin. Partitions send sums, whose size depends on the models only, and these are added
up in a tree; so the number of passes doesn't depend on the number of models or rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.frames import settled, shared_folder

ITERATIONS, TOLERANCE = 50, 1e-9
#: Bins of a feature; trees after which the rows' margins are checkpointed; rows that make a partition worth having.
BINS, CHECKPOINT, WORTH = 64, 25, 20_000
Arrays = tuple[np.ndarray, np.ndarray, np.ndarray]


class Model(NamedTuple):
    features: list[str]
    train: Column
    #: Standardise by all rows ("all"), by those it learns from ("train"), or not (None).
    scale: str | None = None


class Logistic(NamedTuple):
    """On raw features: intercept and coefficients of what scaling would make of them; mean and deviation (1 where flat)."""

    intercept: float
    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.deviation @ self.weights + self.intercept


class Table:
    """rows (features, label) with a mask for each model, settled once."""

    def __init__(self, df: DataFrame, models: list[Model], label: str = "label"):
        self.models, self.names = models, list(dict.fromkeys(n for m in models for n in m.features))
        self.columns = [np.array([self.names.index(n) for n in m.features]) for m in models]
        arrays = [F.array(*(F.col(f"`{n}`").cast("double") for n in self.names)).alias("x"), F.col(label).cast("double").alias("y"), F.array(*(m.train.cast("boolean") for m in models)).alias("train")]
        self.rows = settled(df.select(*arrays))

    def summed(self, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
        """part of every batch (x, y, train), added up; None without rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    got = part(*_arrays(b))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        found = self.rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]))
        return None if found.isEmpty() else found.treeReduce(lambda a, b: a + b)

    def scores(self, score: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
        """model, score, label of the rows that a model hasn't learnt from (all rows, where it has learnt from all)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y, train = _arrays(b)
                for i, s in enumerate(score(x)):
                    yield pa.record_batch([pa.array(np.full(len(y), i, np.int32)), pa.array(s), pa.array(y), pa.array(train[:, i])], names=["model", "score", "label", "train"])

        got = self.rows.mapInArrow(run, "model int, score double, label double, train boolean")
        whole = [i for i, n in enumerate(self.unseen()) if not n]
        return got.filter(~F.col("train") | F.col("model").isin(whole)).drop("train")

    def unseen(self) -> np.ndarray:
        sums = self.summed(lambda x, y, train: (~train).sum(axis=0).astype(np.float64))
        return np.zeros(len(self.models)) if sums is None else sums


def _arrays(b: pa.RecordBatch) -> Arrays:
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    y = b.column("y").to_numpy(zero_copy_only=False)
    if b.column("x").flatten().null_count or b.column("y").null_count or not np.isfinite(x).all():
        raise ValueError("features and labels have to be finite numbers")
    return x, y, b.column("train").flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(b.num_rows, -1)


def _scales(table: Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of each model's features; sums of squares are taken around a first mean, so that nothing cancels."""
    d, kinds = len(table.names), [m.scale for m in table.models]
    first = table.summed(lambda x, y, train: np.concatenate([[len(x)], x.sum(axis=0)]))
    if first is None:
        raise ValueError("there are no rows to learn from")
    centre = first[1:] / first[0]

    def moments(x, y, train):
        z = x - centre
        rows = [np.ones(len(x), bool) if kind == "all" else train[:, i] for i, kind in enumerate(kinds)]
        return np.concatenate([np.concatenate([[r.sum()], z[r].sum(axis=0), (z[r] ** 2).sum(axis=0)]) for r in rows])

    out = []
    for kind, at, s in zip(kinds, table.columns, table.summed(moments).reshape(len(kinds), 2 * d + 1), strict=True):
        n = max(s[0], 1)
        mean, spread = s[1 : d + 1] / n, np.sqrt(np.maximum(s[d + 1 :] / n - (s[1 : d + 1] / n) ** 2, 0))
        flat = spread <= 1e-12 * np.maximum(np.abs(centre), 1)
        plain = (np.zeros(len(at)), np.ones(len(at)))
        out.append(((mean + centre)[at], np.where(flat, np.inf, spread)[at]) if kind else plain)  # a flat feature is 0
    return out


def logistic(table: Table, c: float = 1.0, iterations: int = ITERATIONS) -> list[Logistic]:
    """Of each model the minimum of the log losses' sum and |weights|^2 / (2 c); the intercept is free."""
    scales, columns = _scales(table), table.columns
    sizes = [len(at) + 1 for at in columns]

    def evaluated(x, y, train, betas, active):
        out = []
        for i, (at, (mean, deviation)) in enumerate(zip(columns, scales, strict=True)):
            if i not in active:
                continue
            r = train[:, i]
            z = np.column_stack([np.ones(r.sum()), (x[r][:, at] - mean) / deviation])
            t = z @ betas[i]
            p = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
            out += [[(np.logaddexp(0, t) - y[r] * t).sum()], z.T @ (p - y[r]), ((z * (p * (1 - p))[:, None]).T @ z).ravel()]
        return np.concatenate(out)

    betas, trial = [np.zeros(k) for k in sizes], [np.zeros(k) for k in sizes]
    best, steps, active = [np.inf] * len(sizes), [np.zeros(k) for k in sizes], set(range(len(sizes)))
    for _ in range(iterations):
        now = sorted(active)
        sums, at = table.summed(lambda x, y, train, b=trial, a=frozenset(active): evaluated(x, y, train, b, a)), 0
        for i in now:
            k = sizes[i]
            weights = trial[i] * np.r_[0, np.ones(k - 1)]
            loss, slope = sums[at] + weights @ weights / (2 * c), sums[at + 1 : at + 1 + k] + weights / c
            curve = sums[at + 1 + k : at + 1 + k + k * k].reshape(k, k) + np.diag(np.r_[1e-12, np.full(k - 1, 1 / c)])
            at += 1 + k + k * k
            if loss > best[i] + 1e-9 * abs(best[i]):  # too far: half the way
                steps[i] = steps[i] / 2
            else:
                betas[i], best[i], steps[i] = trial[i], loss, -np.linalg.solve(curve, slope)
            trial[i] = betas[i] + steps[i]
            if np.abs(steps[i]).max() < TOLERANCE * max(1, np.abs(betas[i]).max()):
                active.discard(i)
        if not active:
            break
    return [Logistic(float(t[0]), t[1:], *s) for t, s in zip(trial, scales, strict=True)]


def logistic_scores(table: Table, fits: list[Logistic]) -> DataFrame:
    columns = table.columns
    return table.scores(lambda x: [1 / (1 + np.exp(-np.clip(f.margin(x[:, at]), -700, 700))) for f, at in zip(fits, columns, strict=True)])


class Boosted(NamedTuple):
    """Trees of one model: for each tree arrays by node (children of i at 2 i + 1 and 2 i + 2) of feature (-1: a leaf), bin and value; and what features gained."""

    start: float
    trees: list[Arrays]
    gain: np.ndarray


def _walk(bins: np.ndarray, tree: Arrays) -> np.ndarray:
    """The node of each row."""
    feature, cut, _ = tree
    at = np.zeros(len(bins), np.int64)
    while (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        here = at[rows]
        at[rows] = 2 * here + 1 + (bins[rows, feature[here]] > cut[here])
    return at


def _taken(seed: int, tree: int, part: int, rows: int, share: float) -> np.ndarray:
    """The rows of a block that a tree learns from: alike whenever it is asked."""
    return np.random.default_rng([seed, tree, part]).random(rows) < share


def boosted(table: Table, trees: int = 300, depth: int = 4, step: float = 0.05, rows: float = 0.8, columns: float = 0.8, bins: int = BINS, least: float = 0.25, seed: int = 42) -> tuple[list[Boosted], list[np.ndarray]]:
    """(a model's trees for each of table's, the cuts of each feature): gradient boosting of the log loss, each tree on a share of rows and of features, its leaves' values Newton steps.

    Features are binned once at their quantiles. The rows' margins are carried along in blocks, checkpointed now and then.
    """
    spark, m, d = table.rows.sparkSession, len(table.models), len(table.names)
    shared_folder(spark)
    probs = [i / bins for i in range(1, bins)]
    found = table.rows.agg(*(F.percentile_approx(F.col("x")[i], probs, 10_000).alias(f"c{i}") for i in range(d))).first()
    cuts = [np.unique(found[f"c{i}"] or []) for i in range(d)]
    own = [np.isin(np.arange(d), at) for at in table.columns]
    prior = table.summed(lambda x, y, train: np.concatenate([[len(y)], train.sum(axis=0), (train * y[:, None]).sum(axis=0)]).astype(np.float64))
    if prior is None:
        raise ValueError("there are no rows to learn from")
    parts, prior = max(1, int(prior[0] // WORTH)), prior[1:].reshape(2, m)
    rate = np.clip(prior[1] / np.maximum(prior[0], 1), 1e-6, 1 - 1e-6)
    start = np.log(rate / (1 - rate))

    def blocks(index, part):
        for k, b in enumerate(part):
            yield index * 1_000_003 + k, *b

    def binned(batches):
        for b in batches:
            if b.num_rows:
                x, y, train = _arrays(b)
                out = np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)
                yield pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in (out, y, train)], names=["bins", "y", "train"])

    def opened(r):
        y = np.frombuffer(r["y"])
        return np.frombuffer(r["bins"], np.uint8).reshape(len(y), d), y, np.frombuffer(r["train"], bool).reshape(len(y), m), np.tile(start, (len(y), 1))

    packed = settled(table.rows.mapInArrow(binned, "bins binary, y binary, train binary"))
    state = packed.rdd.map(opened).mapPartitionsWithIndex(blocks).coalesce(parts)
    plan = _Plan(own, depth, step, rows, columns, bins, least, seed)
    if parts == 1:  # under WORTH rows for one more: a task grows all trees, by the same steps
        forest, gains = state.mapPartitions(lambda part: [_grown_here(list(part), trees, plan)]).first()
    else:
        forest, gains = _grown_apart(state.persist(StorageLevel.MEMORY_AND_DISK), trees, plan)
    return [Boosted(float(s), f, g[at] / g.sum() if g.sum() else g[at]) for s, f, g, at in zip(start, forest, gains, table.columns, strict=True)], cuts


class _Plan(NamedTuple):
    own: list[np.ndarray]
    depth: int
    step: float
    rows: float
    columns: float
    bins: int
    least: float
    seed: int


def _histograms(part, grown: list[Arrays], first: int, width: int, t: int, plan: _Plan) -> np.ndarray:
    """Sums of gradients and Hessians by model, node of a level, feature and bin."""
    bins, own = plan.bins, plan.own
    total = np.zeros((len(own), 2, width, len(own[0]), bins))
    for k, x, y, train, margin in part:
        sampled = _taken(plan.seed, t, k, len(y), plan.rows)
        for i, features in enumerate(own):
            at = _walk(x, grown[i]) - first
            r = np.flatnonzero(train[:, i] & sampled & (at >= 0))
            p = 1 / (1 + np.exp(-margin[r, i]))
            for j in np.flatnonzero(features):
                where = at[r] * bins + x[r, j]
                total[i, 0, :, j] += np.bincount(where, p - y[r], width * bins).reshape(width, bins)
                total[i, 1, :, j] += np.bincount(where, p * (1 - p), width * bins).reshape(width, bins)
    return total


def _moved(part, grown: list[Arrays]):
    for k, x, y, train, margin in part:
        yield k, x, y, train, margin + np.column_stack([tree[2][_walk(x, tree)] for tree in grown])


def _one_tree(t: int, sums_of: Callable, gains: list[np.ndarray], plan: _Plan) -> list[Arrays]:
    """The next tree of each model; sums_of(grown, first, width) gives the histograms of a level."""
    own, step = plan.own, plan.step
    d, nodes = len(own[0]), 2 ** (plan.depth + 1) - 1
    use = [np.isin(np.arange(d), np.random.default_rng([plan.seed, t]).choice(np.flatnonzero(o), max(1, round(plan.columns * o.sum())), replace=False)) for o in own]
    grown = [(np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)) for _ in own]
    for level in range(plan.depth):
        first, width, open_ = 2**level - 1, 2**level, False
        sums = sums_of(grown, first, width)
        for i, features in enumerate(own):
            g, h = sums[i, 0].cumsum(axis=2), sums[i, 1].cumsum(axis=2)
            any_ = int(np.flatnonzero(features)[0])
            feature, cut, value = grown[i]
            for n in range(width):
                if level and feature[(first + n - 1) // 2] < 0:
                    continue
                all_g, all_h = g[n, any_, -1], h[n, any_, -1]
                if not level:
                    value[0] = -step * all_g / max(all_h, 1e-9)
                left_g, left_h = g[n, :, :-1], h[n, :, :-1]
                right_g, right_h = all_g - left_g, all_h - left_h
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = left_g**2 / left_h + right_g**2 / right_h - all_g**2 / max(all_h, 1e-9)
                gain = np.where(use[i][:, None] & (left_h >= plan.least) & (right_h >= plan.least), gain, -np.inf)
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > 1e-9:
                    feature[first + n], cut[first + n], open_ = j, b, True
                    at = 2 * (first + n) + 1
                    value[at], value[at + 1] = -step * left_g[j, b] / left_h[j, b], -step * right_g[j, b] / right_h[j, b]
                    gains[i][j] += gain[j, b]
        if not open_:
            break
    return grown


def _grown_here(part: list, trees: int, plan: _Plan) -> tuple[list, list]:
    forest, gains = [[] for _ in plan.own], [np.zeros(len(plan.own[0])) for _ in plan.own]
    for t in range(trees):
        grown = _one_tree(t, lambda g, first, width, t=t, part=part: _histograms(part, g, first, width, t, plan), gains, plan)
        part = list(_moved(part, grown))
        for f, tree in zip(forest, grown, strict=True):
            f.append(tree)
    return forest, gains


def _grown_apart(state, trees: int, plan: _Plan) -> tuple[list, list]:
    """As _grown_here over the partitions of state; a tree's margins are carried into the next by the first pass that needs them."""
    forest, gains, earlier = [[] for _ in plan.own], [np.zeros(len(plan.own[0])) for _ in plan.own], None
    for t in range(trees):

        def sums_of(grown, first, width, t=t, now=state):
            return now.mapPartitions(lambda part: [_histograms(part, grown, first, width, t, plan)]).treeReduce(lambda a, b: a + b)

        grown = _one_tree(t, sums_of, gains, plan)
        if earlier is not None:
            earlier.unpersist()
        earlier, state = state, state.mapPartitions(lambda part, grown=grown: _moved(part, grown)).persist(StorageLevel.MEMORY_AND_DISK)
        if t % CHECKPOINT == CHECKPOINT - 1:
            state.checkpoint()
            state.count()
        for f, tree in zip(forest, grown, strict=True):
            f.append(tree)
    for held in (earlier, state):
        if held is not None:
            held.unpersist()
    return forest, gains


def boosted_scores(table: Table, fits: list[Boosted], cuts: list[np.ndarray]) -> DataFrame:
    def score(x):
        bins = np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)])
        return [1 / (1 + np.exp(-(f.start + sum((t[2][_walk(bins, t)] for t in f.trees), np.zeros(len(x)))))) for f in fits]

    return table.scores(score)
