"""The greatest dot products of unit vectors, exactly and below all pairs.

Points are dealt to clusters around centres; a cluster's radius, over all its points, bounds the product any of them can
have: that of the centre, and the radius more. A query first goes to the clusters of the greatest products with their
centres, as many as hold k points together; the k-th product found there is the least that can count, and it is sent on
only to clusters whose bound reaches it. Crowded clusters are cut into blocks. Where the points don't cluster, so that
more than half of all pairs would be examined, they are examined block by block instead, as that moves less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.frames import settled

BLOCK = 4096
#: Clusters at most; components of the vectors that centres are learnt from; rounds of learning; the share of all pairs from which blocks are cheaper.
CLUSTERS, SAMPLE, ROUNDS, WORTH = 1024, 1 << 22, 4, 0.5
_SLACK = 1e-9
#: Where all pairs are examined: parts of either side, if that leaves `block` rows in each, and components of the vectors of a part at most. Rows of a tile of queries, and numbers held of it at once.
PARTS, HELD = 8, 1 << 23
TILE, PIECE = 1024, 1 << 22


def centres(sample: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of a sample around its first `count` vectors, moved `rounds` times."""
    out = sample[:count].copy()
    for _ in range(rounds):
        near = _nearest(sample, out)
        sizes = np.bincount(near, minlength=len(out))
        total = np.zeros_like(out)
        np.add.at(total, near, sample)
        out[sizes > 0] = total[sizes > 0] / sizes[sizes > 0, None]
    return out


def _nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (x @ at.T - (at**2).sum(axis=1) / 2).argmax(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tile(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, product) of the k greatest products of each row of q with rows of x, ties to the smaller column. x is looked at piece by piece, so that what is held doesn't grow with it."""
    row, column, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    floor = np.full(len(q), -np.inf)
    step = max(k, PIECE // len(q))
    for low in range(0, len(x), step):
        part = x[low : low + step]
        sims = q @ part.T
        # what is as near as the k-th stays in until it is ranked; the products of matrices differ in their last digits
        take = min(k, len(part))
        first = np.partition(sims, len(part) - take, axis=1)[:, len(part) - take] if take == k and low == 0 else floor
        at, to = np.nonzero(sims >= np.maximum(floor, first)[:, None] - _SLACK)
        if not len(at):
            continue
        for i in range(0, len(at), PIECE):
            some = slice(i, i + PIECE)
            row, column = np.concatenate([row, at[some]]), np.concatenate([column, to[some] + low])
            sim = np.concatenate([sim, _products(q, part, at[some], to[some])])
            order = np.lexsort((column, -sim, row))
            row, column, sim = row[order], column[order], sim[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, column, sim = row[best], column[best], sim[best]
        full = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
        floor[full] = sim[np.searchsorted(row, full, side="right") - 1]
    return row, column, sim


def _products(q: np.ndarray, x: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of rows with rows, summed the same way wherever they stand: copies have the same product to the last digit."""
    step = max(1, PIECE // max(1, q.shape[1]))
    return np.concatenate([(q[at[i : i + step]] * x[to[i : i + step]]).sum(axis=1) for i in range(0, len(at), step)])


def _best(k: int):
    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(queries) and len(points):
            points = points.sort_values("point")
            ids, names = queries["query"].to_numpy(), points["point"].to_numpy()
            q, x = np.stack(queries["vector"].to_numpy()), np.stack(points["vector"].to_numpy())
            for low in range(0, len(q), TILE):
                row, column, sim = _tile(q[low : low + TILE], x, k)
                found.append((ids[low + row], names[column], sim))
        return pd.DataFrame(dict(zip(("query", "point", "sim"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Of (query, point, sim) the k greatest of each query with their rank, ties to the smaller point."""
    order = Window.partitionBy("query").orderBy(F.col("sim").desc(), "point")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def by_blocks(queries: DataFrame, points: DataFrame, n: int, k: int, block: int = BLOCK) -> DataFrame:
    """query, point, sim: in each pair of parts of the n points and of the queries the k best of each query (query, vector) among the points (point, vector).

    Both sides are dealt to the same few parts, so that each row moves PARTS times, until a part's vectors would be too
    much for one task.
    """
    size = points.agg(F.max(F.size("vector")).alias("size")).first()["size"] or 1
    parts = lambda rows: max(1, min(PARTS, -(-rows // block)), -(-rows * size // HELD))
    rows, columns = parts(queries.count()), parts(n)
    # both sides' keys are ints: keys of unlike types hash apart and would never meet
    deal = lambda c, many, name: F.pmod(F.xxhash64(c), F.lit(many)).cast("int").alias(name)
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = queries.select("query", "vector", deal("query", rows, "p"), every(columns).alias("q"))
    right = points.select("point", "vector", deal("point", columns, "q"), every(rows).alias("p"))
    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(_best(k), "query long, point long, sim double")


class Clusters:
    """Clustered points (point, vector) of unit length; examined counts the pairs of query and point that a search has looked at."""

    def __init__(self, points: DataFrame, n: int, block: int = BLOCK):
        self.n, self.block, self.examined = n, block, 0
        count = max(1, min(CLUSTERS, 4 * n // block))
        size = points.agg(F.max(F.size("vector")).alias("size")).first()["size"]
        wanted = max(count, min(16 * count, SAMPLE // max(1, size or 1)))
        # about `wanted` points; they settle where centres lie and no result
        few = points.filter(F.pmod(F.xxhash64("point"), F.lit(n)) < wanted).limit(2 * wanted).select("vector").toArrow()["vector"].combine_chunks()
        sample = _matrix(few)
        self.at = points.sparkSession.sparkContext.broadcast(centres(sample[np.lexsort(sample.T[:2])][np.random.default_rng(0).permutation(len(sample))], count))
        self.points = settled(points.mapInArrow(_assigned(self.at), "point long, vector array<double>, cluster int, apart double"))
        stats = self.points.groupBy("cluster").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect()  # a row a cluster
        radius, sizes = np.full(len(self.at.value), -np.inf), np.zeros(len(self.at.value), np.int64)
        for r in stats:
            radius[r["cluster"]], sizes[r["cluster"]] = r["radius"], r["n"]
        self.stats = points.sparkSession.sparkContext.broadcast((radius, sizes))

    def _visits(self, queries: DataFrame, k: int, onward: bool) -> DataFrame:
        return queries.mapInArrow(_routed(self.at, self.stats, k, onward), "query long, cluster int")

    def _found(self, queries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
        turns = visits.groupBy("cluster").agg(F.ceil(F.count("*") / self.block).cast("int").alias("turns"))
        parts = self.points.groupBy("cluster").agg(F.ceil(F.count("*") / self.block).cast("int").alias("parts"))
        # a row a cluster
        cut = F.broadcast(turns.join(parts, "cluster"))
        every = lambda c, name: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name)
        own = lambda key, c, name: F.pmod(F.xxhash64(key), F.col(c)).cast("int").alias(name)
        right = self.points.join(cut, "cluster").select("cluster", own("point", "parts", "part"), every("turns", "turn"), "point", "vector")
        left = visits.join(cut, "cluster").select("cluster", own("query", "turns", "turn"), every("parts", "part"), "query").join(queries.select("query", "vector"), "query")
        keys = ["cluster", "part", "turn"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best(k), "query long, point long, sim double")

    def _pairs(self, queries: DataFrame, k: int, onward: bool) -> int:
        """What the visits would examine; they themselves may be as many as queries and clusters multiplied, and aren't written for it."""
        return queries.mapInArrow(_routed(self.at, self.stats, k, onward, True), "pairs long").agg(F.sum("pairs").alias("n")).first()["n"] or 0

    def greatest(self, queries: DataFrame, k: int) -> DataFrame:
        """query, point, sim: rows among which are the k greatest of each query (query, vector)."""
        seeds = settled(self._visits(queries, k, False))
        first = settled(ranked(self._found(queries, seeds, k), k))
        floor = first.filter(F.col("rank") == k).select("query", F.col("sim").alias("floor"))
        bound = settled(queries.join(floor, "query", "left"))
        self.examined = self._pairs(queries, k, False) + self._pairs(bound, k, True)
        if self.examined > WORTH * self.n * max(1, queries.count()):
            self.examined = self.n * queries.count()
            return by_blocks(queries, self.points, self.n, k, self.block)
        return first.drop("rank").unionByName(self._found(queries, settled(self._visits(bound, k, True)), k))


def _assigned(at):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vector"))
                near = _nearest(x, at.value)
                apart = np.linalg.norm(x - at.value[near], axis=1)
                yield pa.record_batch([b.column("point"), b.column("vector"), pa.array(near.astype(np.int32)), pa.array(apart)], names=["point", "vector", "cluster", "apart"])

    return run


def _routed(at, stats, k: int, onward: bool, counted: bool = False):
    """Queries to the clusters to begin with or, onward, to the others that may hold what reaches their floor; counted, how many pairs of query and point that makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, sizes = stats.value
        # tables of queries by clusters: a piece of a batch at a time
        step = max(1, PIECE // (4 * len(sizes)))
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            near = _matrix(b.column("vector")) @ at.value.T
            order = np.argsort(-np.where(sizes > 0, near, -np.inf), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            chosen = np.zeros(near.shape, bool)
            np.put_along_axis(chosen, order, held - sizes[order] < k, axis=1)
            chosen &= sizes > 0
            if onward:
                floor = np.array([-np.inf if f is None else f for f in b.column("floor").to_pylist()])
                chosen = ~chosen & (near + radius + _SLACK >= floor[:, None]) & (sizes > 0)
            if counted:
                yield pa.record_batch([pa.array([int((chosen * sizes).sum())], pa.int64())], names=["pairs"])
                continue
            i, cluster = np.nonzero(chosen)
            yield pa.record_batch([b.column("query").take(pa.array(i)), pa.array(cluster.astype(np.int32))], names=["query", "cluster"])

    return run


def greatest(queries: DataFrame, points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query, point, sim, rank: the k points (point, vector) of the greatest dot product with each query (query, vector), ties to the smaller point. Vectors are of unit length, or zero, and all of one size."""
    queries, points = settled(queries), settled(points)
    n = points.count()
    found = by_blocks(queries, points, n, k, block) if n <= block else Clusters(points, n, block).greatest(queries, k)
    return ranked(found, k)
