"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected to a few dimensions with Gaussian (2-stable) coefficients; the squared projected distance of two
points divided by their squared distance then has a chi-square distribution with that many degrees of freedom. The
projected space is cut into cells by a kd-tree over a bounded sample; every row lies in one cell, and within a cell's
block a kd-tree of small leaves is built over all its rows. A query takes the points of a block by growing projected
distance and verifies them by true distance, until the chi-square test holds: a point nearer than the k-th found would,
with the wanted probability, have come up already.

A query first searches its own cell. The k-th distance found there bounds what may follow: it is sent on only to cells
whose box lies within the test's radius of it. Copies of a vector share all their distances, so the index holds a vector
with its smallest ids and asks for it once, however many rows have it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import checkpointed, first_by_hash, has_columns

DIMENSIONS, LEAF, CONFIDENCE, SEED = 16, 64, 0.98, 42
#: Points and queries of one task; projected rows by length of vector that the cells are cut by, and how many make a cell at least.
POINT_BLOCK, QUERY_BLOCK, SAMPLE, CELL_SAMPLE = 8192, 4096, 50_000, 32
CHUNK = 256


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection of the distribution function for an even number of degrees of freedom, which has a closed form."""
    if k % 2:
        raise ValueError("an even number of dimensions is needed")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in their order."""
    total = np.zeros(len(points))
    for i in range(points.shape[1]):
        d = points[:, i] - query[i]
        total += d * d
    return np.sqrt(total)


class Tree:
    """A kd-tree over projections, halved at the median of the widest dimension; its leaves are runs of rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, low: np.ndarray, leaf: int = LEAF):
        order, pieces, work = [], [], [np.arange(len(ids))]
        while work:
            part = work.pop()
            if len(part) <= leaf:
                pieces.append(len(part))
                order.append(part)
                continue
            widest = np.ptp(low[part], axis=0).argmax()
            part = part[np.argsort(low[part, widest], kind="stable")]
            work += [part[len(part) // 2 :], part[: len(part) // 2]]
        self.order = np.concatenate(order)
        self.starts = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)
        self.vectors, self.ids, self.low = vectors[self.order], ids[self.order], low[self.order]
        self.square = (self.vectors**2).sum(axis=1)
        self.least = np.minimum.reduceat(self.low, self.starts[:-1], axis=0) if len(ids) else self.low
        self.most = np.maximum.reduceat(self.low, self.starts[:-1], axis=0) if len(ids) else self.low
        self.verified = 0

    def _verify(self, best: tuple[np.ndarray, np.ndarray], rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of best (rows, squared distances) and rows; ties go by id."""
        self.verified += len(rows)
        d = np.maximum(self.square[rows] + query @ query - 2 * (self.vectors[rows] @ query), 0)
        at, d = np.concatenate([best[0], rows]), np.concatenate([best[1], d])
        if len(d) > k:
            # what is about as near as the k-th stays in until distances are computed as asked for
            near = d <= np.partition(d, k - 1)[k - 1] * (1 + 1e-9) + 1e-12
            at, d = at[near], d[near]
            if len(d) > k:
                exact = distances(self.vectors[at], query) ** 2
                sort = np.lexsort((self.ids[at], exact))[:k]
                at, d = at[sort], exact[sort]
        return at, d

    def nearest(self, query: np.ndarray, low: np.ndarray, k: int, quantile: float, limit: float = math.inf, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k nearest found, none beyond limit and none of the id own, in no order."""
        best = (np.empty(0, np.int64), np.empty(0))
        if not len(self.ids):
            return best
        slack = 1e-15 * float(query @ query)  # copies of the query, at 0 but for rounding, are seen all
        radius = lambda: quantile * min(limit**2, best[1].max() if len(best[1]) == k else math.inf) + slack
        outside = np.maximum(np.maximum(self.least - low, low - self.most), 0)
        reach = (outside**2).sum(axis=1)
        visit = np.argsort(reach, kind="stable")

        def rows_of(leaves: np.ndarray) -> np.ndarray:
            rows = np.concatenate([np.arange(self.starts[j], self.starts[j + 1]) for j in leaves] or [np.empty(0, np.int64)])
            return rows if own is None else rows[self.ids[rows] != own]

        first = 0
        if limit == math.inf:  # a bound to begin with, from the nearest leaves
            first = int(np.searchsorted(np.cumsum((self.starts[1:] - self.starts[:-1])[visit]), 2 * k)) + 1
            best = self._verify(best, rows_of(visit[:first]), query, k)
        visit = visit[first:]
        rows = rows_of(visit[reach[visit] <= radius()])
        apart = ((self.low[rows] - low) ** 2).sum(axis=1)
        sort = np.argsort(apart, kind="stable")
        rows, apart = rows[sort], apart[sort]
        for at in range(0, len(rows), CHUNK):
            end = at + int(np.searchsorted(apart[at : at + CHUNK], radius(), side="right"))
            if end == at:  # the test holds
                break
            best = self._verify(best, rows[at:end], query, k)
        exact = distances(self.vectors[best[0]], query)
        inside = exact <= limit
        return best[0][inside], exact[inside]


class Cells:
    """Cuts of the projected space: a kd-tree whose leaves are numbered, and their boxes."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim, self.value, self.after, boxes = [], [], [], []
        k = sample.shape[1]
        smallest = max(CELL_SAMPLE, -(-len(sample) // max(1, cells)))
        work = [(sample, np.full(k, -np.inf), np.full(k, np.inf), None)]
        while work:
            part, least, most, parent = work.pop()
            if parent is not None:
                self.after[parent[0]][parent[1]] = len(self.dim)
            widest = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
            x = part[:, widest]
            if len(part) <= smallest or x.min() == x.max():
                self.dim.append(-1)
                self.value.append(float(len(boxes)))
                self.after.append([0, 0])
                boxes.append((least, most))
                continue
            cut = np.median(x)
            cut = x[x < x.max()].max() if cut >= x.max() else cut
            here = len(self.dim)
            self.dim.append(widest)
            self.value.append(float(cut))
            self.after.append([0, 0])
            low, high = most.copy(), least.copy()
            low[widest] = high[widest] = cut
            work += [(part[x > cut], high, most, (here, 1)), (part[x <= cut], least, low, (here, 0))]
        self.dim, self.value, self.after = np.array(self.dim), np.array(self.value), np.array(self.after)
        self.least, self.most = (np.stack(x) for x in zip(*boxes, strict=True))

    def of(self, low: np.ndarray) -> np.ndarray:
        at = np.zeros(len(low), np.int64)
        while (inner := self.dim[at] >= 0).any():
            i = np.flatnonzero(inner)
            node = at[i]
            at[i] = self.after[node, (low[i, self.dim[node]] > self.value[node]).astype(int)]
        return self.value[at].astype(np.int32)

    def within(self, low: np.ndarray, radius: float) -> np.ndarray:
        """The cells whose boxes have a squared distance of at most radius."""
        outside = np.maximum(np.maximum(self.least - low, low - self.most), 0)
        return np.flatnonzero((outside**2).sum(axis=1) <= radius).astype(np.int32)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _projected(dimensions: int, seed: int):
    def run(batches):
        for b in batches:
            low = [None] * b.num_rows
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                projection = np.random.default_rng([seed, size]).standard_normal((size, dimensions))
                for i, x in zip(at, _matrix(b.column("vector").take(pa.array(at))) @ projection, strict=True):
                    low[i] = x
            yield pa.record_batch([*b.columns, pa.array(low, pa.list_(pa.float64()))], names=[*b.schema.names, "low"])

    return run


def _placed(cells):
    def run(batches):
        for b in batches:
            sizes, low = b.column("size").to_numpy(), _matrix(b.column("low")) if b.num_rows else None
            out = np.zeros(b.num_rows, np.int32)
            for size in np.unique(sizes):
                out[sizes == size] = cells.value[int(size)].of(low[sizes == size])
            yield pa.record_batch([*b.columns, pa.array(out)], names=[*b.schema.names, "cell"])

    return run


def _sent_on(cells, quantile: float):
    """Queries (..., size, low, cell, limit) once for each other cell that may hold nearer points."""

    def run(batches):
        for b in batches:
            rows, to = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            low, limit, home, sizes = _matrix(b.column("low")) if b.num_rows else (), *(b.column(c).to_numpy() for c in ("limit", "cell", "size"))
            for i, x in enumerate(low):
                found = cells.value[int(sizes[i])].within(x, quantile * limit[i] ** 2 * (1 + 1e-9) + 1e-12)
                found = found[found != home[i]]
                rows.append(np.full(len(found), i))
                to.append(found)
            out = b.take(pa.array(np.concatenate(rows)))
            yield pa.record_batch([pa.array(np.concatenate(to)) if c == "cell" else out.column(c) for c in out.schema.names], names=out.schema.names)

    return run


def _searched(k: int, quantile: float):
    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = {"asked": [], "row": [], "vec_id": [], "score": []}
        if len(queries) and len(points):
            whole = lambda c: np.stack(c.to_numpy()).astype(np.float64)
            rows, ids = points["row"].to_numpy(), points["vec_id"].to_numpy()
            tree = Tree(whole(points["vector"]), ids, whole(points["low"]))
            for i, v, low, limit, one, own in zip(queries["asked"].to_numpy(), whole(queries["vector"]), whole(queries["low"]), queries["limit"].to_numpy(), queries["one"], queries["own"].to_numpy(), strict=True):
                at, d = tree.nearest(v, low, k, quantile, limit, None if one else own)
                at = tree.order[at]
                for c, x in (("asked", np.full(len(at), i)), ("row", rows[at]), ("vec_id", ids[at]), ("score", d)):
                    out[c].append(x)
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, np.float64 if c == "score" else np.int64) for c, v in out.items()})

    return run


def _searches(asked: DataFrame, points: DataFrame, k: int, quantile: float, point_block: int, query_block: int) -> DataFrame:
    """asked, row, vec_id, score: the k nearest of each of asked (asked, one, own, vector, low, size, cell, limit) in its cell of points (row, vec_id, vector, low, size, cell). Crowded cells are cut in blocks by hash."""
    blocks = lambda df, size, name: df.groupBy("size", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    # a row a cell
    sizes = F.broadcast(blocks(points, point_block, "parts").join(blocks(asked, query_block, "turns"), ["size", "cell"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    p = points.join(sizes, ["size", "cell"]).select("row", "vec_id", "vector", "low", "size", "cell", own("row", "parts").alias("part"), every("turns").alias("turn"))
    q = asked.join(sizes, ["size", "cell"]).select("asked", "one", "own", "vector", "low", "limit", "size", "cell", own("asked", "turns").alias("turn"), every("parts").alias("part"))
    keys = ["size", "cell", "part", "turn"]
    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(_searched(k, quantile), "asked long, row long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 10, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, seed: int = SEED, point_block: int = POINT_BLOCK, query_block: int = QUERY_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, nearest first, ties to the smaller vec_id.

    vectors: vec_id, embedding; queries: a condition on vec_id that tells the query rows. A query's candidates are all
    rows of other vec_ids; rows that are wholly alike count once, and several vectors of one vec_id are candidates each, and
    as a query ask for their id together (the smallest distance counts). Null, empty and zero vectors and those with a
    null or non-finite component take no part, nor do rows without vec_id. Vectors of different lengths have no distance.
    The cells are cut by at most `sample` rows of each length; every row is indexed. Other columns are ignored; an empty
    table gives no rows.
    """
    has_columns(vectors, ["vec_id", "embedding"])
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter(fine).distinct()
    rows = checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.size("vector").alias("size")))
    ids = rows.filter(queries).groupBy("vec_id").agg(F.count("*").alias("n"))
    # rows with one vector ask together, and leave out their own afterwards; an id with several vectors leaves out all its rows as it searches
    one = F.col("n") == 1
    asking = rows.join(ids, "vec_id").select(F.col("vec_id").alias("query_id"), "vector", "size", one.alias("one"), F.when(one, F.lit(0).cast("long")).otherwise(F.col("vec_id")).alias("own"))
    most = k + 1
    # of the rows with one vector only those with the smallest ids can be among the nearest of any query
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    held = rows.withColumn("copy", copy).filter(F.col("copy") <= most).drop("copy")
    held = checkpointed(held.mapInArrow(_projected(dimensions, seed), "row long, vec_id long, vector array<double>, size int, low array<double>"))
    cells = {}
    # a row a length
    counts = {r["size"]: r["n"] for r in held.groupBy("size").agg(F.count("*").alias("n")).collect()}
    taken = first_by_hash(held.select("size", "row", "low"), "size", sample, "row").select("size", "low").toArrow()
    for size, n in counts.items():
        low = taken["low"].filter(pa.compute.equal(taken["size"], size)).combine_chunks()
        cells[size] = Cells(_matrix(low), -(-n // point_block))
    cells = spark.sparkContext.broadcast(cells)  # bounded by the sample
    points = held.mapInArrow(_placed(cells), "row long, vec_id long, vector array<double>, size int, low array<double>, cell int")
    asked = asking.select("vector", "size", "one", "own").distinct()
    asked = checkpointed(asked.select(F.monotonically_increasing_id().alias("asked"), "one", "own", "vector", "size"))
    wide = "asked long, one boolean, own long, vector array<double>, size int, low array<double>"
    home = asked.mapInArrow(_projected(dimensions, seed), wide).mapInArrow(_placed(cells), f"{wide}, cell int").withColumn("limit", F.lit(float("inf")))
    home = checkpointed(home)
    quantile = chi_square_quantile(confidence, dimensions)
    search = lambda q: _searches(q, points, most, quantile, point_block, query_block)
    order = Window.partitionBy("asked").orderBy("score", "vec_id", "row")
    best = lambda found: found.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most).drop("turn")
    first = checkpointed(best(search(home)))
    known = first.groupBy("asked").agg(F.max("score").alias("worst"), F.count("*").alias("n")).filter(F.col("n") == most)
    limited = home.drop("limit").join(known.select("asked", "worst"), "asked", "left").select(*home.drop("limit").columns, F.coalesce("worst", F.lit(float("inf"))).alias("limit"))
    onward = checkpointed(limited.mapInArrow(_sent_on(cells, quantile), f"{wide}, cell int, limit double"))
    found = checkpointed(best(first.unionByName(search(onward))))
    named = asking.join(asked.select("asked", "vector", "one", "own"), ["vector", "one", "own"]).select("query_id", "asked")
    each = named.join(found, "asked").filter("vec_id <> query_id").groupBy("query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy("score", "vec_id", "row")
    return each.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
