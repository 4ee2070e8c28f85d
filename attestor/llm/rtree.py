"""Hard negatives by inner product, through an R-tree packed by Sort-Tile-Recursive.

The index: rows are sorted into slabs by the coordinate that varies most, within a slab by the next, and range-partitioned
into tiles of equal size, labels apart; each tile packs its rows by the same rule, by whichever coordinate spreads widest,
into leaves of one label. A leaf's minimum bounding box gives the interval of each coordinate, and with an anchor the
interval of its inner product; so do groups of leaves, and tiles.

A search is a set of score windows for an anchor. It first goes to the tile whose box promises the highest score; what is
found there bounds the others, and it is sent on only to tiles whose interval meets a window and doesn't lie strictly below
the k-th found. In a tile a queue yields the groups of leaves best first, and boxes outside all windows, or strictly below
every k-th, are never opened. Copies of a vector with one label share all scores, so the index holds their smallest ids
only, as many as any search can return.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import has_columns, stored

POSITIVES, NEGATIVES, SCALE = 5, 10, 256.0
#: Components of a tile's vectors; rows of a leaf; leaves of a group; anchors of a task; boxes at most that tell anchors where to go; slabs at most.
TILE, LEAF, FANOUT, ANCHOR_BLOCK, BOXES, SLABS = 1 << 19, 64, 16, 1024, 1024, 256
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_FOUND = "anchor long, want long, vec_id long, score long"


def packed(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Runs of at most `leaf` rows: sorted by the coordinate that spreads widest and cut into slices, thrice over, the last time into leaves."""
    out, work = [], [(np.arange(len(x)), 3)]
    while work:
        part, left = work.pop()
        pages = -(-len(part) // leaf)
        if pages <= 1:
            out.append(part)
            continue
        part = part[np.argsort(x[part, np.ptp(x[part], axis=0).argmax()], kind="stable")]
        slices = pages if left == 1 else int(np.ceil(pages ** (1 / left)))
        step = -(-pages // slices) * leaf
        work += [(part[i : i + step], left - 1) for i in range(0, len(part), step)][::-1]
    return out


def first(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Where the `count` highest scores are, ties by id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:count], np.int64)
    if len(scores) > 4 * count:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
        return near[np.lexsort((ids[near], -scores[near]))[:count]]
    return np.lexsort((ids, -scores))[:count]


class RTree:
    """A tile's rows in leaves of one label each, and groups of leaves."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaves: np.ndarray):
        order = np.argsort(leaves, kind="stable")
        self.x, self.rows, self.ids = x[order], rows[order], ids[order]
        self.starts = np.flatnonzero(np.r_[True, np.diff(leaves[order]) != 0])
        self.sizes = np.diff(np.r_[self.starts, len(order)])
        self.labels = labels[order][self.starts]
        self.low, self.high = np.minimum.reduceat(self.x, self.starts), np.maximum.reduceat(self.x, self.starts)
        self.groups = np.arange(0, len(self.starts), FANOUT)
        self.group_low, self.group_high = np.minimum.reduceat(self.low, self.groups), np.maximum.reduceat(self.high, self.groups)
        self.opened = 0

    def search(self, query: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], count: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores (both ends inside) the ids and scores of the `count` best rows in it, with the label or of others."""
        plus, minus = np.maximum(query, 0), np.minimum(query, 0)
        interval = lambda low, high: (low @ plus + high @ minus, high @ plus + low @ minus)
        # the ends of 64 bits stand for all that lies beyond
        floors, tops = [-np.inf if w[0] == _LEAST else w[0] for w in windows], [np.inf if w[1] == _MOST else w[1] for w in windows]
        best = [(np.empty(0, np.int64), np.empty(0, self.x.dtype)) for _ in windows]

        def wanted(least, most):
            out = np.zeros(len(least), bool)
            for floor, top in zip(floors, tops, strict=True):
                out |= (most >= floor) & (least <= top)
            return out

        least, most = interval(self.group_low, self.group_high)
        queue = [(-most[j], j) for j in np.flatnonzero(wanted(least, most)).tolist()]
        heapq.heapify(queue)
        while queue:
            top, j = heapq.heappop(queue)
            if -top < min(floors):
                break
            a, b = j * FANOUT, min((j + 1) * FANOUT, len(self.starts))
            of_label = (self.labels[a:b] == label) == same
            if not of_label.any():
                continue
            open_ = of_label & wanted(*interval(self.low[a:b], self.high[a:b]))
            at = int(self.starts[a]) + np.flatnonzero(np.repeat(open_, self.sizes[a:b]))
            self.opened += len(at)
            scores = self.x[at] @ query
            for w, (floor, most_) in enumerate(zip(floors, tops, strict=True)):
                hit = np.flatnonzero((scores >= floor) & (scores <= most_) & (self.rows[at] != own))
                if len(hit):
                    ids, kept = np.concatenate([best[w][0], self.ids[at[hit]]]), np.concatenate([best[w][1], scores[hit]])
                    pick = first(kept, ids, count)
                    best[w] = (ids[pick], kept[pick])
                    if len(pick) == count:
                        floors[w] = kept[pick[-1]]
        return best


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = b.column("size").to_numpy()
        for size in np.unique(sizes):
            x = _matrix(b.column("vector").filter(pa.array(sizes == size)))
            yield pa.record_batch([pa.array([int(size)], pa.int32()), pa.array([len(x)]), pa.array([x.sum(axis=0)], pa.list_(pa.float64())), pa.array([(x * x).sum(axis=0)], pa.list_(pa.float64()))], names=["size", "n", "total", "squares"])


def _leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition is a tile: its rows with the numbers of tile and leaf. Leaves hold one length and label."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    f, leaf = pd.concat(frames, ignore_index=True), 0
    of = np.zeros(len(f), np.int64)
    for at in f.groupby(["size", "label"], sort=True).indices.values():
        for run in packed(np.stack(f["vector"].to_numpy()[at])):
            of[at[run]] = leaf
            leaf += 1
    yield f[["row", "vec_id", "label", "size", "vector"]].assign(tile=TaskContext.get().partitionId(), leaf=of)


def _tile_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = pd.DataFrame({"size": b.column("size").to_numpy(), "tile": b.column("tile").to_numpy()})
        for (size, tile), at in keys.groupby(["size", "tile"]).indices.items():
            x, labels = _matrix(b.column("vector").take(pa.array(at))), b.column("label").take(pa.array(at)).to_numpy()
            one = ([int(size)], [int(tile)], [int(labels.min())], [int(labels.max())], [x.min(axis=0)], [x.max(axis=0)])
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(v, t) for v, t in zip(one, types, strict=True)], names=["size", "tile", "least_label", "most_label", "low", "high"])


def _boxes(index: DataFrame, tiles: int) -> dict:
    """By length of vector: tiles (from, to), labels (from, to) and box of at most BOXES runs of neighbouring tiles."""
    per = -(-tiles // BOXES)
    parts = index.select("size", "tile", "label", "vector").mapInArrow(_tile_boxes, "size int, tile int, least_label long, most_label long, low array<double>, high array<double>")
    sides = parts.select("size", "tile", "least_label", "most_label", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
    key = ["size", F.floor(F.col("tile") / per).alias("run")]
    sides = sides.groupBy(*key, "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.min("tile").alias("first"), F.max("tile").alias("last"), F.min("least_label").alias("least_label"), F.max("most_label").alias("most_label"))
    side = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("at", name))), lambda s: s[name]).alias(name)
    rows = sides.groupBy("size", "run").agg(side("low"), side("high"), *(F.first(c).alias(c) for c in ("first", "last", "least_label", "most_label"))).orderBy("size", "run").collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r["size"], []).append(r)
    whole = lambda rs, c: np.array([r[c] for r in rs])
    return {s: {c: whole(rs, c) for c in ("first", "last", "least_label", "most_label", "low", "high")} for s, rs in found.items()}


def _routed(boxes, same: bool, seed: bool):
    """(anchor, size, tile) of the tiles where a search (anchor, size, label, vector, wants, home) may find something: the most promising for a seed, else all but that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchors, tiles = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            sizes, wants = b.column("size").to_numpy(), b.column("wants").to_pylist()
            out_sizes = [np.empty(0, np.int32)]
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if int(size) not in boxes.value:
                    continue
                x, k = _matrix(b.column("vector").take(pa.array(at))), boxes.value[int(size)]
                plus, minus = np.maximum(x, 0), np.minimum(x, 0)
                with np.errstate(over="ignore", invalid="ignore"):
                    most, least = plus @ k["high"].T + minus @ k["low"].T, plus @ k["low"].T + minus @ k["high"].T
                    slack = 1e-9 * (np.abs(x) @ np.maximum(np.abs(k["low"]), np.abs(k["high"])).T)
                label = b.column("label").to_numpy()[at][:, None]
                fits = (k["least_label"] <= label) & (label <= k["most_label"]) if same else (k["least_label"] != label) | (k["most_label"] != label)
                inside = np.zeros(fits.shape, bool)
                for i, j in enumerate(at):
                    for w in wants[j]:
                        inside[i] |= ~((most[i] + slack[i] < w["low"]) | (least[i] - slack[i] > w["high"]))  # an interval beyond doubles, no number, is inside
                fits &= inside
                if seed:
                    i = np.flatnonzero(fits.any(axis=1))
                    to = k["first"][np.where(fits, most, -np.inf).argmax(axis=1)[i]]
                else:
                    i, box = np.nonzero(fits)
                    many = (k["last"] - k["first"] + 1)[box]
                    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    i, to = np.repeat(i, many), np.repeat(k["first"][box], many) + step
                    elsewhere = to != b.column("home").to_numpy()[at][i]
                    i, to = i[elsewhere], to[elsewhere]
                anchors.append(b.column("anchor").to_numpy()[at[i]])
                tiles.append(to.astype(np.int32))
                out_sizes.append(np.full(len(i), size, np.int32))
            yield pa.record_batch([pa.array(np.concatenate(v)) for v in (anchors, out_sizes, tiles)], names=["anchor", "size", "tile"])

    return run


def _searched(same: bool, count: int):
    def run(asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"anchor": [], "want": [], "vec_id": [], "score": []}
        if len(asked) and len(points):
            x, queries = (np.stack(f["vector"].to_numpy()).astype(np.float64) for f in (points, asked))
            if np.abs(x).max() * np.abs(queries).max() * x.shape[1] >= 2**53:  # beyond what doubles add exactly
                x, queries = (np.array([[int(v) for v in row] for row in m], object) for m in (x, queries))
            tree = RTree(x, *(points[c].to_numpy() for c in ("row", "vec_id", "label", "leaf")))
            for query, anchor, label, wants in zip(queries, asked["anchor"], asked["label"], asked["wants"], strict=True):
                found = tree.search(query, anchor, label, same, [(w["low"], w["high"]) for w in wants], count)
                for w, (ids, scores) in zip(wants, found, strict=True):
                    out["anchor"] += [anchor] * len(ids)
                    out["want"] += [w["want"]] * len(ids)
                    out["vec_id"] += ids.tolist()
                    out["score"] += [min(max(int(s), _LEAST), _MOST) for s in scores]
        return pd.DataFrame({c: np.array(v, np.int64) for c, v in out.items()})

    return run


def _best(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("anchor", "want").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


class Index:
    """The packed rows of a table of row, vec_id, label, size and vector."""

    def __init__(self, rows: DataFrame, copies: int, tile: int = TILE):
        copy = F.row_number().over(Window.partitionBy("hash", "vector", "label").orderBy("vec_id", "row"))
        held = rows.withColumn("hash", F.xxhash64("vector")).withColumn("copy", copy).filter(F.col("copy") <= copies).drop("hash", "copy")
        sums = rows.select("size", "vector").mapInArrow(_moments, "size int, n long, total array<double>, squares array<double>")
        sums = sums.select("size", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("at", "x")).groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("x.total").alias("t"), F.sum("x.squares").alias("q"))
        # a row a length
        axes = sums.groupBy("size").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((F.col("t") * F.col("t") / F.col("n") - F.col("q")).alias("v"), "at"))), lambda s: s["at"]), 1, 2).alias("axes"), F.max("n").alias("n")).collect()
        self.tiles = max(1, -(-sum(r["n"] * r["size"] for r in axes) // tile))
        slabs = min(SLABS, int(np.ceil(np.sqrt(self.tiles))))
        on = lambda k: F.coalesce(*(F.when(F.col("size") == r["size"], F.col("vector")[r["axes"][min(k, len(r["axes"]) - 1)]]) for r in axes), F.lit(0.0))
        cuts = rows.groupBy("size").agg(F.percentile_approx(on(0), [i / slabs for i in range(1, slabs)], 10_000).alias("cuts")) if slabs > 1 else rows.select("size").distinct().withColumn("cuts", F.array().cast("array<double>"))
        placed = held.withColumns({"first": on(0), "second": on(1)}).join(cuts, "size").withColumn("slab", F.size(F.filter("cuts", lambda c: c < F.col("first"))))
        dealt = placed.repartitionByRange(self.tiles, "size", "label", "slab", "second", "row").select("row", "vec_id", "label", "size", "vector")
        self.rows = stored(dealt.mapInPandas(_leaves, "row long, vec_id long, label long, size int, vector array<double>, tile int, leaf long"), "rtree")
        tiles = self.rows.agg(F.max("tile")).first()[0]
        self.boxes = rows.sparkSession.sparkContext.broadcast(_boxes(self.rows, (tiles or 0) + 1))  # BOXES, and one more for each length

    def search(self, anchors: DataFrame, wants: DataFrame, same: bool, count: int, block: int = ANCHOR_BLOCK) -> DataFrame:
        """anchor, want, vec_id, score, rank: of each of wants (anchor, want, low, high) the first `count` rows whose score with the anchor (anchor, label, size, vector) lies from low to high, of its label (same) or of others; the anchor's own row is left out."""
        struct = F.collect_list(F.struct("want", "low", "high")).alias("wants")
        gathered = lambda w: anchors.join(w.groupBy("anchor").agg(struct), "anchor")
        asked = gathered(wants)
        route = lambda q, seed: stored(q.mapInArrow(_routed(self.boxes, same, seed), "anchor long, size int, tile int"), "rtree-route")
        home = route(asked.withColumn("home", F.lit(-1)), True)
        seeds = stored(_best(self._found(asked, home, same, count, block), count), "rtree-seeds")
        full = seeds.filter(F.col("rank") == count).select("anchor", "want", "score")
        narrowed = wants.join(full, ["anchor", "want"], "left").select("anchor", "want", F.coalesce("score", "low").alias("low"), "high")
        asked = gathered(narrowed)
        onward = route(asked.join(home.select("anchor", F.col("tile").alias("home")), "anchor"), False)
        return _best(seeds.drop("rank").unionByName(self._found(asked, onward, same, count, block)), count)

    def _found(self, asked: DataFrame, route: DataFrame, same: bool, count: int, block: int) -> DataFrame:
        keys = ["size", "tile"]
        turns = route.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("turns"))
        points = self.rows.join(turns, keys).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        sent = route.join(turns, keys).select("anchor", *keys, F.pmod(F.xxhash64("anchor"), F.col("turns")).cast("int").alias("turn"))
        queries = sent.join(asked.select("anchor", "label", "vector", "wants"), "anchor")
        keys = [*keys, "turn"]
        return queries.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(_searched(same, count), _FOUND)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (30, 90), scale: float = SCALE, tile: int = TILE) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label (whole numbers); anchors: a condition on vec_id. A component x becomes
    floor(scale * x) and a score is an inner product of such, exact; beyond 64 bits it is the nearest that fits. An
    anchor's positives are its first `positives` other rows of its label, by score, ties to the smaller vec_id; for each,
    the first `negatives` rows of other labels whose score is from window[0] to window[1] per cent of the positive's.
    Each row counts by itself, repeated ones too, as anchor and as candidate. Rows with a null vec_id, label or vector, an
    empty vector or a component that is null or not finite (or isn't when scaled) take no part; vectors of different
    lengths have no score. Other columns are ignored; an empty table gives no rows.
    """
    has_columns(vectors, ["vec_id", "embedding", "label"])
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("scaled") > 0) & F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("scaled", lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("scaled")).filter(fine)
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("scaled").alias("size"), whole.alias("vector")), "vectors")
    index = Index(rows, max(positives + 1, negatives), tile)
    asking = rows.filter(anchors).select(F.col("row").alias("anchor"), "label", "size", "vector")
    everything = asking.select("anchor", F.lit(0).cast("long").alias("want"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"))
    near = stored(index.search(asking, everything, True, positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    part = lambda p, to: to(F.col("positive_score").cast("decimal(20,0)") * p / 100).cast("long")
    wants = near.select("anchor", F.col("positive_score").alias("want"), part(window[0], F.ceil).alias("low"), part(window[1], F.floor).alias("high")).filter("low <= high").distinct()
    far = index.search(asking, wants, False, negatives)
    found = near.join(far.select("anchor", F.col("want").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["anchor", "positive_score"])
    return found.join(rows.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
