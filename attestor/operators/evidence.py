"""Claims and evidence as rows, for evidence of any length: block products with top-k merges, one decomposition a key.

Vectors of a key are gathered in blocks by their position, so no row holds more than a block. Products are those of pairs
of blocks, of which each query keeps its k greatest, and the blocks' are merged. The evidence of a key is decomposed
through the triangular factor of its unit vectors: a block gives a factor of at most d rows, factors are stacked and
factored again in a tree, and the last has the singular values and right singular vectors of all vectors together, to the
precision of a decomposition of the whole, as nothing is squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.operators.frames import pieces, settled
from attestor.operators.geometry import _EMPTY, _SCHEMA, EPS, RANK, SPECTRAL, TOP_K, _stack, _units

BLOCK = 512
#: Components of the factors that are merged at once, and how many factors at most.
MERGED, FAN = 1 << 21, 64
#: Products within this of a limit count as the limit: sums differ in their last digits by their order.
_SLACK = 1e-12
#: Energies are given to so many places: those of hashed vectors are often plain fractions, and a half, or a limit, would else be missed by a last digit.
DIGITS = 14


def blocked(rows: DataFrame, key: str, at: str, vector: str, block: int = BLOCK) -> DataFrame:
    """key, block, ats, vectors: rows with a vector in blocks of positions (from 0, different within a key)."""
    rows = rows.filter(F.col(vector).isNotNull()).select(key, F.col(at).cast("long").alias("at"), F.col(vector).cast("array<double>").alias("vector"))
    held = rows.groupBy(key, F.floor(F.col("at") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "vector"))).alias("held"))
    return held.select(key, "block", F.transform("held", lambda x: x["at"]).alias("ats"), F.transform("held", lambda x: x["vector"]).alias("vectors"))


def _matrices(column: pa.Array) -> Iterator[np.ndarray]:
    """The matrix of each row of an array<array<double>>."""
    flat = column.flatten()
    ends = np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    widths = pa.compute.list_value_length(flat).to_numpy(zero_copy_only=False)
    values, starts = flat.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
    start = 0
    for end in ends:
        width = widths[start] if end > start else 0
        if (widths[start:end] != width).any():
            raise ValueError("vectors of one key differ in length")
        yield values[starts[start] : starts[end]].reshape(end - start, int(width))
        start = end


def _tops(k: int, over: float | None):
    """Rows of a block of queries (ats, vectors) and one of items (item_ats, item_vectors): a row a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("neg", pa.float64()), ("at", pa.int64())]))
        for b in pieces(batches):
            keys, ats, tops, counts, above = [], [], [], [], []
            for i, (q, x) in enumerate(zip(_matrices(b.column("vectors")), _matrices(b.column("item_vectors")), strict=True)):
                if q.shape[1] != x.shape[1]:
                    raise ValueError("claim and evidence vectors differ in length")
                sims = q @ x.T
                names = np.array(b.column("item_ats")[i].values)
                take = min(k, len(names))
                keys += [i] * len(q)
                ats += b.column("ats")[i].as_py()
                for row in sims:
                    near = np.flatnonzero(row >= np.partition(row, len(row) - take)[len(row) - take] - _SLACK)
                    best = near[np.lexsort((names[near], -np.round(row[near], 12)))[:take]]
                    tops.append([{"neg": -row[j], "at": names[j]} for j in best])
                counts += [len(names)] * len(q)
                above += (sims > over + _SLACK).sum(axis=1).tolist() if over is not None else [0] * len(q)
            yield pa.record_batch([b.column(0).take(pa.array(keys, pa.int64())), pa.array(ats, pa.int64()), pa.array(tops, kind), pa.array(counts, pa.int64()), pa.array(above, pa.int64())], names=[b.schema.names[0], "query_at", "tops", "n", "above"])

    return run


def top_products(queries: DataFrame, items: DataFrame, key: str, k: int, over: float | None = None) -> DataFrame:
    """key, query_at, tops (structs of sim and at: the k greatest products with the key's items, ties, to twelve places, to the smaller at), n (items) and above (those whose product is over `over`). queries, items: as blocked() gives them; queries without items have no row."""
    sizes = items.groupBy(key).agg(F.max("block").alias("last"))
    left = queries.drop("block").join(sizes, key).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    pairs = left.join(items.select(key, "block", F.col("ats").alias("item_ats"), F.col("vectors").alias("item_vectors")), [key, "block"])
    fields = T.StructType([items.schema[key], *T.StructType.fromDDL("query_at long, tops array<struct<neg: double, at: long>>, n long, above long")])
    found = pairs.select(key, "ats", "vectors", "item_ats", "item_vectors").mapInArrow(_tops(k, over), fields)
    ranked = F.slice(F.array_sort(F.transform(F.flatten(F.collect_list("tops")), lambda x: F.struct(F.round(x["neg"], 12).alias("r"), x["at"].alias("at"), x["neg"].alias("neg")))), 1, k)
    merged = found.groupBy(key, "query_at").agg(ranked.alias("tops"), F.sum("n").alias("n"), F.sum("above").alias("above"))
    return merged.withColumn("tops", F.transform("tops", lambda x: F.struct((-x["neg"]).alias("sim"), x["at"].alias("at"))))


def _factor(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r") if x.shape[0] > x.shape[1] else x


def _factored(merge: bool):
    """Blocks of vectors, or lists of factors, to one factor each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            matrices = _matrices(b.column("vectors"))
            out = [_factor(m if merge else _units(m)).tolist() for m in matrices]
            yield pa.record_batch([*(b.column(c) for c in b.schema.names if c != "vectors"), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=[*(c for c in b.schema.names if c != "vectors"), "vectors"])

    return run


def factors(items: DataFrame, key: str) -> DataFrame:
    """key, vectors (the factor of the key's unit vectors, at most d rows) and n. items: as blocked() gives them."""
    rows = items.select(key, "block", F.size("ats").cast("long").alias("n"), "vectors")
    fields = T.StructType([rows.schema[c] for c in (key, "block", "n", "vectors")])
    found = settled(rows.mapInArrow(_factored(False), fields))
    most = found.agg(F.max("block").alias("last"), F.max(F.size(F.get("vectors", F.lit(0)))).alias("d")).first()
    fan = max(2, min(FAN, MERGED // max(1, (most["d"] or 1) ** 2)))
    last = most["last"] or 0
    while last > 0:
        grouped = found.groupBy(key, F.floor(F.col("block") / fan).alias("block")).agg(F.sum("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "vectors"))), lambda x: x["vectors"])).alias("vectors"))
        found, last = settled(grouped.mapInArrow(_factored(True), fields)), last // fan
    return found.select(key, "vectors", "n")


def _explained(rank: int):
    """Rows of queries (ats, vectors) and a key's factor: energy a query; the factor is decomposed once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keys, ats, energy = [], [], []
            for i, (q, f) in enumerate(zip(_matrices(b.column("vectors")), _matrices(b.column("factor")), strict=True)):
                length = np.maximum(np.linalg.norm(q, axis=1, keepdims=True), EPS)
                _, s, vt = np.linalg.svd(f, full_matrices=False)
                within = ((q / length) @ vt[:rank][s[:rank] > 1e-6].T) ** 2
                keys += [i] * len(q)
                ats += b.column("ats")[i].as_py()
                energy += np.clip(np.round(1 - within.sum(axis=1), DIGITS), 0, 1).tolist()
            yield pa.record_batch([b.column(0).take(pa.array(keys, pa.int64())), pa.array(ats, pa.int64()), pa.array(energy, pa.float64())], names=[b.schema.names[0], "query_at", "energy"])

    return run


def energies(queries: DataFrame, items: DataFrame, key: str, rank: int = RANK) -> DataFrame:
    """key, query_at, energy of each query against the first `rank` directions of its key's items. queries, items: as blocked() gives them; a key's items are decomposed once for a block of queries."""
    rows = queries.select(key, "ats", "vectors").join(factors(items, key).select(key, F.col("vectors").alias("factor")), key)
    return rows.mapInArrow(_explained(rank), T.StructType([rows.schema[key], *T.StructType.fromDDL("query_at long, energy double")]))


def _diagnosed(rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            claims, found = b.column("claim__").to_pylist(), {k: [] for k in SPECTRAL}
            vectors = b.column("vectors").fill_null([]) if b.column("vectors").null_count else b.column("vectors")
            for c, f in zip(claims, _matrices(vectors), strict=True):
                if c is None:
                    got = {}
                elif not len(f):
                    got = _EMPTY
                elif len(c) != f.shape[1]:
                    raise ValueError("claim and evidence vectors differ in length")
                else:
                    unit = np.asarray(c) / max(np.linalg.norm(c), EPS)
                    got = {k: v[0].item() for k, v in _stack(unit[None], f[None], rank).items()}
                for k in SPECTRAL:
                    found[k].append(got.get(k))
            kept = [c for c in b.schema.names if c not in ("claim__", "vectors")]
            yield pa.record_batch([*(b.column(c) for c in kept), *(pa.array(found[k], pa.int32() if k == "effective_rank" else pa.float64()) for k in SPECTRAL)], names=[*kept, *SPECTRAL])

    return run


def geometry_rows(claims: DataFrame, evidence: DataFrame, key: str, claim: str = "claim_vec", at: str = "at", vector: str = "vector", rank: int = RANK, top_k: int = TOP_K, block: int = BLOCK) -> DataFrame:
    """claims (one row a key) with the diagnostics of geometry.geometry, from evidence as rows (key, at, vector).

    Equal to geometry() over the same vectors in one array; no row or task holds a key's evidence. Rows without a vector
    are none; a claim without evidence has energy 1 and no spectrum, a null claim no diagnostics.
    """
    items = settled(blocked(evidence, key, at, vector, block))
    rows = claims.withColumn("claim__", F.col(claim).cast("array<double>"))
    unit = rows.withColumn("claim__", F.when(F.size("claim__") > 0, F.col("claim__"))).withColumn("place__", F.lit(0))
    tops = top_products(_unit_blocks(blocked(unit, key, "place__", "claim__", block)), _unit_blocks(items), key, max(top_k, 2))
    sims = tops.select(key, F.transform("tops", lambda x: x["sim"]).alias("sims__"), F.col("n").alias("n__"))
    at_ = lambda i: F.coalesce(F.get("sims__", F.lit(i)), F.lit(0.0))
    some = F.size("sims__") > 0
    total = F.aggregate(F.transform(F.slice("sims__", 1, top_k), lambda x: F.greatest(x, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    out = rows.join(factors(items, key).drop("n"), key, "left").join(sims, key, "left")
    out = out.withColumn("sim_top1", F.when(some, at_(0))).withColumn("sim_top2", F.when(some, at_(1))).withColumn("sim_margin", F.col("sim_top1") - F.col("sim_top2"))
    out = out.withColumn("sensitivity", F.when(some, F.when(total < EPS, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("sim_top1")) / total)))
    out = out.withColumn("evidence_count", F.coalesce("n__", F.lit(0)).cast("int")).drop("sims__", "n__")
    kept = [f for f in out.schema if f.name not in ("claim__", "vectors")]
    out = out.select(*(f"`{f.name}`" for f in kept), "claim__", "vectors").mapInArrow(_diagnosed(rank), T.StructType([*kept, *T.StructType.fromDDL(_SCHEMA)]))
    return out.withColumn("is_stable", F.col("identity_error") < 1e-4)


def _unit_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with their vectors at unit length, those shorter than 1e-12 as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [_units(m).tolist() for m in _matrices(b.column("vectors"))]
            yield pa.record_batch([pa.array(out, pa.list_(pa.list_(pa.float64()))) if c == "vectors" else b.column(c) for c in b.schema.names], names=b.schema.names)

    return blocks.mapInArrow(run, blocks.schema)
