"""How much of a claim lies in the span of its evidence, and the diagnostics around it.

The only Python here is the singular value decomposition: rows are decomposed in stacks of equal shape, a batch at a
time. Similarity, concentration, margins and everything built on them are expressions. With at most two evidence
vectors, energy and spectrum have closed forms in three dot products, and `closed_form` needs no Python at all.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.vectors import centroid, clip01, dot, let, unit, unit_row
from attestor.operators.frames import pieces
from attestor.operators.ranks import quantiles_of

RANK, TOP_K = 8, 12
RANK_EPS, EPS = 1e-6, 1e-12
PROBES = (6, 8, 10)

SPECTRAL = ["explained", "identity_error", "energy", "sigma1_ratio", "sigma2_ratio", "spectral_sum", "participation_ratio", "effective_rank", "entropy_rank", "alignment"]
_SCHEMA = "explained double, identity_error double, energy double, sigma1_ratio double, sigma2_ratio double, spectral_sum double, participation_ratio double, effective_rank int, entropy_rank double, alignment double"


def _stack(claims: np.ndarray, evidence: np.ndarray, rank: int) -> dict[str, np.ndarray]:
    """Diagnostics of claims (b, d) with evidence (b, n, d), all rows of unit length. Directions with singular values up to 1e-6 are left out: they are none of the evidence's."""
    _, s, vt = np.linalg.svd(evidence, full_matrices=False)
    along = np.einsum("bjd,bd->bj", vt, claims)
    real = s > RANK_EPS
    explained = np.where(real[:, :rank], along[:, :rank] ** 2, 0).sum(axis=1)
    energy = np.clip(1 - explained, 0, 1)
    total = s.sum(axis=1)
    some = total > EPS
    safe = np.where(some, total, 1)
    p = s / safe[:, None]
    logs = np.where(p > EPS, p * np.log(np.where(p > EPS, p, 1)), 0)
    return {
        "explained": explained,
        "identity_error": np.abs(1 - (explained + energy)),
        "energy": energy,
        "sigma1_ratio": np.where(some, p[:, 0], 0),
        "sigma2_ratio": np.where(some, p[:, 1], 0) if s.shape[1] > 1 else np.zeros(len(s)),
        "spectral_sum": total,
        "participation_ratio": np.where(some, total**2 / ((s**2).sum(axis=1) + EPS), 0),
        "effective_rank": real.sum(axis=1).astype(np.int32),
        "entropy_rank": np.where(some, np.exp(-logs.sum(axis=1)), 0),
        "alignment": np.where(real[:, 0], np.abs(along[:, 0]), 0),
    }


#: Without evidence nothing is explained, and there is no spectrum.
_EMPTY = {"explained": 0.0, "identity_error": 0.0, "energy": 1.0}


def _units(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(length < EPS, 1.0, length)


def _grouped(claims, evidence, compute):
    """Rows by shape; compute gets stacks and returns a column dict. Missing rows stay None."""
    by = defaultdict(list)
    for i, (c, e) in enumerate(zip(claims, evidence, strict=True)):
        if c is None:
            continue
        shape = (len(e), len(c)) if e else (0, len(c))
        if e and any(x is None or len(x) != len(c) for x in e):
            raise ValueError("claim and evidence vectors differ in length")
        by[shape].append(i)
    for (n, _), rows in by.items():
        c = np.array([claims[i] for i in rows], dtype=np.float64)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), EPS)
        yield rows, n, compute(c, _units(np.array([evidence[i] for i in rows], dtype=np.float64))) if n else None


def _doubles(df: DataFrame, claim: str, evidence: str) -> tuple[DataFrame, list[str]]:
    """df with both columns as doubles and the names of these: columns that are doubles already aren't sent to Python twice."""
    names = []
    for column, kind, other in ((claim, "array<double>", "claim__"), (evidence, "array<array<double>>", "evidence__")):
        there = column in df.columns and df.schema[column].dataType.simpleString() == kind
        names.append(column if there else other)
        df = df if there else df.withColumn(other, F.col(column).cast(kind))
    return df, names


def _decomposed(rank: int, claim: str, vectors: str):
    def run(batches):
        for b in pieces(batches):
            claims, evidence = b.column(claim).to_pylist(), b.column(vectors).to_pylist()
            out = {k: [None] * b.num_rows for k in SPECTRAL}
            for rows, n, got in _grouped(claims, evidence, lambda c, e: _stack(c, e, rank)):
                for j, i in enumerate(rows):
                    for k in SPECTRAL:
                        out[k][i] = _EMPTY.get(k) if not n else got[k][j].item()
            kept = [c for c in b.schema.names if c not in ("claim__", "evidence__")]
            yield pa.record_batch([*(b.column(c) for c in kept), *(pa.array(out[k], pa.int32() if k == "effective_rank" else pa.float64()) for k in SPECTRAL)], names=[*kept, *SPECTRAL])

    return run


def spectral(df: DataFrame, claim: str = "claim_vec", evidence: str = "evidence_vecs", rank: int = RANK) -> DataFrame:
    """df with the columns of SPECTRAL. Empty or null evidence: energy 1, explained 0, the others null. A null claim: all null."""
    rows, names = _doubles(df, claim, evidence)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(_decomposed(rank, *names), f"{schema}, {_SCHEMA}")


def similarities(claim: str = "claim_vec", evidence: str = "evidence_vecs") -> Column:
    """array<double>: of the unit claim with each unit evidence row, in order."""
    rows = F.col(evidence).cast("array<array<double>>")
    return let(unit(F.col(claim).cast("array<double>")), lambda c: F.transform(rows, lambda e: dot(unit_row(e), c)))


def similarity_stats(df: DataFrame, claim: str = "claim_vec", evidence: str = "evidence_vecs", top_k: int = TOP_K) -> DataFrame:
    """df with sim_top1, sim_top2 (0 if there is none), sim_margin and sensitivity, the share of the greatest among the top_k similarities cut off at 0 (1 if they are all 0)."""
    sims = F.sort_array(similarities(claim, evidence), asc=False)
    at = lambda i: F.coalesce(F.get("sims__", F.lit(i)), F.lit(0.0))
    top = F.transform(F.slice("sims__", 1, top_k), lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(top, F.lit(0.0), lambda a, x: a + x)
    some = F.size("sims__") > 0
    return (
        df.withColumn("sims__", sims)
        .withColumn("sim_top1", F.when(some, at(0)))
        .withColumn("sim_top2", F.when(some, at(1)))
        .withColumn("sim_margin", F.col("sim_top1") - F.col("sim_top2"))
        .withColumn("sensitivity", F.when(some, F.when(total < EPS, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("sim_top1")) / total)))
        .withColumn("evidence_count", F.coalesce(F.when(F.size("sims__") >= 0, F.size("sims__")), F.lit(0)))
        .drop("sims__")
    )


def top_evidence(claim: str = "claim_vec", evidence: str = "evidence_vecs", top_k: int = TOP_K) -> Column:
    """The top_k evidence vectors by similarity, for those who want only these decomposed."""
    pairs = F.zip_with(similarities(claim, evidence), F.sequence(F.lit(0), F.size(evidence) - 1), lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.when(F.size(evidence) > 0, F.transform(F.slice(F.array_sort(pairs), 1, top_k), lambda p: F.get(F.col(evidence), p["i"]))).otherwise(F.col(evidence))


def geometry(df: DataFrame, claim: str = "claim_vec", evidence: str = "evidence_vecs", rank: int = RANK, top_k: int = TOP_K, select_top_k: bool = False) -> DataFrame:
    """df with all diagnostics and is_stable. The decomposition takes all evidence, or only the top_k by similarity with select_top_k."""
    rows = similarity_stats(df, claim, evidence, top_k)
    if select_top_k:
        rows = rows.withColumn(evidence, top_evidence(claim, evidence, top_k))
    return spectral(rows, claim, evidence, rank).withColumn("is_stable", F.col("identity_error") < 1e-4)


def closed_form(df: DataFrame, claim: str = "claim_vec", first: str = "e1", second: str = "e2") -> DataFrame:
    """The diagnostics of claims with two evidence vectors each (columns), from the three dot products; df's vectors have unit length and the two differ."""
    c, x, y = (F.col(k).cast("array<double>") for k in (claim, first, second))
    rows = df.withColumn("a__", dot(c, x)).withColumn("b__", dot(c, y)).withColumn("g__", dot(x, y))
    a, b, g = F.col("a__"), F.col("b__"), F.col("g__")
    s1, s2 = F.sqrt(1 + F.abs(g)), F.sqrt(F.greatest(1 - F.abs(g), F.lit(0.0)))
    total = s1 + s2
    explained = (a * a + b * b - 2 * a * b * g) / (1 - g * g)
    entropy = -(s1 / total * F.ln(s1 / total) + s2 / total * F.ln(s2 / total))
    top1, top2 = F.greatest(a, b), F.least(a, b)
    positive = F.greatest(a, F.lit(0.0)) + F.greatest(b, F.lit(0.0))
    return (
        rows.withColumn("explained", explained)
        .withColumn("energy", clip01(1 - F.col("explained")))
        .withColumn("identity_error", F.abs(1 - (F.col("explained") + F.col("energy"))))
        .withColumn("sigma1_ratio", s1 / total)
        .withColumn("sigma2_ratio", s2 / total)
        .withColumn("spectral_sum", total)
        .withColumn("participation_ratio", total * total / 2)
        .withColumn("effective_rank", F.lit(2))
        .withColumn("entropy_rank", F.exp(entropy))
        .withColumn("alignment", F.abs(a + F.signum(g) * b) / F.sqrt(2 * (1 + F.abs(g))))
        .withColumn("sim_top1", top1)
        .withColumn("sim_top2", top2)
        .withColumn("sim_margin", top1 - top2)
        .withColumn("sensitivity", F.when(positive < EPS, 1.0).otherwise(F.greatest(top1, F.lit(0.0)) / positive))
        .withColumn("evidence_count", F.lit(2))
        .withColumn("is_stable", F.col("identity_error") < 1e-4)
        .drop("a__", "b__", "g__")
    )


def _probes(ranks: tuple[int, ...], claim: str, vectors: str):
    def run(batches):
        for b in pieces(batches):
            claims, evidence = b.column(claim).to_pylist(), b.column(vectors).to_pylist()
            probes, leave = [None] * b.num_rows, [None] * b.num_rows
            for rows, n, got in _grouped(claims, evidence, lambda c, e: _robust(c, e, ranks)):
                for j, i in enumerate(rows):
                    probes[i] = got[0][j].tolist() if n else [1.0] * len(ranks)
                    leave[i] = got[1][j].item() if n else 1.0
            kept = [c for c in b.schema.names if c not in ("claim__", "evidence__")]
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(probes, pa.list_(pa.float64())), pa.array(leave, pa.float64())], names=[*kept, "probe_energies", "leave_one_out"])

    return run


def _robust(claims: np.ndarray, evidence: np.ndarray, ranks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Energies (b, ranks) and the greatest rises when one evidence vector goes (b), of claims (b, d) with evidence (b, n, d), from one decomposition a claim."""
    u, s, vt = np.linalg.svd(evidence, full_matrices=False)
    real = s > RANK_EPS
    along = np.where(real, np.einsum("bjd,bd->bj", vt, claims), 0)
    explained = lambda rank: (along[:, :rank] ** 2).sum(axis=1)
    energies = np.stack([np.clip(1 - explained(r), 0, 1) for r in ranks], axis=1)
    n, rank = evidence.shape[1], max(ranks)
    if n <= 1:
        return energies, np.ones(len(claims))
    # While no direction is cut off by rank, a vector takes one with it only if its leverage is 1, that is if the others
    # don't span it: the one orthogonal to all others, which the pseudo-inverse gives.
    over = np.where(real, 1 / np.where(real, s, 1), 0)
    leverage = (np.where(real[:, None], u, 0) ** 2).sum(axis=2)
    length = ((u * over[:, None]) ** 2).sum(axis=2)
    lost = np.einsum("bnk,bk->bn", u * over[:, None], along) ** 2 / np.where(length > 0, length, 1)
    left = explained(rank)[:, None] - np.where(leverage > 1 - RANK_EPS**2, lost, 0)
    for i in np.flatnonzero(real.sum(axis=1) > rank):
        left[i] = _downdated(u[i], s[i], along[i], rank)
    base = np.clip(1 - explained(rank), 0, 1)
    return energies, np.maximum((np.clip(1 - left, 0, 1) - base[:, None]).max(axis=1), 0)


def _downdated(u: np.ndarray, s: np.ndarray, along: np.ndarray, rank: int) -> np.ndarray:
    """What the first `rank` directions explain once each of the vectors u * s has gone: rank-one downdates of diag(s**2), many at a time."""
    k, out = len(s), []
    step = max(1, (1 << 22) // k**2)
    for i in range(0, len(u), step):
        z = u[i : i + step] * s
        values, vectors = np.linalg.eigh(np.diag(s**2) - z[:, :, None] * z[:, None, :])
        kept = values[:, -rank:] > RANK_EPS**2
        out.append(np.where(kept, np.einsum("nkr,k->nr", vectors[:, :, -rank:], along) ** 2, 0).sum(axis=1))
    return np.concatenate(out)


def robustness(df: DataFrame, claim: str = "claim_vec", evidence: str = "evidence_vecs", ranks: tuple[int, ...] = PROBES) -> DataFrame:
    """df with probe_energies (by rank cap), probe_variance and leave_one_out, the greatest rise of energy when one evidence vector goes (1 with fewer than two)."""
    rows, names = _doubles(df, claim, evidence)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    done = rows.mapInArrow(_probes(ranks, *names), f"{schema}, probe_energies array<double>, leave_one_out double")
    n = F.size("probe_energies")
    mean = F.aggregate("probe_energies", F.lit(0.0), lambda a, x: a + x) / n
    return done.withColumn("probe_variance", F.when(n > 0, F.aggregate(F.transform("probe_energies", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n))


def oracle_gap(df: DataFrame, claim: str = "claim_vec", evidence: str = "evidence_vecs", rank: int = RANK) -> DataFrame:
    """df with energy, oracle_energy (of the first evidence vector as claim) and energy_gap, their difference."""
    first = spectral(df.withColumn("oracle__", F.get(F.col(evidence), F.lit(0))), "oracle__", evidence, rank)
    first = first.withColumn("oracle_energy", F.col("energy")).drop("oracle__", *SPECTRAL)
    return spectral(first, claim, evidence, rank).withColumn("energy_gap", F.col("energy") - F.col("oracle_energy")).drop(*(c for c in SPECTRAL if c != "energy"))


def centroid_cosine(claim: str = "claim_vec", evidence: str = "evidence_vecs") -> Column:
    return dot(unit(F.col(claim).cast("array<double>")), centroid(F.col(evidence).cast("array<array<double>>")))


#: Axes by name; callers may add their own.
AXES = {"energy": lambda: F.col("energy"), "explained": lambda: F.col("explained"), "participation_ratio": lambda: F.col("participation_ratio"), "sensitivity": lambda: F.col("sensitivity"), "alignment": lambda: F.col("alignment"), "sim_margin": lambda: F.col("sim_margin")}


def axes(df: DataFrame, names: list[str] | None = None, **more: Column) -> DataFrame:
    """df with a struct `axes` of the named axes and of those given as columns; a missing value reads 0.0."""
    found = {n: AXES[n]() for n in (names or list(AXES))} | more
    return df.withColumn("axes", F.struct(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in found.items())))


def difficulty(margin_p90: float, rank_ratio_p90: float, pr_p90: float, weights: tuple[float, float, float, float] = (0.5, 0.25, 0.15, 0.10)) -> Column:
    """From sim_margin, effective_rank, evidence_count, sensitivity and participation_ratio. The weights (margin, rank, sensitivity, spread) have to add up to 1."""
    if abs(sum(weights) - 1) > 1e-8:
        raise ValueError(f"the weights add up to {sum(weights)}, not 1")
    scaled = lambda x, top: F.least(F.lit(1.0), x / max(top, 1e-8))
    ratio = F.col("effective_rank") / F.greatest(F.lit(1), F.col("evidence_count"))
    parts = (1 - scaled(F.col("sim_margin"), margin_p90), scaled(ratio, rank_ratio_p90), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("sensitivity"))), scaled(F.col("participation_ratio"), pr_p90))
    return clip01(sum((w * x for w, x in zip(weights, parts, strict=True)), F.lit(0.0)))


def difficulty_calibration(positives: DataFrame) -> DataFrame:
    """One row: margin_p90, rank_ratio_p90, pr_p90 of the positives, with floors 0.05, 0.1 and 1."""
    ratio = F.col("effective_rank") / F.greatest(F.lit(1), F.col("evidence_count"))
    wanted = {"margin_p90": (F.col("sim_margin"), 0.05), "rank_ratio_p90": (ratio, 0.1), "pr_p90": (F.col("participation_ratio"), 1.0)}
    marks = quantiles_of(positives, {n: (c, 0.9) for n, (c, _) in wanted.items()})
    return marks.select(*(F.greatest(F.lit(floor), n).alias(n) for n, (_, floor) in wanted.items()))
