"""Rates, ranks, curves and slices of scored rows. Everything is an aggregate or a window over already aggregated rows."""

from __future__ import annotations

import functools
import hashlib
import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions.policies import ACCEPT, REJECT, REVIEW
from attestor.operators.frames import settled
from attestor.operators.negatives import portable_hash
from attestor.operators.ranks import met, quantiles, quantiles_of, running

#: Edges of equal bins as they are in binary fractions of ten.
TENTHS = [i * 0.1 for i in range(10)] + [1.0]


def share(condition: Column) -> Column:
    """Mean of a condition as 0 and 1; null counts as 0."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def share_where(condition: Column, where: Column) -> Column:
    """As share, among the rows where `where` holds; null if there are none."""
    return F.avg(F.when(where, F.when(condition, 1.0).otherwise(0.0)))


def _by_score(df: DataFrame, score: Column, positive: Column, by: list[str]) -> DataFrame:
    rows = df.select(*by, score.cast("double").alias("s__"), positive.cast("boolean").alias("y__")).filter("s__ is not null and y__ is not null")
    return rows.groupBy(*by, "s__").agg(F.sum(F.when(F.col("y__"), 1).otherwise(0)).alias("p__"), F.sum(F.when(F.col("y__"), 0).otherwise(1)).alias("n__"))


def auc(df: DataFrame, score: Column, positive: Column, by: list[str] | None = None) -> DataFrame:
    """by, auc, positives, negatives. Ties count half; null where a class is missing."""
    by = by or []
    rows = running(_by_score(df, score, positive, by), by, "s__", {"n__": "before__"})
    p, n = F.sum("p__"), F.sum("n__")
    wins = F.sum(F.col("p__") * (F.col("before__") + F.col("n__") / 2.0))
    return rows.groupBy(*by).agg(F.when((p > 0) & (n > 0), wins / (p.cast("double") * n.cast("double"))).alias("auc"), p.alias("positives"), n.alias("negatives"))


def auc_by_axis(df: DataFrame, axes: dict[str, Column], positive: Column, least: int = 0) -> DataFrame:
    """axis, auc, positives, negatives, reason: too_few_samples under `least` rows, single_class, else null."""
    stacked = df.select(positive.alias("y"), F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), v.cast("double").alias("x")) for k, v in axes.items()))).alias("a")).select("y", "a.axis", "a.x")
    out = auc(stacked, F.col("x"), F.col("y"), ["axis"])
    n = F.col("positives") + F.col("negatives")
    reason = F.when(n < least, "too_few_samples").when((F.col("positives") == 0) | (F.col("negatives") == 0), "single_class_in_gap")
    return out.withColumn("reason", reason).withColumn("auc", F.when(reason.isNull(), F.col("auc")))


def accept_rates(df: DataFrame, tau: float | Column, energy: str = "energy", split: str = "split") -> DataFrame:
    """One row: tpr and far at tau."""
    ok = F.col(energy) <= tau
    return df.agg(share_where(ok, F.col(split) == "pos").alias("tpr"), share_where(ok, F.col(split) == "neg").alias("far"))


def distribution(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """by, n, mean, std, min, max, p10, p50, p90; without by and without rows, no row."""
    by = by or []
    rows = settled(df.select(*by, column))
    out = rows.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")).filter("n > 0")
    marks = quantiles(rows, F.col(column), [0.1, 0.5, 0.9], by)
    return met(out, marks, by).withColumnsRenamed({"q0": "p10", "q1": "p50", "q2": "p90"})


def verdict_counts(df: DataFrame, by: list[str] | None = None, verdict: str = "verdict") -> DataFrame:
    """by, verdict, n, fraction."""
    counts = df.groupBy(*(by or []), verdict).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))  # a row a verdict
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(whole))


def geometry_means(df: DataFrame, axes: tuple[str, ...] = ("participation_ratio", "sensitivity", "alignment", "sim_margin", "effective_rank")) -> DataFrame:
    return df.agg(*(F.avg(a).alias(a) for a in axes))


def summary(df: DataFrame) -> DataFrame:
    """One row on scored rows: n, verdict counts, energy's mean, std, median and p90, stable and unstable."""
    count = lambda c: F.count(F.when(c, 1))
    v = F.col("verdict")
    rows = settled(df.select("verdict", "energy", "is_stable"))
    out = rows.agg(F.count("*").alias("n"), *(count(v == x).alias(x) for x in (ACCEPT, REVIEW, REJECT)), F.avg("energy").alias("energy_mean"), F.stddev_pop("energy").alias("energy_std"), count(F.col("is_stable")).alias("stable"), count(~F.col("is_stable")).alias("unstable"))
    marks = quantiles(rows, F.col("energy"), [0.5, 0.9]).toDF("energy_p50", "energy_p90")
    return out.crossJoin(marks).select("n", ACCEPT, REVIEW, REJECT, "energy_mean", "energy_std", "energy_p50", "energy_p90", "stable", "unstable")


def energy_metrics(df: DataFrame) -> DataFrame:
    """One row: means, medians and stds by split, and their gap."""
    rows = settled(df.select("split", "energy"))
    pos, neg = (F.when(F.col("split") == s, F.col("energy")) for s in ("pos", "neg"))
    out = rows.agg(F.avg(pos).alias("mean_pos"), F.avg(neg).alias("mean_neg"), (F.avg(neg) - F.avg(pos)).alias("gap"), F.stddev_pop(pos).alias("std_pos"), F.stddev_pop(neg).alias("std_neg"))
    medians = quantiles_of(rows, {"median_pos": (pos, 0.5), "median_neg": (neg, 0.5)})
    return out.crossJoin(medians).select("mean_pos", "mean_neg", "median_pos", "median_neg", "gap", "std_pos", "std_neg")


def pathologies(df: DataFrame, high_energy: float = 0.7, low_energy: float = 0.3, low_difficulty: float = 0.3, high_difficulty: float = 0.7) -> DataFrame:
    """One row of counts: high energy with low difficulty, low with high, and reviews within the margin band."""
    count = lambda c: F.count(F.when(c, 1))
    e, d = F.col("energy"), F.col("difficulty")
    return df.agg(count((e > high_energy) & (d < low_difficulty)).alias("high_energy_low_difficulty"), count((e < low_energy) & (d > high_difficulty)).alias("low_energy_high_difficulty"), count((F.col("verdict") == REVIEW) & (F.abs(e - F.col("tau_accept")) <= F.col("margin_band"))).alias("review_in_margin"))


# --- policy sweeps: rows policy_name, split, energy, verdict, tau_accept ---


def policy_rates(sweep: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return sweep.groupBy("policy_name", "split").agg(F.count("*").alias("n"), share(v == ACCEPT).alias("accept_rate"), share(v == REVIEW).alias("review_rate"), share(v == REJECT).alias("reject_rate"), F.min("tau_accept").alias("tau"))


def policy_metrics_raw(sweep: DataFrame) -> DataFrame:
    """Shares of all of a policy's rows, whatever their split."""
    v, s = F.col("verdict"), F.col("split")
    return sweep.groupBy("policy_name").agg(share((s == "pos") & (v == ACCEPT)).alias("tpr"), share((s == "neg") & (v == ACCEPT)).alias("far"), share((s == "pos") & (v == REVIEW)).alias("pos_review"), share((s == "neg") & (v == REVIEW)).alias("neg_review"))


def energy_tau(sweep: DataFrame) -> DataFrame:
    """One row: the energy-only policy's threshold."""
    return sweep.filter(F.col("policy_name").like("%EnergyOnly%")).agg(F.min("tau_accept").alias("tau"))


def false_accepts(sweep: DataFrame) -> DataFrame:
    """Negatives that the energy-only policy's threshold lets through."""
    rows = sweep.filter((F.col("split") == "neg") & F.col("policy_name").like("%EnergyOnly%"))
    return rows.crossJoin(F.broadcast(energy_tau(sweep).withColumnRenamed("tau", "tau_energy_only"))).filter("energy <= tau_energy_only")  # one row


def leaderboard(sweep: DataFrame, limit: int | None = 50) -> DataFrame:
    """Policies with rates in both splits, lowest share of accepted negatives first."""
    v, pos, neg = F.col("verdict"), F.col("split") == "pos", F.col("split") == "neg"
    rates = sweep.groupBy("policy_name").agg(share_where(v == ACCEPT, pos).alias("pos_accept"), share_where(v == REVIEW, pos).alias("pos_review"), share_where(v == ACCEPT, neg).alias("neg_accept"), share_where(v == REVIEW, neg).alias("neg_review"))
    rates = rates.filter("pos_accept is not null and neg_accept is not null").withColumn("separation", F.col("pos_accept") - F.col("neg_accept"))
    ranked = rates.orderBy("neg_accept", F.col("pos_accept").desc(), "policy_name")
    return ranked.limit(limit) if limit else ranked


def band(df: DataFrame, tau: float | Column, width: float | Column) -> DataFrame:
    return df.filter(F.abs(F.col("energy") - tau) <= width)


BAND_WIDTHS = (0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.125, 0.15, 0.2, 0.25)


def band_width(rows: DataFrame, tau: float | Column, widths: tuple[float, ...] = BAND_WIDTHS, least: int = 200) -> DataFrame:
    """One row: the smallest width that has `least` rows of each split around tau, else the last."""
    inside = lambda w, s: F.count(F.when((F.abs(F.col("energy") - tau) <= w) & (F.col("split") == s), 1))
    steps = functools.reduce(lambda out, w: out.when((inside(w, "pos") >= least) & (inside(w, "neg") >= least), w), widths[1:], F.when((inside(widths[0], "pos") >= least) & (inside(widths[0], "neg") >= least), widths[0]))
    return rows.agg(steps.otherwise(widths[-1]).alias("width"))


def baseline_policy(sweep: DataFrame, preferred: tuple[str, ...] = ("EnergyOnly", "Energy")) -> DataFrame:
    """One row: the first policy by preference, else by name."""
    place = functools.reduce(lambda out, x: out.when(F.col("policy_name").contains(x[1]), x[0]), list(enumerate(preferred))[1:], F.when(F.col("policy_name").contains(preferred[0]), 0)).otherwise(len(preferred))
    return sweep.select("policy_name").distinct().agg(F.min_by("policy_name", F.struct(place.alias("p"), "policy_name")).alias("policy_name"))


def tau_lookup(sweep: DataFrame, runs: DataFrame | None = None, calibration: DataFrame | None = None) -> DataFrame:
    """One row: tau from the runs, else the calibration, else the median of the sweep's."""
    median = quantiles(sweep, F.col("tau_accept"), [0.5]).toDF("t0")
    out, found = median, []
    for i, (df, c) in enumerate(((runs, "tau_energy"), (calibration, "tau_energy")), 1):
        if df is not None and c in df.columns:
            out, found = out.crossJoin(df.agg(F.min(c).alias(f"t{i}"))), [*found, f"t{i}"]
    return out.select(F.coalesce(*found, "t0").alias("tau"))


def pareto_front(board: DataFrame) -> DataFrame:
    """Rows of a leaderboard that no other beats: fewer accepted negatives and no fewer positives, or the other way about.

    Sorted by accepted negatives, a row stands if it has more positives than all with fewer negatives and the most among its equals.
    """
    best = board.groupBy("neg_accept").agg(F.max("pos_accept").alias("top__"))
    before = best.withColumn("before__", F.max("top__").over(Window.orderBy("neg_accept").rowsBetween(Window.unboundedPreceding, -1)))
    return board.join(before, "neg_accept").filter("pos_accept = top__ and (before__ is null or pos_accept > before__)").drop("top__", "before__")


# --- curves: rows curve, tau, tpr, far ---


def tau_grid(points: int = 100, top: float = 1.0) -> list[float]:
    return [i * (top / (points - 1)) for i in range(points)]


def tau_sweep(df: DataFrame, grid: list[float], score: str = "energy", by: list[str] | None = None) -> DataFrame:
    """by, tau, tpr, far: shares of scores up to each tau.

    A score is counted at the first tau not below it; sums over the sorted taus give the shares, so rows are aggregated
    once and never multiplied by the grid.
    """
    by = by or []
    spark = df.sparkSession
    edges = F.array(*(F.lit(float(t)) for t in grid))
    first = F.size(F.filter(edges, lambda t: t < F.col(score)))  # how many taus are too low
    hits = df.filter(F.col(score).isNotNull()).groupBy(*by, first.alias("at__")).agg(F.count(F.when(F.col("split") == "pos", 1)).alias("p__"), F.count(F.when(F.col("split") == "neg", 1)).alias("n__"))
    taus = spark.createDataFrame([(i, float(t)) for i, t in enumerate(grid)] + [(len(grid), None)], "at__ int, tau double")
    every = (hits.select(*by).distinct().crossJoin(F.broadcast(taus)) if by else taus).join(hits, [*by, "at__"], "left").fillna(0, ["p__", "n__"])
    w, whole = Window.partitionBy(*(by or [F.lit(0)])).orderBy("at__"), Window.partitionBy(*(by or [F.lit(0)]))  # a row a tau
    rate = lambda c: F.when(F.sum(c).over(whole) > 0, F.sum(c).over(w) / F.sum(c).over(whole))
    return every.withColumn("tpr", rate("p__")).withColumn("far", rate("n__")).filter("tau is not null").select(*by, "tau", "tpr", "far")


def curve_auc(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, auc: trapezoids over the points present, in order of far, tpr, tau."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("far", "tpr", "tau")
    steps = curve.withColumn("x__", F.lag("far").over(w)).withColumn("y__", F.lag("tpr").over(w))
    return steps.groupBy(*by).agg(F.coalesce(F.sum((F.col("far") - F.col("x__")) * (F.col("tpr") + F.col("y__")) / 2), F.lit(0.0)).alias("auc"))


def tpr_at_far(curve: DataFrame, far: float, by: list[str] | None = None) -> DataFrame:
    """by, tpr of the point whose far is nearest, the lowest tau among equals."""
    return curve.groupBy(*(by or [])).agg(F.min_by("tpr", F.struct(F.abs(F.col("far") - far).alias("d"), "tau")).alias("tpr"))


def interpolated(curve: DataFrame, points: DataFrame, x: str = "far") -> DataFrame:
    """points with `at`, the curve's tpr at x by linear interpolation; of several at one far the highest counts; ends are flat."""
    line = curve.groupBy("far").agg(F.max("tpr").alias("tpr"))
    marks = line.select(F.col("far").alias("x__"), "tpr", F.lit(None).cast("long").alias("id__"))
    asked = settled(points.withColumn("id__", F.monotonically_increasing_id()))
    both = marks.unionByName(asked.select(F.col(x).alias("x__"), F.lit(None).cast("double").alias("tpr"), "id__"))
    known = F.when(F.col("tpr").isNotNull(), F.struct("x__", "tpr"))
    w = Window.orderBy("x__", F.col("tpr").isNull())  # a curve's points
    near = both.withColumn("l__", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r__", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    left, right = F.coalesce("l__", "r__"), F.coalesce("r__", "l__")
    rise = F.when(right["x__"] > left["x__"], left["tpr"] + (right["tpr"] - left["tpr"]) * (F.col("x__") - left["x__"]) / (right["x__"] - left["x__"])).otherwise(left["tpr"])
    return asked.join(near.filter("id__ is not null").select("id__", rise.alias("at")), "id__").drop("id__")


def dominates(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether curve a is nowhere below curve b."""
    return interpolated(b, a).agg(F.coalesce(F.bool_and(F.col("tpr") >= F.col("at")), F.lit(False)).alias("dominates"))


def equal_far(df: DataFrame, far: float, score: str = "energy") -> DataFrame:
    """One row: the tau at which a share `far` of negatives is accepted (just below all of them for 0), and tpr and far there."""
    rows = settled(df.select("split", score))
    tau = _tau_at(rows, [far], score).withColumnRenamed("q0", "tau_eq")
    ok = F.col(score) <= F.col("tau_eq")
    return rows.crossJoin(F.broadcast(tau)).groupBy("tau_eq").agg(share_where(ok, F.col("split") == "pos").alias("tpr"), share_where(ok, F.col("split") == "neg").alias("far"))  # one row


def _tau_at(df: DataFrame, far: list[float], score: str = "energy") -> DataFrame:
    """One row, q0, q1, ...: where each share `far` of negatives is accepted; just below all of them for 0."""
    neg = F.when(F.col("split") == "neg", F.col(score))
    marks = quantiles(df, neg, [0.0, *far])
    return marks.select(*((F.col(f"q{i}") if f > 0 else F.col("q0") - 1e-6).alias(f"q{i - 1}") for i, f in enumerate(far, 1)))


def policy_against_energy(df: DataFrame, tau: float) -> DataFrame:
    """One row: tpr and far of energy at tau and of the stored verdict, and the differences."""
    pos, neg, e, v = F.col("split") == "pos", F.col("split") == "neg", F.col("energy") <= tau, F.col("verdict") == ACCEPT
    out = df.agg(share_where(e, pos).alias("energy_tpr"), share_where(e, neg).alias("energy_far"), share_where(v, pos).alias("policy_tpr"), share_where(v, neg).alias("policy_far"))
    return out.withColumn("delta_tpr", F.col("policy_tpr") - F.col("energy_tpr")).withColumn("delta_far", F.col("policy_far") - F.col("energy_far"))


def gap_sweep(df: DataFrame, verdict_at, widths: list[float]) -> DataFrame:
    """width, tpr, far, energy_tpr, gain: for each width, the rates of verdict_at(width) and what energy alone reaches at the same far.

    All widths are columns of one pass over settled rows; the energies' quantiles at those rates are found in one dealing out.
    """
    df = settled(df)
    pos, neg = F.col("split") == "pos", F.col("split") == "neg"
    rates = df.agg(*(share_where(verdict_at(w) == ACCEPT, pos).alias(f"t{i}") for i, w in enumerate(widths)), *(share_where(verdict_at(w) == ACCEPT, neg).alias(f"f{i}") for i, w in enumerate(widths))).first()
    far = [rates[f"f{i}"] or 0.0 for i in range(len(widths))]
    taus = _tau_at(df, far).first()
    got = df.agg(*(share_where(F.col("energy") <= taus[f"q{i}"], pos).alias(f"e{i}") for i in range(len(widths)))).first()
    rows = [(float(w), rates[f"t{i}"], rates[f"f{i}"], got[f"e{i}"], None if rates[f"t{i}"] is None or got[f"e{i}"] is None else rates[f"t{i}"] - got[f"e{i}"]) for i, w in enumerate(widths)]
    return df.sparkSession.createDataFrame(rows, "width double, tpr double, far double, energy_tpr double, gain double")


def overlap_bounds(df: DataFrame, score: str = "energy") -> DataFrame:
    """One row: low and high of the range in which both splits have scores; low over high if there is none."""
    pos, neg = (F.when(F.col("split") == s, F.col(score)) for s in ("pos", "neg"))
    return df.agg(F.greatest(F.min(pos), F.min(neg)).alias("low"), F.least(F.max(pos), F.max(neg)).alias("high"))


def overlap_rows(df: DataFrame, score: str = "energy") -> DataFrame:
    return df.crossJoin(F.broadcast(overlap_bounds(df, score))).filter(F.col(score).between(F.col("low"), F.col("high"))).drop("low", "high")  # one row


def regions(df: DataFrame, score: str = "energy") -> DataFrame:
    """df with `region`: gap within the overlap of the splits' scores, else non_gap."""
    return df.crossJoin(F.broadcast(overlap_bounds(df, score))).withColumn("region", F.when(F.col(score).between(F.col("low"), F.col("high")), "gap").otherwise("non_gap")).drop("low", "high")  # one row


def guarded_corr(x: Column, y: Column, least: int = 0, flat: float = 1e-12) -> Column:
    """Pearson's; null with fewer rows or a column that doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    # corr() would divide by zero for flat columns
    varied = (F.stddev_pop(a) > flat) & (F.stddev_pop(b) > flat) & (F.count(a) >= least)
    cov = F.covar_pop(a, b)
    return F.when(varied, F.try_divide(cov, F.stddev_pop(a) * F.stddev_pop(b)))


def axis_shift(df: DataFrame, axes: tuple[str, ...] = ("participation_ratio", "sensitivity"), score: str = "energy") -> DataFrame:
    """region (global, gap, non_gap), axis, corr of the axis with acceptance; at least five rows."""
    rows = regions(df, score)
    accepted = F.when(F.col("verdict") == ACCEPT, 1.0).otherwise(0.0)
    every = rows.unionByName(rows.withColumn("region", F.lit("global")))
    wide = every.groupBy("region").agg(*(guarded_corr(F.col(a), accepted, 5).alias(a) for a in axes))
    return wide.unpivot(["region"], list(axes), "axis", "corr")


def correlations(df: DataFrame, axes: list[str], flat: float = 1e-8) -> DataFrame:
    """a, b, corr for all ordered pairs of axes that vary, over rows that have all; no rows with fewer than two such axes."""
    rows = df.select(*(F.col(a).cast("double").alias(a) for a in axes)).na.drop()
    pairs = list(combinations(axes, 2))
    got = rows.agg(*(F.when(F.stddev_pop(a) >= flat, 1).otherwise(0).alias(f"v{i}") for i, a in enumerate(axes)), *(guarded_corr(F.col(a), F.col(b), flat=flat).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    one = lambda a, b, c: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.cast("double").alias("corr"))
    v = {a: F.col(f"v{i}") == 1 for i, a in enumerate(axes)}
    cells = [F.when(v[a], one(a, a, F.lit(1.0))) for a in axes]
    cells += [F.when(v[a] & v[b], one(x, y, F.col(f"c{i}"))) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    enough = sum((F.col(f"v{i}") for i in range(len(axes))), F.lit(0)) >= 2
    return got.filter(enough).select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select("x.*")


def collapsed_axes(matrix: DataFrame, least: float = 0.85) -> DataFrame:
    """Ordered pairs of different axes whose correlation is at least `least` either way."""
    return matrix.filter((F.col("a") != F.col("b")) & (F.abs("corr") >= least))


def correlation_eigenvalues(matrix: DataFrame) -> list[float]:
    """Descending; empty for an empty matrix or one with gaps. The matrix has a row for each pair of a fixed list of axes."""
    rows = matrix.collect()
    names = sorted({r["a"] for r in rows})
    m = np.full((len(names), len(names)), np.nan)
    for r in rows:
        m[names.index(r["a"]), names.index(r["b"])] = np.nan if r["corr"] is None else r["corr"]
    return sorted(np.linalg.eigvalsh(m).tolist(), reverse=True) if len(names) and np.isfinite(m).all() else []


def _bins(x: Column, edges: list[float], closed: bool = False) -> Column:
    """Index of the half-open bin; with closed the last edge belongs to the last bin; null outside."""
    last = len(edges) - 2
    out = F.when((x >= edges[0]) & (x < edges[1]), 0)
    for i in range(1, last + 1):
        top = (x <= edges[i + 1]) if closed and i == last else (x < edges[i + 1])
        out = out.when((x >= edges[i]) & top, i)
    return out


def effectiveness_curve(df: DataFrame, difficulty: str = "difficulty", correct: Column | None = None, edges: list[float] | None = None, keep_empty: bool = True) -> DataFrame:
    """bin, low, high, n, value: mean correctness by difficulty; a review counts as correct. Empty bins have null, or are left out."""
    edges = edges or TENTHS
    v = F.col("verdict")
    right = correct if correct is not None else (v == REVIEW) | ((v == ACCEPT) & (F.col("split") == "pos")) | ((v == REJECT) & (F.col("split") == "neg"))
    counted = df.groupBy(_bins(F.col(difficulty), edges).alias("bin")).agg(F.count("*").alias("n"), share(right).alias("value"))
    bins = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    return bins.join(counted, "bin", "left" if keep_empty else "inner").withColumn("n", F.coalesce("n", F.lit(0))).select("bin", "low", "high", "n", "value")


def histogram(df: DataFrame, column: str = "energy", bins: int = 40, by: list[str] | None = None) -> DataFrame:
    """by, bin, n over [0, 1], the last bin closed; other and non-finite values are left out; empty bins have no row."""
    edges = [i / bins for i in range(bins + 1)]
    return df.groupBy(*(by or []), _bins(F.col(column), edges, closed=True).alias("bin")).agg(F.count("*").alias("n")).filter("bin is not null")


def reliability(df: DataFrame, score: Column, positive: Column, bins: int = 10) -> DataFrame:
    """bin, n, predicted, observed; empty bins have no row."""
    edges = TENTHS if bins == 10 else [i / bins for i in range(bins + 1)]
    return df.groupBy(_bins(score, edges, closed=True).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), share(positive).alias("observed")).filter("bin is not null")


def roc(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """score, tpr, far of the step curve: from the highest score down, rows at least that high are accepted."""
    rows = running(_by_score(df, -score, positive, []), [], "s__", {"p__": "pb__", "n__": "nb__"})
    totals = rows.agg(F.sum("p__").alias("P"), F.sum("n__").alias("N"))
    return rows.crossJoin(F.broadcast(totals)).select((-F.col("s__")).alias("score"), F.try_divide(F.col("pb__") + F.col("p__"), F.col("P")).alias("tpr"), F.try_divide(F.col("nb__") + F.col("n__"), F.col("N")).alias("far"))  # one row


def tpr_at(df: DataFrame, score: Column, positive: Column, far: float = 0.01) -> DataFrame:
    """One row: the step curve's tpr at far, interpolated from (0, 0)."""
    spark = df.sparkSession
    points = roc(df, score, positive).select("tpr", "far").unionByName(spark.createDataFrame([(0.0, 0.0)], "tpr double, far double"))
    below = points.filter(F.col("far") <= far).agg(F.max(F.struct("far", "tpr")).alias("l"))
    above = points.filter(F.col("far") >= far).agg(F.min(F.struct(F.col("far"), (-F.col("tpr")).alias("t"))).alias("r"))
    both = below.crossJoin(above)
    lx, ly, rx, ry = F.col("l.far"), F.col("l.tpr"), F.col("r.far"), -F.col("r.t")
    return both.select(F.when(F.col("r").isNull() | (rx == lx), ly).otherwise(ly + (ry - ly) * (far - lx) / (rx - lx)).alias("tpr"))


def precision_recall(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """score, precision, recall by falling score."""
    rows = running(_by_score(df, -score, positive, []), [], "s__", {"p__": "pb__", "n__": "nb__"})
    total = rows.agg(F.sum("p__").alias("P"))
    tp, fp = F.col("pb__") + F.col("p__"), F.col("nb__") + F.col("n__")
    return rows.crossJoin(F.broadcast(total)).select((-F.col("s__")).alias("score"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, F.col("P")).alias("recall"), F.try_divide(F.col("p__"), F.col("P")).alias("step"))  # one row


def average_precision(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    return precision_recall(df, score, positive).agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"))


def fusion(df: DataFrame, axes: list[str], positive: Column, far: float = 0.01) -> DataFrame:
    """name, auc, delta_auc, tpr, delta_tpr, corr: energy alone against energy with an axis added or taken away, best first."""
    scores = {"energy": -F.col("energy")} | {f"energy{s}{a}": -F.col("energy") + (F.col(a) if s == "+" else -F.col(a)) for a in axes for s in "+-"}
    got = auc_by_axis(df, scores, positive).select(F.col("axis").alias("name"), "auc")
    tprs = functools.reduce(DataFrame.unionByName, (tpr_at(df, c, positive, far).withColumn("name", F.lit(k)) for k, c in scores.items()))
    corr = df.agg(*(guarded_corr(F.col("energy"), F.col(a)).alias(a) for a in axes)).unpivot([], axes, "axis", "corr")
    base = got.filter("name = 'energy'").select(F.col("auc").alias("auc0")).crossJoin(tprs.filter("name = 'energy'").select(F.col("tpr").alias("tpr0")))
    out = got.join(tprs, "name").crossJoin(base).withColumn("axis", F.regexp_extract("name", r"^energy[+-](.*)$", 1)).join(corr, "axis", "left")
    return out.filter("name <> 'energy'").select("name", "auc", (F.col("auc") - F.col("auc0")).alias("delta_auc"), "tpr", (F.col("tpr") - F.col("tpr0")).alias("delta_tpr"), "corr").orderBy(F.col("delta_tpr").desc(), F.col("delta_auc").desc(), "corr", "name")


def boundary(df: DataFrame, tau: float, width: float, axes: list[str], far: float = 0.01, least: int = 20) -> DataFrame:
    """axis, auc, tpr (at far) and corr with energy of each axis within width of tau; empty unless both splits have `least` rows there."""
    rows = band(df, tau, width)
    sizes = rows.agg(F.count(F.when(F.col("split") == "pos", 1)).alias("p"), F.count(F.when(F.col("split") == "neg", 1)).alias("n"))
    positive = F.col("split") == "pos"
    got = auc_by_axis(rows, {a: F.col(a) for a in axes}, positive).select("axis", "auc")
    tprs = functools.reduce(DataFrame.unionByName, (tpr_at(rows, F.col(a), positive, far).withColumn("axis", F.lit(a)) for a in axes))
    corr = rows.agg(*(guarded_corr(F.col("energy"), F.col(a)).alias(a) for a in axes)).unpivot([], axes, "axis", "corr")
    return got.join(tprs, "axis").join(corr, "axis").crossJoin(F.broadcast(sizes)).filter(F.least("p", "n") >= least).drop("p", "n")  # one row


#: A prime, and the numbers under it that are draws of 0, 1, 2, ... from a Poisson distribution of mean 1.
PRIME = 2**31 - 1
DRAWS = [int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(i + 1))) for i in range(12)]


def draw_keys(seed: int, replicates: int) -> list[tuple[int, int]]:
    """A factor and a summand for each replicate."""
    word = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:8], 16)
    return [(1 + word(seed, b, "a") % (PRIME - 1), word(seed, b, "c") % PRIME) for b in range(replicates)]


def _resampled(factor: np.ndarray, summand: np.ndarray):
    """Of one partition, sorted by score: by replicate the positives, the negatives, and the pairs that are in order within it."""

    def run(batches):
        positives, negatives, wins = (np.zeros(len(factor), np.int64) for _ in range(3))
        pending = [np.zeros(len(factor), np.int64), np.zeros(len(factor), np.int64)]  # of the score in hand
        last = None

        def close():
            nonlocal positives, negatives, wins
            p, n = pending
            wins += p * (2 * negatives + n)  # in halves
            positives, negatives = positives + p, negatives + n
            pending[:] = [np.zeros_like(p), np.zeros_like(n)]

        for batch in batches:
            scores, keys, positive = (batch[c].to_numpy() for c in ("s__", "k__", "y__"))
            for at in range(0, len(scores), 512):
                k = keys[at : at + 512].astype(np.int64)
                weights = np.searchsorted(DRAWS, (k[:, None] * factor + summand) % PRIME, side="right")
                part, up = scores[at : at + 512], positive[at : at + 512].astype(bool)
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    if last is not None and part[low] != last:
                        close()
                    last = part[low]
                    w, y = weights[low:high], up[low:high]
                    pending[0] = pending[0] + w[y].sum(axis=0)
                    pending[1] = pending[1] + w[~y].sum(axis=0)
        if last is not None:
            close()
            yield pd.DataFrame({"first": [0], "p": [positives], "n": [negatives], "wins": [wins], "last": [float(last)]})

    return run


def bootstrap_auc(df: DataFrame, score: str, positive: Column, replicates: int = 1000, seed: int = 42, order: str = "id") -> DataFrame:
    """One row: mean, low, high (2.5 and 97.5 percentiles) and replicates with both classes.

    How often a row is in a replicate is a Poisson draw of mean 1, from a hash of `order` that other engines compute alike:
    resampling with replacement without a row having to know the others. Rows are range-partitioned by score; a partition
    sums up all replicates in one pass, and what it puts out is a number for each replicate.
    """
    rows = df.select((portable_hash(seed, F.col(order)) % PRIME).alias("k__"), F.col(score).cast("double").alias("s__"), positive.cast("boolean").alias("y__")).filter("s__ is not null and y__ is not null")
    keys = np.array(draw_keys(seed, replicates), np.int64).reshape(-1, 2)
    parts = rows.repartitionByRange("s__").sortWithinPartitions("s__").mapInPandas(_resampled(keys[:, 0], keys[:, 1]), "first int, p array<long>, n array<long>, wins array<long>, last double")
    each = settled(parts.drop("first")).select("last", F.posexplode(F.arrays_zip("p", "n", "wins")).alias("b", "x")).select("last", "b", "x.*")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("last").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    p, n = F.sum("p"), F.sum("n")
    aucs = each.withColumn("before", before).groupBy("b").agg(F.when((p > 0) & (n > 0), F.sum(F.col("wins") / 2.0 + F.col("p") * F.col("before")) / (p.cast("double") * n.cast("double"))).alias("auc")).filter("auc is not null")
    return aucs.agg(F.avg("auc").alias("mean"), F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))  # a row a replicate


def stability_facts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, effectiveness (its mean) and stable (the share of rows that are)."""
    return df.groupBy(*(by or [])).agg(F.avg("effectiveness").alias("effectiveness"), share(F.col("is_stable")).alias("stable"))


def tables_of(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """name and rows of the tables and views that the catalogue knows by a name like pattern, each counted whole; all names in one plan."""
    names = sorted(t.name for t in spark.catalog.listTables(pattern=pattern))
    counts = [spark.table(f"`{n}`").agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names]
    return functools.reduce(DataFrame.unionAll, counts) if counts else spark.createDataFrame([], "name string, rows long")


def columns_of(df: DataFrame) -> DataFrame:
    """name, at (from 0) and type of df's columns."""
    return df.sparkSession.createDataFrame([(n, i, t) for i, (n, t) in enumerate(df.dtypes)], "name string, at long, type string")


def mode_column(df: DataFrame, candidates: tuple[str, ...] = ("neg_mode", "mode", "negative_mode")) -> str | None:
    """The first of the candidates that df has."""
    return next((c for c in candidates if c in df.columns), None)


def missing_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that aren't there or are empty, by Hadoop's file systems; a folder's files count together."""
    def size(path: str) -> int:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    return [p for p in paths if size(p) == 0]


def artifact_issues(scored: DataFrame, calibration: DataFrame, required: tuple[str, ...] = ("tau_energy", "tau_pr", "tau_sensitivity", "hard_negative_gap", "hard_negative_gap_norm", "separation", "positives")) -> list[str]:
    """What is missing from a run's results; empty if they are complete."""
    issues = [f"calibration lacks {k}" for k in required if k not in calibration.columns]
    if "energy" not in scored.columns:
        issues.append("scored rows lack energy")
    elif scored.limit(1).count() == 0:
        issues.append("there are no scored rows")
    elif scored.filter("energy is null").limit(1).count():
        issues.append("scored rows with null energy")
    return issues
