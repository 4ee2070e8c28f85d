"""Supervised evaluation: split and cross-validated logistic regression, boosting, ablation, each with all its models at once; forests with pyspark.ml."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import batched
from attestor.operators import metrics as M
from attestor.operators.frames import settled
from attestor.operators.negatives import dense_index, portable_hash
from attestor.operators.ranks import met

# fixed values: feature sets
GEOMETRY = ["mean_sim_top1", "min_sim_top1", "mean_sim_margin", "min_sim_margin", "mean_coverage", "min_coverage", "max_energy", "mean_energy", "min_energy", "p90_energy", "frac_above_threshold", "high_energy_count", "energy_gap"]
ENTAILMENT = ["max_entailment", "mean_entailment", "min_entailment", "entailment_gap"]
LENGTH = ["sentence_count", "paragraph_count"]
FEATURE_SETS = {"geometry": GEOMETRY, "entailment": ENTAILMENT, "no_length": GEOMETRY + ENTAILMENT, "full": GEOMETRY + ENTAILMENT + LENGTH}


def features(support: DataFrame) -> DataFrame:
    """Support features as doubles with the two gaps; what is missing or no number is 0."""
    gaps = support.withColumn("energy_gap", F.col("max_energy") - F.col("min_energy")).withColumn("entailment_gap", F.col("max_entailment") - F.col("min_entailment"))
    other = [c for c in gaps.columns if c not in FEATURE_SETS["full"]]
    return gaps.select(*other, *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in FEATURE_SETS["full"]))


def _ranked(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """df with at__, the place of a row within its class in a seeded order, and n__, the class's rows. The order goes over range partitions of all rows; a class's places start where it does."""
    rows = dense_index(df.withColumn("turn__", portable_hash(seed, F.col(key))), [F.col(label), F.col("turn__"), F.col(key)], "at__")
    return met(rows, rows.groupBy(label).agg(F.min("at__").alias("first__"), F.count("*").alias("n__")), [label]).withColumn("at__", F.col("at__") - F.col("first__")).drop("turn__", "first__")


def stratified_split(df: DataFrame, label: str = "label", key: str = "id", share: float = 0.7, seed: int = 42) -> DataFrame:
    """df with `part`: train for the first share of each class in a seeded order, else test."""
    return _ranked(df, label, key, seed).withColumn("part", F.when(F.col("at__") < F.floor(F.col("n__") * share), "train").otherwise("test")).drop("at__", "n__")


def folds(df: DataFrame, k: int = 5, label: str = "label", key: str = "id", seed: int = 42) -> DataFrame:
    return _ranked(df, label, key, seed).withColumn("fold", (F.col("at__") % k).cast("int")).drop("at__", "n__")


def scaled(df: DataFrame, fit_on: DataFrame, names: list[str]) -> DataFrame:
    """df with names standardised by the mean and population deviation of fit_on; flat columns become 0."""
    stats = fit_on.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    value = lambda c: (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] if stats[f"s_{c}"] else F.lit(0.0)
    return df.withColumns({c: value(c) for c in names})


def _assembled(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(df.withColumn("label", F.col("label").cast("double")))


def _auc(scored: DataFrame) -> float | None:
    return M.auc(scored, F.col("score"), F.col("label") == 1).first()["auc"]


def _with_score(df: DataFrame, names: list[str], fit: batched.Logistic) -> DataFrame:
    z = lambda i, n: (F.col(f"`{n}`").cast("double") - float(fit.mean[i])) / float(fit.deviation[i])
    margin = sum((float(w) * z(i, n) for i, (n, w) in enumerate(zip(names, fit.weights, strict=True)) if np.isfinite(fit.deviation[i])), F.lit(fit.intercept))
    return df.withColumn("label", F.col("label").cast("double")).withColumn("score", 1 / (1 + F.exp(-margin)))


def split_models(df: DataFrame, sets: dict[str, list[str]], key: str = "id", seed: int = 42, scale: bool = True) -> dict[str, tuple[float | None, dict[str, float], DataFrame]]:
    """By name of the set: (test auc, coefficients, scored test rows) of a stratified 70/30 split; all are fitted together."""
    parts = settled(stratified_split(df, key=key, seed=seed))
    table = batched.Table(parts, [batched.Model(names, F.col("part") == "train", "train" if scale else None) for names in sets.values()])
    fits = batched.logistic(table)
    found = zip(sets.items(), fits, _aucs(batched.logistic_scores(table, fits), len(sets)), strict=True)
    return {name: (auc, dict(zip(names, fit.weights.tolist(), strict=True)), _with_score(parts.filter("part = 'test'"), names, fit)) for (name, names), fit, auc in found}


def split_model(df: DataFrame, names: list[str], key: str = "id", seed: int = 42, scale: bool = True) -> tuple[float | None, dict[str, float], DataFrame]:
    """(test auc, coefficients, scored test rows) of a stratified 70/30 split."""
    return split_models(df, {"": names}, key, seed, scale)[""]


def _aucs(scores: DataFrame, count: int) -> list[float | None]:
    """The auc of each of `count` models in scores (model, score, label); None where a class is missing."""
    found = {r["model"]: r["auc"] for r in M.auc(scores, F.col("score"), F.col("label") == 1, ["model"]).collect()}
    return [found.get(i) for i in range(count)]


def _all_folds(df: DataFrame, k: int, key: str, seeds: tuple[int, ...], label: str = "label") -> DataFrame:
    """df with fold__, an array of its fold under each seed; rows of all seeds are ranked in one dealing out."""
    rows = settled(df.withColumn("row__", F.monotonically_increasing_id()))
    each = rows.select("row__", label, key, F.explode(F.array(*(F.struct(F.lit(s).alias("seed__"), portable_hash(s, F.col(key)).alias("turn__")) for s in seeds))).alias("s__")).select("row__", label, key, "s__.*")
    ranked = dense_index(each, [F.col("seed__"), F.col(label), F.col("turn__"), F.col(key)], "at__")
    ranked = met(ranked, ranked.groupBy("seed__", label).agg(F.min("at__").alias("first__")), ["seed__", label])
    at = ranked.groupBy("row__").agg(F.map_from_entries(F.collect_list(F.struct("seed__", ((F.col("at__") - F.col("first__")) % k).cast("int")))).alias("f__"))
    return rows.join(at, "row__").withColumn("fold__", F.array(*(F.col("f__")[F.lit(s)] for s in seeds))).drop("row__", "f__")


def cross_validated_sets(df: DataFrame, sets: dict[str, list[str]], k: int = 5, key: str = "id", seed: int = 42) -> dict[str, list[float]]:
    """By name of the set: test auc by fold; features are scaled on all rows. All folds of all sets are fitted together."""
    table = batched.Table(_all_folds(df, k, key, (seed,)), [batched.Model(names, F.col("fold__")[0] != i, "all") for names in sets.values() for i in range(k)])
    got = _aucs(batched.logistic_scores(table, batched.logistic(table)), len(sets) * k)
    return {name: [a for a in got[i * k : (i + 1) * k] if a is not None] for i, name in enumerate(sets)}


def cross_validated(df: DataFrame, names: list[str], k: int = 5, key: str = "id", seed: int = 42) -> list[float]:
    """Test auc by fold; features are scaled on all rows."""
    return cross_validated_sets(df, {"": names}, k, key, seed)[""]


def forest(train: DataFrame, names: list[str], trees: int = 300, depth: int = 6, seed: int = 42):
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(_assembled(train, names))


def boosted_split(df: DataFrame, names: list[str], key: str = "id", trees: int = 300, seed: int = 42) -> tuple[float | None, dict[str, float]]:
    """(test auc, share of gain by feature) of boosted trees on a stratified 70/30 split."""
    table = batched.Table(stratified_split(df, key=key, seed=seed), [batched.Model(names, F.col("part") == "train")])
    fits, cuts = batched.boosted(table, trees, seed=seed)
    return _aucs(batched.boosted_scores(table, fits, cuts), 1)[0], dict(zip(names, fits[0].gain.tolist(), strict=True))


def boosted_cv(df: DataFrame, names: list[str], k: int = 5, trees: int = 300, key: str = "id", seed: int = 42) -> list[float]:
    """Test auc by fold of boosted trees; the folds' trees grow together."""
    table = batched.Table(_all_folds(df, k, key, (seed,)), [batched.Model(names, F.col("fold__")[0] != i) for i in range(k)])
    fits, cuts = batched.boosted(table, trees, seed=seed)
    return [a for a in _aucs(batched.boosted_scores(table, fits, cuts), k) if a is not None]


def in_sample(df: DataFrame, names: list[str]) -> tuple[float | None, DataFrame]:
    """(auc, scored rows) of a logistic model on the rows it has learnt from, unscaled."""
    rows = settled(df)
    fit = batched.logistic(batched.Table(rows, [batched.Model(names, F.lit(True))]))[0]
    scored = _with_score(rows, names, fit)
    return _auc(scored), scored


def ablation(df: DataFrame, sets: dict[str, list[str]], key: str = "id", seed: int = 42) -> list[tuple[str, float | None]]:
    """(name, test auc) of the full set and of each set left out of it; all are fitted together."""
    every = list(dict.fromkeys(n for names in sets.values() for n in names))
    left = {"full": every} | {f"without {name}": [n for n in every if n not in names] for name, names in sets.items()}
    return [(name, got[0]) for name, got in split_models(df, {n: x for n, x in left.items() if x}, key, seed).items()]


def residual_independence(df: DataFrame, axes: list[str], base: str = "energy") -> list[tuple[str, float, float, float]]:
    """(axis, auc of base alone, with the axis, gain), in-sample and unscaled; all are fitted together."""
    table = batched.Table(df, [batched.Model([base, *([a] if a else [])], F.lit(True)) for a in [None, *axes]])
    alone, *both = _aucs(batched.logistic_scores(table, batched.logistic(table)), len(axes) + 1)
    return [(a, alone, b, b - alone) for a, b in zip(axes, both, strict=True) if b is not None and alone is not None]


def composite_difficulty(df: DataFrame) -> DataFrame:
    """df with composite, the in-sample probability of a logistic model on five scaled axes."""
    rows = df.withColumn("one_less_margin", 1 - F.col("sim_margin"))
    names = ["participation_ratio", "one_less_margin", "sensitivity", "entropy_rank", "effective_rank"]
    rows = rows.na.drop(subset=names).withColumns({n: F.col(n).cast("double") for n in names})
    return in_sample(scaled(rows, rows, names), names)[1].withColumnRenamed("score", "composite")


def seed_stability(df: DataFrame, names: list[str], seeds: tuple[int, ...] = (0, 1, 2, 3, 4), key: str = "id", k: int = 5) -> list[tuple[int, float]]:
    """(seed, mean auc over folds); the folds of all seeds are fitted together."""
    table = batched.Table(_all_folds(df, k, key, seeds), [batched.Model(names, F.col("fold__")[s] != i, "all") for s in range(len(seeds)) for i in range(k)])
    got = _aucs(batched.logistic_scores(table, batched.logistic(table)), len(seeds) * k)
    by = [(seed, [a for a in got[s * k : (s + 1) * k] if a is not None]) for s, seed in enumerate(seeds)]
    return [(seed, sum(a) / len(a)) for seed, a in by if a]


def boundary_composite(df: DataFrame, tau: float, width: float) -> tuple[float | None, DataFrame]:
    """(auc, rows with composite) of the composite difficulty among rows whose energy is within width of tau."""
    rows = composite_difficulty(M.band(df, tau, width))
    return M.auc(rows, F.col("composite"), F.col("label") == 1).first()["auc"], rows
