"""The gate from pairs to verdicts: geometry, effectiveness, policy, trace; and the fan-out over several policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as X
from attestor.functions.policies import Axes, Policy, effectiveness
from attestor.functions.vectors import clip01
from attestor.operators import calibration, metrics, negatives
from attestor.operators.geometry import RANK, TOP_K, geometry


def trace(rows: DataFrame, policy: Policy) -> DataFrame:
    """rows with effectiveness, difficulty, margin_band, verdict and the policy's thresholds, from their axes."""
    tau = F.lit(policy.tau).cast("double")
    number = lambda x: F.lit(x).cast("double")
    return (
        rows.withColumn("tau_accept", tau)
        .withColumn("tau_review", number(policy.review_at))
        .withColumn("pr_threshold", number(policy.tau_pr))
        .withColumn("sensitivity_threshold", number(policy.tau_sensitivity))
        .withColumn("margin_band", 0.1 * F.col("tau_accept"))
        .withColumn("effectiveness", effectiveness(F.col("energy"), F.col("tau_accept")))
        .withColumn("difficulty", 1 - clip01(F.col("effectiveness")))
        .withColumn("policy_name", F.lit(policy.name))
        .withColumn("verdict", policy.verdict(Axes()))
    )


def gate(pairs: DataFrame, policy: Policy, rank: int = RANK, top_k: int = TOP_K) -> DataFrame:
    """pairs (claim_vec, evidence_vecs) with diagnostics, verdict and trace. Without evidence, energy is 1."""
    return trace(geometry(pairs, rank=rank, top_k=top_k), policy)


def policy_suite(rows: DataFrame, policies: list[Policy], keys: list[str]) -> DataFrame:
    """A row for each of rows and each policy: keys, policy_name, verdict, effectiveness, tau_accept, row_id. The axes are computed once; the policies are an array that is exploded, so nothing is joined."""
    one = lambda p: F.struct(F.lit(p.name).alias("policy_name"), p.verdict(Axes()).alias("verdict"), effectiveness(F.col("energy"), F.lit(p.tau).cast("double")).alias("effectiveness"), F.lit(p.tau).cast("double").alias("tau_accept"))
    names = [k for k in keys if k != "energy"]
    out = rows.select(*names, "energy", F.explode(F.array(*(one(p) for p in policies))).alias("p")).select(*names, "energy", "p.*")
    return out.withColumn("row_id", X.row_id(F.col("split"), F.col(keys[0]).cast("string"), F.col("policy_name")))


def run(pairs: DataFrame, mode: str = "offset", far: float = 0.1, gap: float = 0.3, seed: int = 1337, index: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(calibration row, sweep rows) of a whole run: split, negatives, calibration on one part, policies on the other.

    pairs: idx (dense), pair_id, claim_vec, evidence_vecs. far is the share of hard negatives that energy may accept.
    """
    parts = calibration.split(pairs, 0.5, seed).drop(index)
    train = negatives.dense_index(parts.filter("part = 'calibration'"), [F.col("pair_id")], index)
    test = negatives.dense_index(parts.filter("part = 'evaluation'"), [F.col("pair_id")], index)
    pos = geometry(train).select("energy", "participation_ratio", "sensitivity")
    easy, hard = (negatives.negative_energies(train, m, seed) for m in ("deranged", "hard_mined_v2"))
    found = calibration.calibrate(pos, easy, hard, round(far * 100))
    t = found.first()
    both = geometry(test).withColumn("split", F.lit("pos")).select("pair_id", "split", "energy", "participation_ratio", "sensitivity", "explained")
    neg = geometry(negatives.negatives(test, mode, seed)).withColumn("split", F.lit("neg")).select(*both.columns)
    tau, pr, s = t["tau_energy"], t["tau_pr"], t["tau_sensitivity"]
    policies = [Policy("energy", tau=tau), Policy("adaptive", tau=tau, tau_pr=pr, tau_sensitivity=s, gap=gap), Policy("monotone", tau=tau, tau_pr=pr, tau_sensitivity=s, gap=gap), Policy("axis_first", tau=tau, tau_pr=pr, tau_sensitivity=s), Policy("pr_only", tau_pr=pr), Policy("sensitivity_only", tau_sensitivity=s)]
    return found, policy_suite(both.unionByName(neg), policies, ["pair_id", "split"])


def report(sweep: DataFrame, scored: DataFrame) -> dict[str, DataFrame]:
    """The frames of a run's report, by name."""
    return {
        "rates": metrics.policy_rates(sweep),
        "leaderboard": metrics.leaderboard(sweep),
        "pareto": metrics.pareto_front(metrics.leaderboard(sweep)),
        "energy": metrics.energy_metrics(scored),
        "auc": metrics.auc(scored, -F.col("energy"), F.col("split") == "pos"),
        "distribution": metrics.distribution(scored, "energy", ["split"]),
        "curve": metrics.tau_sweep(scored, metrics.tau_grid()),
    }
