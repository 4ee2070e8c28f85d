"""Supervised evaluation of sentence support: features, correlations, models, intervals and ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import metrics, models, support
from attestor.operators.frames import settled


def features(summaries: DataFrame, entailment: DataFrame | None = None, store: DataFrame | None = None, with_energy: bool = True) -> DataFrame:
    """id, label and the features of summaries (id, summary, document, label); summaries without a sentence have no row."""
    rows = support.sentence_support(summaries, entailment=entailment, store=store, with_energy=with_energy)
    return models.features(support.support_features(rows).join(summaries.select("id", "label"), "id"))


def evaluate(table: DataFrame, sets: dict[str, list[str]] | None = None, replicates: int = 1000, trees: int = 0) -> dict:
    """By feature set: test auc, coefficients, cross-validated aucs and the bootstrap interval; then the ablation, and boosting with `trees` over 0."""
    out: dict = {"sets": {}}
    sets = sets or models.FEATURE_SETS
    table = settled(table)
    folds = models.cross_validated_sets(table, sets)
    for name, (auc, weights, scored) in models.split_models(table, sets).items():
        interval = metrics.bootstrap_auc(scored, "score", F.col("label") == 1, replicates, order="id").first().asDict()
        out["sets"][name] = {"auc": auc, "coefficients": weights, "cv": folds[name], "bootstrap": interval}
    out["ablation"] = models.ablation(table, {"geometry": models.GEOMETRY, "entailment": models.ENTAILMENT, "length": models.LENGTH})
    if trees:
        out["boosting"] = models.boosted_split(table, models.FEATURE_SETS["full"], trees=trees)
    return out
