"""Fits of many models at once: as pyspark.ml's, as each alone, and as a plain tree."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from attestor.operators import batched, models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 100, 0]
    y = (x[:, 0] + 0.1 * (x[:, 1] - 100) + rng.normal(size=400) > 0).astype(int)
    return spark.createDataFrame([(f"r{i}", *map(float, v), 1.0, int(t)) for i, (v, t) in enumerate(zip(x, y))], "id string, a double, b double, c double, flat double, label int").cache()


def by_ml(train, names, c=1.0):
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(train.withColumn("label", F.col("label").cast("double")))
    fit = LogisticRegression(regParam=1 / (c * train.count()), elasticNetParam=0.0, standardization=False, maxIter=3000, tol=1e-12).fit(rows)
    return fit.intercept, fit.coefficients.toArray()


def test_logistic_as_one_by_one(data):
    """Unscaled and scaled, on folds and on all rows, with a flat feature: one after the other gives the same."""
    parts = models.folds(data, 3)
    scaled = models.scaled(parts, parts, ["a", "b", "flat"])
    specs = [batched.Model(["a", "c"], F.lit(True))] + [batched.Model(["a", "b", "flat"], F.col("fold") != i, "all") for i in range(3)]
    fits = batched.logistic(batched.Table(parts, specs))
    want = [by_ml(data, ["a", "c"])] + [by_ml(scaled.filter(F.col("fold") != i), ["a", "b", "flat"]) for i in range(3)]
    for fit, (intercept, weights) in zip(fits, want, strict=True):
        assert fit.intercept == pytest.approx(intercept, abs=1e-6) and fit.weights == pytest.approx(weights, abs=1e-6)


def test_passes_do_not_grow_with_models(data, monkeypatch):
    passes = []
    whole = batched.Table.summed
    monkeypatch.setattr(batched.Table, "summed", lambda self, part: passes.append(1) or whole(self, part))
    counts = []
    for n in (1, 25):
        passes.clear()
        batched.logistic(batched.Table(data, [batched.Model(["a", "b"], F.lit(True), "all")] * n))
        counts.append(len(passes))
    assert counts[0] == counts[1] < 15


def test_rejects_what_is_no_number(data):
    with pytest.raises(Exception, match="finite"):
        batched.logistic(batched.Table(data.withColumn("a", F.when(F.col("b") > 100, F.col("a"))), [batched.Model(["a"], F.lit(True))]))
    with pytest.raises(ValueError, match="no rows"):
        batched.logistic(batched.Table(data.limit(0), [batched.Model(["a"], F.lit(True))]))


def test_boosting_alone_and_together(data):
    """Two folds' trees are those of each fold alone; the first split is the best of all cuts."""
    parts = models.folds(data, 2)
    specs = [batched.Model(["a", "b", "c"], F.col("fold") != i) for i in range(2)]
    fit = lambda s, **more: batched.boosted(batched.Table(parts, s), 4, 3, rows=1.0, columns=1.0, **more)
    both, cuts = fit(specs)
    for i in range(2):
        alone = fit([specs[i]])[0][0]
        for (f, c, v), (g, d, w) in zip(both[i].trees, alone.trees, strict=True):
            assert f.tolist() == g.tolist() and c.tolist() == d.tolist() and v == pytest.approx(w, abs=1e-12)
    rows = parts.filter("fold <> 0").select("a", "b", "c", "label").toPandas()
    p = rows["label"].mean()
    best = max((((p - y[m]).sum() ** 2 / (p * (1 - p) * m.sum()) + (p - y[~m]).sum() ** 2 / (p * (1 - p) * (~m).sum()), j, k) for y in [rows["label"].to_numpy()] for j, n in enumerate("abc") for k, c in enumerate(cuts[j]) for m in [rows[n].to_numpy() <= c] if 0 < m.sum() < len(m)))
    assert (both[0].trees[0][0][0], both[0].trees[0][1][0]) == best[1:]


def test_boosting_in_partitions(data, monkeypatch):
    """Rows in one task and rows shared out give the same trees; margins are checkpointed on the way."""
    parts = data.repartition(4, "id")
    fit = lambda: batched.boosted(batched.Table(parts, [batched.Model(["a", "b"], F.lit(True))]), 4, 3)[0][0]
    one = fit()
    monkeypatch.setattr(batched, "WORTH", 100)
    monkeypatch.setattr(batched, "CHECKPOINT", 2)
    for (f, c, v), (g, d, w) in zip(one.trees, fit().trees, strict=True):
        assert f.tolist() == g.tolist() and c.tolist() == d.tolist() and v == pytest.approx(w, abs=1e-9)


def test_boosted_models(data):
    auc, gain = models.boosted_split(data, ["a", "b", "c"], trees=30)
    assert auc > 0.7 and gain["a"] > gain["c"] and sum(gain.values()) == pytest.approx(1)
    assert len(models.boosted_cv(data, ["a", "b"], k=3, trees=10)) == 3


def test_seeds_together(data):
    got = models.seed_stability(data, ["a", "b"], seeds=(3, 9), k=3)
    for seed, mean in got:
        assert mean == pytest.approx(np.mean(models.cross_validated(data, ["a", "b"], 3, seed=seed)), abs=1e-9)
