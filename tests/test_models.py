"""The operators behind the queries that are too slow to run whole here, on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import metrics as M
from attestor.operators import models, prepare
from attestor.plans import gate
from attestor.sources import writers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), i % 2, float(i % 2 * 0.8 + rng.normal() * 0.4), float(i % 2 + rng.normal() * 0.3), float(rng.normal()), "neg" if i % 2 else "pos") for i in range(120)]
    return spark.createDataFrame(rows, "id string, label int, energy double, good double, noise double, split string").cache()


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_fusion(spark, labelled):
    rows = labelled.collect()
    got = {r["name"]: r for r in M.fusion(labelled, ["good", "noise"], F.col("split") == "pos").collect()}
    assert set(got) == {"energy+good", "energy-good", "energy+noise", "energy-noise"}
    alone = auc([(-r["energy"], r["split"] == "pos") for r in rows])
    for sign in (1, -1):
        r = got["energy+good" if sign > 0 else "energy-good"]
        assert r["auc"] == pytest.approx(auc([(-x["energy"] + sign * x["good"], x["split"] == "pos") for x in rows]))
        assert r["delta_auc"] == pytest.approx(r["auc"] - alone)
    assert got["energy-good"]["corr"] == pytest.approx(np.corrcoef([r["energy"] for r in rows], [r["good"] for r in rows])[0, 1])


def test_folds_and_ablation(labelled):
    got = models.cross_validated(labelled, ["good"])
    assert len(got) == 5 and min(got) > 0.9
    by = dict(models.ablation(labelled, {"good": ["good"], "noise": ["noise"]}))
    assert set(by) == {"full", "without good", "without noise"}
    assert by["without good"] < 0.75 < 0.9 < by["without noise"] and by["full"] > 0.9


def test_residual_independence(labelled):
    got = {a: (alone, both, gain) for a, alone, both, gain in models.residual_independence(labelled, ["good", "noise"])}
    assert got["good"][2] > 0.02 > got["noise"][2] and got["good"][1] == pytest.approx(got["good"][0] + got["good"][2])


def test_boosting(labelled):
    score, gain = models.boosted_split(labelled, ["good", "noise"], trees=5)
    assert score > 0.9 and gain["good"] > gain["noise"]
    assert len(models.boosted_cv(labelled, ["good"], k=2, trees=2)) == 2


def test_bootstrap_is_a_plain_one(spark, labelled):
    """Each replicate by a plain sum over the same draws."""
    got = M.bootstrap_auc(labelled, "energy", F.col("label") == 1, 40).first()
    keys = {r["id"]: r["k"] for r in labelled.select("id", (M.portable_hash(42, F.col("id")) % M.PRIME).alias("k")).collect()}
    rows = [(keys[r["id"]], r["energy"], r["label"]) for r in labelled.collect()]
    aucs, drawn = [], []
    for a, c in M.draw_keys(42, 40):
        w = [sum((k * a + c) % M.PRIME >= t for t in M.DRAWS) for k, _, _ in rows]
        drawn += w
        pos, neg = [(x, s) for x, (_, s, y) in zip(w, rows) if y], [(x, s) for x, (_, s, y) in zip(w, rows) if not y]
        wins = sum(p * n * ((a > b) + (a == b) / 2) for p, a in pos for n, b in neg)
        aucs.append(wins / (sum(p for p, _ in pos) * sum(n for n, _ in neg)))
    assert (got["mean"], got["low"], got["high"], got["replicates"]) == pytest.approx((np.mean(aucs), np.percentile(aucs, 2.5), np.percentile(aucs, 97.5), 40))
    assert abs(np.mean(drawn) - 1) < 0.05 and abs(np.var(drawn) - 1) < 0.1


def test_gate_run(spark):
    """The whole run: its thresholds are those of its own negatives, and verdicts follow from them."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((120, 8))
    e = v + 0.4 * rng.standard_normal((120, 8))
    rows = [(i, f"p{i}", v[i].tolist(), [e[i].tolist(), rng.standard_normal(8).tolist()]) for i in range(120)]
    found, sweep = gate.run(spark.createDataFrame(rows, "idx long, pair_id string, claim_vec array<double>, evidence_vecs array<array<double>>"))
    t = found.first()
    assert (t["positives"], t["easy_negatives"], t["hard_negatives"]) == (60, 60, 60) and t["separation"] > 0
    got = sweep.collect()
    assert len(got) == 6 * 120 and len({r["policy_name"] for r in got}) == 6
    energy = [r for r in got if r["tau_accept"] is not None and r["policy_name"].startswith("EnergyOnly")]
    assert len(energy) == 120 and all((r["verdict"] == "accept") == (r["energy"] <= t["tau_energy"]) for r in energy)
    rate = {s: np.mean([r["verdict"] == "accept" for r in energy if r["split"] == s]) for s in ("pos", "neg")}
    assert rate["pos"] > rate["neg"]


def test_quantiles_by_group(spark):
    from attestor.operators.ranks import quantiles

    rng = np.random.default_rng(1)
    rows = [(g, float(round(x, 1))) for g, n in (("a", 400), ("b", 7), (None, 50)) for x in rng.normal(size=n)] + [("a", None), ("c", None)]
    got = {r["g"]: r for r in quantiles(spark.createDataFrame(rows, "g string, x double"), F.col("x"), [0.0, 0.1, 0.5, 0.97], ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        assert [r[f"q{i}"] for i in range(4)] == pytest.approx(np.quantile([x for k, x in rows if k == g and x is not None], [0.0, 0.1, 0.5, 0.97]))
    plan = quantiles(spark.createDataFrame(rows, "g string, x double"), F.col("x"), [0.5])
    assert plan.first()["q0"] == pytest.approx(np.quantile([x for _, x in rows if x is not None], 0.5))


def test_sinks_of_a_run(spark, tmp_path):
    source, path = str(tmp_path / "in"), f"file://{tmp_path}/out"
    spark.range(3).write.mode("append").parquet(source)
    take = lambda: writers.json_lines_as_they_come(spark.readStream.schema("id long").parquet(source), path, f"file://{tmp_path}/state").awaitTermination()
    take()
    assert spark.read.json(path).count() == 3
    spark.range(3, 5).write.mode("append").parquet(source)
    take()
    assert sorted(r["id"] for r in spark.read.json(path).collect()) == list(range(5))
    writers.run_header(spark, f"file://{tmp_path}/head", {"run": "r1", "n": 5})
    assert json.loads(spark.read.text(f"file://{tmp_path}/head").first()["value"]) == {"run": "r1", "n": 5}
    assert M.missing_files(spark, [path, f"file://{tmp_path}/none"]) == [f"file://{tmp_path}/none"]
    board = spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.4, 0.2)], "policy_name string, pos_accept double, neg_accept double")
    text = writers.policy_markdown(board)
    assert "## Pareto front" in text and "- a: 0.1000" in text and "- b" not in text
    assert M.mode_column(board.withColumn("mode", F.lit("x"))) == "mode" and M.mode_column(board) is None


def test_pages_by_title(spark):
    pages = spark.createDataFrame([("Café au lait", "p1"), ("B_c", "p2")], "title string, page_id string")
    asked = spark.createDataFrame([("Café au lait",), ("B c",), ("none",)], "title string")
    assert {r["title"]: r["page_id"] for r in prepare.page_by_title(asked, pages).collect()} == {"Café au lait": "p1", "B c": "p2", "none": None}
