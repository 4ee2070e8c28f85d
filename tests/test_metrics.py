import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestor.operators import calibration, metrics as M, models, support
from attestor.plans import evaluation


def rows(spark, scores):
    return spark.createDataFrame([(float(s), y) for s, y in scores], "x double, y boolean")


def brute(scores):
    pos, neg = [s for s, y in scores if y], [s for s, y in scores if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("scores", [[(1, True), (0, False)], [(1, True), (1, False)] * 3, [(0, True), (1, False)], [(i % 7, i % 3 == 0) for i in range(60)]])
def test_auc(spark, scores):
    assert M.auc(rows(spark, scores), F.col("x"), F.col("y")).first()["auc"] == pytest.approx(brute(scores))


def test_auc_of_one_class_and_of_none(spark):
    assert M.auc(rows(spark, [(1, True), (2, True)]), F.col("x"), F.col("y")).first()["auc"] is None
    assert M.auc(spark.createDataFrame([], "x double, y boolean"), F.col("x"), F.col("y")).first()["auc"] is None
    got = M.auc_by_axis(rows(spark, [(1, True), (2, True)]), {"a": F.col("x")}, F.col("y"), 5).first()
    assert got["reason"] == "too_few_samples" and got["auc"] is None
    assert M.auc_by_axis(rows(spark, [(1, True), (2, True)]), {"a": F.col("x")}, F.col("y")).first()["reason"] == "single_class_in_gap"


def test_large_auc_by_range_partitions(spark):
    rng = np.random.default_rng(0)
    scores = [(round(float(x), 2), bool(y)) for x, y in zip(rng.normal(size=3000), rng.random(3000) < 0.3)]
    assert M.auc(rows(spark, scores), F.col("x"), F.col("y")).first()["auc"] == pytest.approx(brute(scores))


def test_bins_at_their_edges(spark):
    d = spark.createDataFrame([(0.0,), (0.1,), (0.3,), (1.0,)], "difficulty double").withColumn("verdict", F.lit("review")).withColumn("split", F.lit("pos"))
    got = {r["bin"]: (r["n"], r["value"]) for r in M.effectiveness_curve(d).collect()}
    assert len(got) == 10 and got[0] == (1, 1.0) and got[1] == (1, 1.0) and got[2] == (1, 1.0) and got[9] == (0, None)
    assert M.effectiveness_curve(d, keep_empty=False).count() == 3
    assert {r["bin"]: r["n"] for r in M.histogram(d, "difficulty").collect()} == {0: 1, 4: 1, 12: 1, 39: 1}


def test_pareto(spark):
    board = spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.2, 0.5), ("c", 0.2, 0.7), ("d", 0.3, 0.6), ("e", 0.1, 0.5)], "policy_name string, neg_accept double, pos_accept double")
    assert {r["policy_name"] for r in M.pareto_front(board).collect()} == {"a", "c", "e"}


def test_interpolation_takes_the_higher_of_equal_points(spark):
    curve = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 0.4, 0.1), (0.5, 0.8, 0.2)], "far double, tpr double, tau double")
    ask = spark.createDataFrame([(0.0,), (0.25,), (0.9,)], "far double")
    assert [r["at"] for r in M.interpolated(curve, ask).orderBy("far").collect()] == pytest.approx([0.4, 0.6, 0.8])
    assert M.dominates(curve.filter("tau > 0"), curve.filter("tau < 0.2")).first()["dominates"]


def test_sweep_counts_scores_on_a_tau(spark):
    d = spark.createDataFrame([(0.0, "pos"), (0.5, "pos"), (0.5, "neg"), (2.0, "neg")], "energy double, split string")
    got = {r["tau"]: (r["tpr"], r["far"]) for r in M.tau_sweep(d, [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got == {0.0: (0.5, 0.0), 0.25: (0.5, 0.0), 0.5: (1.0, 0.5), 1.0: (1.0, 0.5)}


def test_correlations_leave_flat_axes_out(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (None, 1.0, 5.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["corr"] for r in M.correlations(d, ["a", "b", "c"]).collect()}
    assert set(got) == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")} and got["a", "b"] == pytest.approx(1)
    assert M.correlation_eigenvalues(M.correlations(d, ["a", "b"])) == pytest.approx([2, 0], abs=1e-9)
    assert M.correlations(d, ["c"]).count() == 0


def test_calibration_needs_ten(spark):
    few = spark.createDataFrame([(0.1, 1.0, 0.5)] * 9, "energy double, participation_ratio double, sensitivity double")
    with pytest.raises(Exception, match="needs 10"):
        calibration.calibrate(few, few, few).collect()
    with pytest.raises(ValueError):
        calibration.split(few.withColumn("pair_id", F.lit("x")))


def test_artifacts(spark):
    assert M.artifact_issues(spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1.0,)], "tau_energy double"))[-1] == "scored rows lack energy"


def test_embedding_store(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "text string")
    from attestor.functions.text import text_hash

    store = texts.filter("text = 'a'").select(text_hash(F.col("text")).alias("text_hash"), F.lit("m").alias("model"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    got = [(r["text"], r["vec"]) for r in support.embed(texts, store, "m", 2).collect()]
    assert len(got) == 4 and ("a", [1.0, 2.0]) in got and (None, None) in got


def test_support_of_sentences(spark):
    good, other = "This sentence is long enough to count.", "Completely different words over here now."
    d = spark.createDataFrame([("1", good, f"{good}\n\n{other}", 0), ("2", "Short.", good, 1)], "id string, summary string, document string, label int")
    got = support.sentence_support(d).collect()
    assert len(got) == 1 and got[0]["sim_top1"] == pytest.approx(1) and got[0]["energy"] == pytest.approx(0, abs=1e-9) and got[0]["paragraph_count"] == 2
    table = evaluation.features(d)
    assert table.count() == 1 and table.first()["energy_gap"] == 0.0


def test_models_find_what_is_there(spark):
    rng = np.random.default_rng(2)
    data = [(str(i), int(i % 2), float(i % 2 + rng.normal() * 0.3), float(rng.normal())) for i in range(200)]
    d = spark.createDataFrame(data, "id string, label int, good double, noise double")
    auc, weights, _ = models.split_model(d, ["good", "noise"])
    assert auc > 0.95 and abs(weights["good"]) > abs(weights["noise"])
    folds = models.folds(d).groupBy("fold", "label").count().collect()
    assert {r["count"] for r in folds} == {20}
    assert models.stratified_split(d).groupBy("label").agg(F.count(F.when(F.col("part") == "train", 1)).alias("n")).first()["n"] == 70


def test_support_of_long_documents(spark):
    """10,000 sentences against 10,000 paragraphs in blocks, as by numpy; no row holds more than a block."""
    words = [f"w{i % 1009}x{i % 37} and{i % 101} more{i % 11}" for i in range(10_000)]
    text = "\n\n".join(f"{w} {i // 100} in a paragraph." for i, w in enumerate(words))
    summary = " ".join(f"{w} {i // 50} in a sentence." for i, w in enumerate(words))
    got = {r["sentence_at"]: r for r in support.sentence_support(spark.createDataFrame([("1", summary, text)], "id string, summary string, document string")).collect()}
    assert len(got) == 10_000 and {r["paragraph_count"] for r in got.values()} == {10_000}
    vec = lambda texts: np.array(support.hashed_vector.func(pd.Series(texts)).tolist())
    s, p = vec([x for x in (f"{w} {i // 50} in a sentence." for i, w in enumerate(words))]), vec(text.split("\n\n"))
    _, values, vt = np.linalg.svd(p, full_matrices=False)
    basis = vt[:32][values[:32] > 1e-6]
    for i in range(0, 10_000, 777):
        sims = np.sort(p @ s[i])[::-1]
        assert got[i]["sim_top1"] == pytest.approx(sims[0]) and got[i]["sim_margin"] == pytest.approx(sims[0] - sims[1], abs=1e-9)
        assert got[i]["coverage"] == pytest.approx((sims > 0.3 + 1e-12).mean())
        assert got[i]["energy"] == pytest.approx(np.clip(1 - ((basis @ s[i]) ** 2).sum(), 0, 1), abs=1e-9)


def test_entailment_of_top_paragraphs(spark):
    """Of three paragraphs the two nearest count; a pair without a probability counts as 0."""
    from attestor.functions.text import entailment_key

    s, near, next_, far = "alpha beta gamma delta epsilon.", "alpha beta gamma delta epsilon zeta.", "alpha beta gamma other words.", "nothing like it here."
    d = spark.createDataFrame([("1", s, "\n\n".join((far, near, next_)))], "id string, summary string, document string")
    probs = spark.createDataFrame([(near, s, 0.75), (far, s, 1.0)], "p string, s string, entailment_prob double").select(entailment_key(F.col("p"), F.col("s")).alias("key"), "entailment_prob")
    row = support.sentence_support(d, top_k=2, entailment=probs).first()
    assert (row["entailment_max"], row["entailment_mean"], row["entailment_min"]) == (0.75, 0.375, 0.0)


def test_paragraphs_in_linear_time(spark):
    """A text of 100,000 sentences without blank lines."""
    from attestor.functions.text import paragraphs

    text = " ".join(f"Sentence {i}." for i in range(100_000))
    parts = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(paragraphs(F.col("t")).alias("p")).collect()
    assert len(parts[0]["p"]) == 20_000 and parts[0]["p"][1] == "Sentence 5. Sentence 6. Sentence 7. Sentence 8. Sentence 9."
    assert parts[1]["p"] is None and parts[2]["p"] == []
