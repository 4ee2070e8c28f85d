import itertools

import pytest

from attestor.functions import policies as P
from attestor.plans.gate import policy_suite, trace

ROW = "energy double, participation_ratio double, sensitivity double, explained double"


def verdicts(spark, policy, rows):
    df = spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], ROW).coalesce(1)
    return [r[0] for r in df.select(policy.verdict()).collect()]


def test_energy(spark):
    p = P.Policy("energy", tau=0.4)
    assert verdicts(spark, p, [(0.4,), (0.41,), (0.5,), (0.51,)]) == ["accept", "reject", "reject", "reject"]
    assert p.review_at == pytest.approx(0.5) and p.name == "EnergyOnlyPolicy(tau_energy=0.40)"


def test_adaptive_band_is_relative(spark):
    p = P.Policy("adaptive", tau=0.5, tau_pr=2.0, tau_sensitivity=0.8, gap=0.1)
    rows = [(0.45, 9.0, 1.0), (0.46, 9.0, 0.1), (0.46, 1.0, 0.9), (0.5, 1.0, 0.1), (0.52, 1.0, 0.1), (0.55, 1.0, 0.1), (0.7, 1.0, 0.1)]
    assert verdicts(spark, p, rows) == ["accept", "review", "review", "accept", "review", "reject", "reject"]


def test_missing_axes(spark):
    full = {"tau": 0.5, "tau_pr": 2.0, "tau_sensitivity": 0.8}
    for kind in ("monotone", "axis_first"):
        assert verdicts(spark, P.Policy(kind, **full, gap=0.01), [(None, 1.0, 0.1)]) == ["review"]
    assert verdicts(spark, P.Policy("axis_only", **full), [(0.1, None, 0.1)]) == ["review"]
    assert verdicts(spark, P.Policy("adaptive", **full, gap=0.1), [(None, None, None)]) == ["accept"]  # read as 0


def test_worked_example(spark):
    assert verdicts(spark, P.Policy("energy", tau=0.45), [(0.2824,)]) == ["accept"]
    assert verdicts(spark, P.Policy("oracle_gap", tau=P.PRESETS["P10"]), [(0.2824,), (0.5,), (0.6,)]) == ["accept", "review", "reject"]


def test_thresholds_are_monotone(spark):
    rows = [(i / 50, 1.5, 0.5, 1 - i / 50) for i in range(51)]
    rates = [sum(v == "accept" for v in verdicts(spark, P.Policy("monotone", tau=t, tau_pr=2.0, tau_sensitivity=0.8, gap=0.05), rows)) for t in P.PRESETS.values()]
    assert rates == sorted(rates)


def test_registry():
    assert P.build("sens", tau_sensitivity=0.5).kind == "sensitivity_only"
    for bad in ("nothing", ""):
        with pytest.raises(ValueError):
            P.build(bad)
    with pytest.raises(ValueError):
        P.Policy("nothing")


def test_trace_reasons_and_issues(spark):
    p = P.Policy("adaptive", tau=0.5, tau_pr=2.0, tau_sensitivity=0.8, gap=0.3)
    rows = spark.createDataFrame([(0.1, 1.0, 0.1, 0.9), (0.49, 3.0, 0.9, 0.5), (0.9, 3.0, 0.1, 0.1)], ROW).coalesce(1)
    got = trace(rows, p).select("verdict", P.reject_reasons().alias("no"), P.review_reasons().alias("maybe"), P.expected_verdict().alias("expected"), P.trace_issues().alias("issues")).collect()
    assert [r["verdict"] for r in got] == ["accept", "review", "reject"]
    assert got[0]["no"] == "Not rejected." and got[0]["maybe"] == "Not reviewed." and got[0]["issues"] == []
    assert got[1]["maybe"].split(" | ")[0] == "Within policy margin band." and "PR exceeds threshold." in got[1]["maybe"]
    assert got[2]["no"] == "Energy exceeds review threshold. | High PR (diffuse evidence manifold). | Insufficient effectiveness margin."
    bad = trace(rows, p).withColumn("energy", rows["energy"] + 2)
    assert {i["code"] for r in bad.select(P.trace_issues().alias("x")).collect() for i in r["x"]} >= {"range.energy"}


def test_suite_has_a_row_for_each_policy(spark):
    rows = spark.range(5).selectExpr("id as idx", "'pos' as split", "id / 5.0D as energy", "1.0D as participation_ratio", "0.5D as sensitivity", "0.5D as explained")
    suite = policy_suite(rows, [P.Policy("energy", tau=0.5), P.Policy("pr_only", tau_pr=2.0)], ["idx", "split"])
    assert suite.count() == 10 and suite.select("row_id").distinct().count() == 10
    assert {tuple(r) for r in suite.select("policy_name").distinct().collect()} == {("EnergyOnlyPolicy(tau_energy=0.50)",), ("ParticipationRatioOnlyPolicy(tau_pr=2.00)",)}


def test_every_rule_gives_one_of_three(spark):
    full = {"tau": 0.5, "tau_pr": 1.5, "tau_sensitivity": 0.5, "gap": 0.1, "tau_explained": 0.5}
    grid = list(itertools.product([0.0, 0.5, 1.0, None], [1.0, 2.0, None], [0.2, 0.9, None], [0.1, 0.9]))
    for kind in P.RULES:
        assert set(verdicts(spark, P.Policy(kind, **full), grid)) <= {"accept", "review", "reject"}
