"""Accept, review or reject: each policy is one CASE expression over a scored row's axes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCEPT, REVIEW, REJECT = "accept", "review", "reject"


@dataclass(frozen=True)
class Axes:
    """The columns a policy reads; names or columns."""

    energy: Column | str = "energy"
    participation_ratio: Column | str = "participation_ratio"
    sensitivity: Column | str = "sensitivity"
    explained: Column | str = "explained"


def _c(axis: Column | str) -> Column:
    return F.col(axis) if isinstance(axis, str) else axis


@dataclass(frozen=True)
class Policy:
    """kind: which rule. Thresholds that a rule doesn't use stay None. gap is relative to tau for `adaptive`, absolute for `gap` and `monotone`."""

    kind: str
    tau: float | None = None
    tau_review: float | None = None
    tau_pr: float | None = None
    tau_sensitivity: float | None = None
    gap: float | None = None
    pr_reject: float | None = None
    sensitivity_reject: float | None = None
    tau_explained: float | None = None
    explained_reject: float | None = None
    weights: tuple[float, float, float] = field(default=(1.0, 0.5, 0.5))

    def __post_init__(self):
        if self.kind not in RULES:
            raise ValueError(f"unknown policy: {self.kind}")

    @property
    def review_at(self) -> float | None:
        """Above it energy is rejected at once; 1.25 tau unless given."""
        return self.tau_review or (None if self.tau is None else 1.25 * self.tau)

    @property
    def name(self) -> str:
        shown = {"tau_energy": self.tau, "tau_pr": self.tau_pr, "tau_sens": self.tau_sensitivity, "gap": self.gap}
        inner = ", ".join(f"{k}={v:.2f}" for k, v in shown.items() if v is not None and (k == "tau_energy" or self.kind != "energy"))
        return f"{NAMES[self.kind]}({inner})"

    def verdict(self, axes: Axes = Axes()) -> Column:
        return RULES[self.kind](self, axes)


def _case(*steps: tuple[Column, str], otherwise: str) -> Column:
    out = None
    for condition, verdict in steps:
        out = F.when(condition, verdict) if out is None else out.when(condition, verdict)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _energy(p: Policy, a: Axes) -> Column:
    e = _or_zero(_c(a.energy))
    return _case((e > p.review_at, REJECT), (e <= p.tau, ACCEPT), otherwise=REJECT)


def _adaptive(p: Policy, a: Axes) -> Column:
    e, width = _or_zero(_c(a.energy)), p.gap * p.tau
    return _case(
        (e > p.review_at, REJECT),
        (e <= p.tau - width, ACCEPT),
        (e >= p.tau + width, REJECT),
        (_or_zero(_c(a.participation_ratio)) > p.tau_pr, REVIEW),
        (_or_zero(_c(a.sensitivity)) > p.tau_sensitivity, REVIEW),
        (e <= p.tau, ACCEPT),
        otherwise=REVIEW,
    )


def _gap(p: Policy, a: Axes) -> Column:
    e = _or_zero(_c(a.energy))
    return _case(
        (e > p.review_at, REJECT),
        ((F.abs(e - p.tau) > p.gap) & (e <= p.tau), ACCEPT),
        (F.abs(e - p.tau) > p.gap, REJECT),
        (_or_zero(_c(a.participation_ratio)) > p.tau_pr, REVIEW),
        (_or_zero(_c(a.sensitivity)) > p.tau_sensitivity, REVIEW),
        (e <= p.tau, ACCEPT),
        otherwise=REJECT,
    )


def _extreme(p: Policy, a: Axes) -> Column:
    over = F.lit(False)
    if p.pr_reject is not None:
        over = over | (_c(a.participation_ratio) > p.pr_reject)
    if p.sensitivity_reject is not None:
        over = over | (_c(a.sensitivity) > p.sensitivity_reject)
    return over


def _monotone(p: Policy, a: Axes) -> Column:
    e, pr, s = _c(a.energy), _c(a.participation_ratio), _c(a.sensitivity)
    return _case(
        (e.isNull(), REVIEW),
        (e > p.review_at, REJECT),
        (e > p.tau, REJECT),
        (F.lit((p.gap or 0) > 0) & (F.abs(e - p.tau) > (p.gap or 0.0)), ACCEPT),
        (pr.isNull() | s.isNull(), REVIEW),
        (_extreme(p, a), REJECT),
        ((pr > p.tau_pr) | (s > p.tau_sensitivity), REVIEW),
        otherwise=ACCEPT,
    )


def _pr_only(p: Policy, a: Axes) -> Column:
    x = _c(a.participation_ratio)
    return _case((x.isNull(), REVIEW), (x > p.pr_reject if p.pr_reject is not None else F.lit(False), REJECT), (x <= p.tau_pr, ACCEPT), otherwise=REVIEW)


def _sensitivity_only(p: Policy, a: Axes) -> Column:
    x = _c(a.sensitivity)
    return _case((x.isNull(), REVIEW), (x > p.sensitivity_reject if p.sensitivity_reject is not None else F.lit(False), REJECT), (x <= p.tau_sensitivity, ACCEPT), otherwise=REVIEW)


def _explained_only(p: Policy, a: Axes) -> Column:
    x = _c(a.explained)
    return _case((x.isNull(), REVIEW), (x < p.explained_reject if p.explained_reject is not None else F.lit(False), REJECT), (x >= p.tau_explained, ACCEPT), otherwise=REVIEW)


def _axis_only(p: Policy, a: Axes) -> Column:
    pr, s = _c(a.participation_ratio), _c(a.sensitivity)
    return _case((pr.isNull() | s.isNull(), REVIEW), (_extreme(p, a), REJECT), (pr > p.tau_pr, REVIEW), (s > p.tau_sensitivity, REVIEW), otherwise=ACCEPT)


def _axis_first(p: Policy, a: Axes) -> Column:
    e, pr, s = _c(a.energy), _c(a.participation_ratio), _c(a.sensitivity)
    return _case((e.isNull() | pr.isNull() | s.isNull(), REVIEW), (pr > p.tau_pr, REVIEW), (s > p.tau_sensitivity, REVIEW), (e > p.review_at, REJECT), (e <= p.tau, ACCEPT), otherwise=REJECT)


def soft_score(a: Axes = Axes(), weights: tuple[float, float, float] = (1.0, 0.5, 0.5)) -> Column:
    return weights[0] * _or_zero(_c(a.energy)) + weights[1] * _or_zero(_c(a.participation_ratio)) + weights[2] * _or_zero(_c(a.sensitivity))


def _soft(p: Policy, a: Axes) -> Column:
    return _case((soft_score(a, p.weights) <= p.tau, ACCEPT), otherwise=REJECT)


def _oracle_gap(p: Policy, a: Axes) -> Column:
    """The rule on the gap to an oracle's energy, given as the energy axis."""
    return _case((_c(a.energy) <= p.tau, ACCEPT), (_c(a.energy) <= 1.25 * p.tau, REVIEW), otherwise=REJECT)


RULES: dict[str, Callable[[Policy, Axes], Column]] = {
    "energy": _energy,
    "adaptive": _adaptive,
    "gap": _gap,
    "monotone": _monotone,
    "pr_only": _pr_only,
    "sensitivity_only": _sensitivity_only,
    "explained_only": _explained_only,
    "axis_only": _axis_only,
    "axis_first": _axis_first,
    "soft": _soft,
    "oracle_gap": _oracle_gap,
}
NAMES = {
    "energy": "EnergyOnlyPolicy",
    "adaptive": "AdaptivePolicy",
    "gap": "GapAdaptivePolicy",
    "monotone": "MonotoneAdaptivePolicy",
    "pr_only": "ParticipationRatioOnlyPolicy",
    "sensitivity_only": "SensitivityOnlyPolicy",
    "explained_only": "AlignmentOnlyPolicy",
    "axis_only": "AxisOnlyPolicy",
    "axis_first": "AxisFirstPolicy",
    "soft": "SoftWeightedPolicy",
    "oracle_gap": "OracleGapPolicy",
}
#: Names under which a registry user may ask for a rule.
ALIASES = {"adaptive": "monotone", "energy": "energy", "energy_only": "energy", "pr": "pr_only", "pr_only": "pr_only", "sens": "sensitivity_only", "sensitivity_only": "sensitivity_only", "axis": "axis_only", "axis_only": "axis_only", "axis_first": "axis_first"}

#: Energy thresholds by the share of negatives they accept, as published for the energy gap.
PRESETS = {"P1": 0.3319, "P5": 0.3943, "P10": 0.4559, "P20": 0.5264, "P30": 0.5833}


def build(alias: str, **thresholds) -> Policy:
    """The registry: a policy by its public name."""
    if alias not in ALIASES:
        raise ValueError(f"unknown policy: {alias}; known: {sorted(ALIASES)}")
    return Policy(ALIASES[alias], **thresholds)


def effectiveness(energy: Column, tau: Column) -> Column:
    """How far energy stays below tau, as a share of it; 0 without tau."""
    return F.when(tau.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (tau - energy) / F.greatest(tau, F.lit(1e-6))))


# fixed values: the explanations as they are shown
WHY_REJECTED = {"energy": "Energy exceeds review threshold.", "pr": "High PR (diffuse evidence manifold).", "sensitivity": "High sensitivity (brittle evidence dependence).", "effectiveness": "Insufficient effectiveness margin.", "other": "Rejected by policy fallback.", "not": "Not rejected."}
WHY_REVIEWED = {"margin": "Within policy margin band.", "difficulty": "Moderate difficulty region.", "effectiveness": "Low effectiveness margin.", "pr": "PR exceeds threshold.", "sensitivity": "Sensitivity exceeds threshold.", "other": "Reviewed by policy fallback.", "not": "Not reviewed."}


@dataclass(frozen=True)
class Trace:
    """The columns of a decision's trace; thresholds may be null, as may be any column that a decision didn't have."""

    verdict: Column | str = "verdict"
    energy: Column | str = "energy"
    participation_ratio: Column | str = "participation_ratio"
    sensitivity: Column | str = "sensitivity"
    effectiveness: Column | str = "effectiveness"
    difficulty: Column | str = "difficulty"
    tau_accept: Column | str = "tau_accept"
    tau_review: Column | str = "tau_review"
    margin_band: Column | str = "margin_band"
    pr_threshold: Column | str = "pr_threshold"
    sensitivity_threshold: Column | str = "sensitivity_threshold"

    def __getitem__(self, name: str) -> Column:
        return _c(getattr(self, name))


def _joined(texts: dict[str, str], steps: dict[str, Column]) -> Column:
    """The texts of the steps that hold, in their order; a step that is null doesn't."""
    all_of = F.concat_ws(" | ", *(F.when(c, texts[k]) for k, c in steps.items()))
    return F.when(all_of == "", texts["other"]).otherwise(all_of)


def reject_reasons(t: Trace = Trace()) -> Column:
    steps = {
        "energy": t["energy"] > t["tau_review"],
        "pr": t["participation_ratio"] > t["pr_threshold"],
        "sensitivity": t["sensitivity"] > t["sensitivity_threshold"],
        "effectiveness": t["effectiveness"] < 0.05,
    }
    return F.when(t["verdict"] != REJECT, WHY_REJECTED["not"]).otherwise(_joined(WHY_REJECTED, steps))


def review_reasons(t: Trace = Trace()) -> Column:
    steps = {
        "margin": F.abs(t["energy"] - t["tau_accept"]) <= t["margin_band"],
        "difficulty": t["difficulty"] > 0.4,
        "effectiveness": t["effectiveness"] < 0.25,
        "pr": t["participation_ratio"] > t["pr_threshold"],
        "sensitivity": t["sensitivity"] > t["sensitivity_threshold"],
    }
    return F.when(t["verdict"] != REVIEW, WHY_REVIEWED["not"]).otherwise(_joined(WHY_REVIEWED, steps))


def expected_verdict(t: Trace = Trace(), least_review: float = 0.05, least_accept: float = 0.25) -> Column:
    """The verdict that the trace's numbers should have led to."""
    e, f, tau = t["energy"], t["effectiveness"], t["tau_accept"]
    partial = F.when(f < least_review, REJECT).when(f < least_accept, REVIEW).otherwise(ACCEPT)
    full = _case(
        ((e > t["tau_review"]) | (f < least_review), REJECT),
        (F.abs(e - tau) <= F.coalesce(t["margin_band"], 0.1 * tau), REVIEW),
        (f < least_accept, REVIEW),
        (t["participation_ratio"] > t["pr_threshold"], REVIEW),
        (t["sensitivity"] > t["sensitivity_threshold"], REVIEW),
        (e <= tau, ACCEPT),
        otherwise=REVIEW,
    )
    return F.when(tau.isNull() | t["tau_review"].isNull(), partial).otherwise(full)


def trace_issues(t: Trace = Trace()) -> Column:
    """array<struct<level, code, message>> of what is wrong with a trace; empty if nothing is."""
    expected = expected_verdict(t)
    tau, tau_review = t["tau_accept"], t["tau_review"]
    number = lambda name: F.format_string("%.4f", t[name])
    checks = (
        (~t["energy"].between(0.0, 1.0), "range.energy", F.concat(F.lit("Energy out of [0,1]: "), number("energy"))),
        (~t["difficulty"].between(0.0, 1.0), "range.difficulty", F.concat(F.lit("Difficulty out of [0,1]: "), number("difficulty"))),
        (t["effectiveness"] < 0.0, "range.effectiveness", F.concat(F.lit("Effectiveness < 0: "), number("effectiveness"))),
        (~((tau > 0.0) & (tau <= 1.0)), "range.tau_accept", F.concat(F.lit("tau_accept invalid: "), number("tau_accept"))),
        (tau_review < tau, "order.tau", F.concat(F.lit("tau_review < tau_accept: "), number("tau_review"), F.lit(" < "), number("tau_accept"))),
        (t["verdict"] != expected, "verdict.mismatch", F.concat(F.lit("Verdict mismatch: trace="), t["verdict"], F.lit(" expected="), expected)),
    )
    issue = lambda code, message: F.struct(F.lit("error").alias("level"), F.lit(code).alias("code"), message.alias("message"))
    return F.filter(F.array(*(F.when(c, issue(code, m)) for c, code, m in checks)), lambda x: x.isNotNull())
