"""Sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nested_scored(rows: DataFrame, rank_cap: int = 8, top_k: int = 12, backend: str = "table") -> DataFrame:
    """Flat scored columns as the nested row of a dump; columns that rows lack are null."""
    has = lambda c, kind="double": F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    d = has("difficulty")
    bucket = F.when(d < 0.3, "easy").when(d < 0.7, "medium").when(d.isNotNull(), "hard")
    struct = lambda **kw: F.struct(*(v.alias(k) for k, v in kw.items()))
    geometry = struct(
        spectral=struct(**{c: has(c, "int" if c == "effective_rank" else "double") for c in ("sigma1_ratio", "sigma2_ratio", "spectral_sum", "participation_ratio", "effective_rank")}),
        alignment=struct(alignment_to_sigma1=has("alignment")),
        similarity=struct(**{c: has(c) for c in ("sim_top1", "sim_top2", "sim_margin")}),
        robustness=struct(sensitivity=has("sensitivity")),
        support=struct(effective_rank=has("effective_rank", "int"), used_count=has("evidence_count", "int"), entropy_rank=has("entropy_rank")),
    )
    return rows.select(
        struct(run_id=has("run_id", "string"), split=has("split", "string"), policy=has("policy_name", "string")).alias("meta"),
        has("claim", "string").alias("claim"),
        has("evidence", "array<string>").alias("evidence"),
        struct(value=d, bucket=bucket).alias("difficulty"),
        has("effectiveness").alias("effectiveness"),
        struct(claim_dim=has("claim_dim", "int"), evidence_count=has("evidence_count", "int"), embedding_backend=F.lit(backend)).alias("embedding"),
        struct(verdict=has("verdict", "string"), trace=struct(**{c: has(c) for c in ("tau_accept", "tau_review", "pr_threshold", "sensitivity_threshold", "margin_band")})).alias("decision"),
        struct(probe_variance=has("probe_variance")).alias("stability"),
        has("label", "int").alias("label"),
        struct(value=has("energy"), explained=has("explained"), identity_error=has("identity_error"), config=struct(evidence_topk=F.lit(top_k), rank_cap=F.lit(rank_cap)), geometry=geometry).alias("energy"),
        has("is_stable", "boolean").alias("is_stable"),
    )


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def json_lines_as_they_come(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends what has come in to path, batch by batch, and stops; a later call goes on where it stopped. Batches are written once, also if one has to be repeated."""
    return stream.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def run_header(spark: SparkSession, path: str, meta: dict, mode: str = "overwrite") -> None:
    """The facts of a run as one JSON line beside its dump."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode(mode).text(path)


def policy_markdown(board: DataFrame, title: str = "Policies", limit: int = 25) -> str:
    """A leaderboard's first rows and the list of the policies that no other beats."""
    from attestor.operators import metrics as M

    front = M.pareto_front(board).orderBy("neg_accept", "policy_name").select("policy_name", "neg_accept", "pos_accept")
    lines = [f"- {r['policy_name']}: {_shown(r['neg_accept'])} of negatives, {_shown(r['pos_accept'])} of positives" for r in front.collect()]
    return "\n".join([markdown(board, title, limit), "## Pareto front", "", *lines]) + "\n"


def csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file with a header; for reports of few rows."""
    rows.coalesce(1).write.mode(mode).option("header", True).csv(path)


def run_partition(rows: DataFrame, path: str, run_id: str) -> None:
    """Replaces the rows of one run under path, and no others."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def store_upsert(new: DataFrame, store: DataFrame, path: str, keys: list[str], at: str = "updated_at") -> None:
    """The store with new rows in place of older ones of their keys, written to path, which isn't the store's own."""
    from attestor.operators.prepare import upsert

    upsert(store, new, keys, at).write.mode("overwrite").parquet(path)


def views(sweep: DataFrame, scored: DataFrame | None = None, report: DataFrame | None = None) -> None:
    """Temporary views policy_sweep, eval_scored and run_report with v_policy_rates, v_tau_energy_only and v_false_accepts over them."""
    from attestor.operators import metrics as M

    sweep.createOrReplaceTempView("policy_sweep")
    if scored is not None:
        scored.createOrReplaceTempView("eval_scored")
    if report is not None:
        report.createOrReplaceTempView("run_report")
    M.policy_rates(sweep).createOrReplaceTempView("v_policy_rates")
    M.energy_tau(sweep).createOrReplaceTempView("v_tau_energy_only")
    M.false_accepts(sweep).createOrReplaceTempView("v_false_accepts")
    M.policy_metrics_raw(sweep).createOrReplaceTempView("policy_metrics")


def _shown(x) -> str:
    return "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def markdown(rows: DataFrame, title: str, limit: int = 25) -> str:
    """A report table of the first rows, for a DataFrame of few."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(_shown(v) for v in r) + " |" for r in rows.limit(limit).collect())]) + "\n"


def report_json(row: DataFrame) -> str:
    """A one-row report as JSON."""
    return row.select(F.to_json(F.struct("*")).alias("j")).first()["j"]


def proof(report: dict, least_auc: float = 0.6) -> str:
    """The part of a report by mode that shows whether energy tells the splits apart; collapse where auc is under least_auc."""
    keep = ("auc", "tpr", "far", "tau")
    return json.dumps({mode: {k: r.get(k) for k in keep} | {"collapse": (r.get("auc") or 0.0) < least_auc} for mode, r in report.items()}, sort_keys=True)
