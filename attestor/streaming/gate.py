"""An extension: the gate over a stream. A verdict depends on its row alone, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.policies import ACCEPT, Policy
from attestor.plans.gate import trace


def verdicts(rows: DataFrame, policy: Policy) -> DataFrame:
    """A stream of energy and axes with verdicts and traces."""
    return trace(rows, policy)


def accept_rate(rows: DataFrame, policy: Policy, at: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, n, accept_rate by event time; rows later than `late` are left out."""
    judged = verdicts(rows.withWatermark(at, late), policy)
    counted = judged.groupBy(F.window(at, window)).agg(F.count("*").alias("n"), F.avg(F.when(F.col("verdict") == ACCEPT, 1.0).otherwise(0.0)).alias("accept_rate"))
    return counted.select(F.col("window.start").alias("window_start"), "n", "accept_rate")
