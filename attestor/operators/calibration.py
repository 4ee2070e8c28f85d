"""Thresholds from the energies of negatives and the diagnostics of positives. Percentiles interpolate linearly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.frames import settled
from attestor.operators.negatives import dense_index, portable_hash
from attestor.operators.ranks import quantiles, quantiles_of

LEAST_ROWS, LEAST_SPLIT = 10, 50
PERCENTILES = (1, 5, 10, 20, 30)


def gap(hard: Column, easy: Column) -> Column:
    """Mean difference, and (normalised) over the standard deviation of easy, 0 if that is under 1e-6."""
    mean = F.avg(hard) - F.avg(easy)
    return F.struct(mean.alias("gap"), F.when(F.stddev_pop(easy) < 1e-6, 0.0).otherwise(mean / F.stddev_pop(easy)).alias("normalised"))


def calibrate(positives: DataFrame, easy: DataFrame, hard: DataFrame, percentile: float = 10, percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """One row of thresholds.

    positives: energy, participation_ratio, sensitivity; easy and hard: energy of deranged and mined negatives. Each needs
    ten rows. tau_pr and tau_sensitivity are 90th percentiles of the positives at or under tau, of all if they are fewer than ten.
    """
    h = hard.agg(F.avg("energy").alias("hard_mean"), F.count("energy").alias("hard_n"))
    taus = quantiles(hard, F.col("energy"), [percentile / 100, *(p / 100 for p in percentiles)]).toDF("tau_energy", *(f"tau_p{p}" for p in percentiles))
    e = easy.agg(F.avg("energy").alias("easy_mean"), F.stddev_pop("energy").alias("easy_std"), F.count("energy").alias("easy_n"))
    rows = settled(positives.select("energy", "participation_ratio", "sensitivity").crossJoin(F.broadcast(taus.select("tau_energy"))))  # one row
    inside = F.col("energy") <= F.col("tau_energy")
    counts = rows.agg(F.avg("energy").alias("mean"), F.count("energy").alias("positives"), F.count(F.when(inside, 1)).alias("inside"))
    pr, sensitivity = F.col("participation_ratio"), F.col("sensitivity")
    marks = quantiles_of(rows, {"pr_all": (pr, 0.9), "pr_in": (F.when(inside, pr), 0.9), "s_all": (sensitivity, 0.9), "s_in": (F.when(inside, sensitivity), 0.9)} | {f"pr_p{p}": (pr, 1 - p / 100) for p in percentiles})
    few = F.col("inside") < LEAST_ROWS
    gap_ = F.col("hard_mean") - F.col("easy_mean")
    # one row each
    out = taus.crossJoin(h).crossJoin(e).crossJoin(counts).crossJoin(marks).select(
        "tau_energy",
        F.when(few, F.col("pr_all")).otherwise(F.col("pr_in")).alias("tau_pr"),
        F.when(few, F.col("s_all")).otherwise(F.col("s_in")).alias("tau_sensitivity"),
        *(f"tau_p{p}" for p in percentiles),
        *(f"pr_p{p}" for p in percentiles),
        gap_.alias("hard_negative_gap"),
        F.when(F.col("easy_std") < 1e-6, 0.0).otherwise(gap_ / F.col("easy_std")).alias("hard_negative_gap_norm"),
        (F.col("hard_mean") - F.col("mean")).alias("separation"),
        "positives",
        F.col("easy_n").alias("easy_negatives"),
        F.col("hard_n").alias("hard_negatives"),
    )
    enough = F.least("positives", "easy_negatives", "hard_negatives") >= LEAST_ROWS
    return out.filter(F.when(enough, True).otherwise(F.raise_error(F.lit(f"calibration needs {LEAST_ROWS} positives, easy and hard negatives each")).cast("boolean")))


def separation(positives: DataFrame, hard: DataFrame) -> DataFrame:
    """One row: mean hard energy minus mean positive energy; 0 if either has no rows."""
    p, h = positives.agg(F.avg("energy").alias("p")), hard.agg(F.avg("energy").alias("h"))
    return p.crossJoin(h).select(F.coalesce(F.col("h") - F.col("p"), F.lit(0.0)).alias("separation"))


def split(df: DataFrame, share: float = 0.5, seed: int = 1337, key: str = "pair_id", least: int = LEAST_SPLIT) -> DataFrame:
    """df with `part`: calibration for the first share of the rows in a seeded order, evaluation for the others. Fewer than `least` rows raise."""
    n = df.count()
    if n < least:
        raise ValueError(f"{n} rows; at least {least} are needed")
    order = dense_index(df.withColumn("turn__", portable_hash(seed, F.col(key))), [F.col("turn__"), F.col(key)], "at__")
    return order.withColumn("part", F.when(F.col("at__") < int(n * share), "calibration").otherwise("evaluation")).drop("turn__", "at__")
