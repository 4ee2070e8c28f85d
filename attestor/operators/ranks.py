"""Running sums and exact quantiles over range partitions: no task sees all rows of a group, however few groups there are."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.frames import settled


def met(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of few, which has a row for each of keys (or one row, without keys); null keys are alike."""
    if not keys:
        return rows.crossJoin(F.broadcast(few))  # one row
    named = few.select(*(F.col(k).alias(f"key{i}__") for i, k in enumerate(keys)), *(c for c in few.columns if c not in keys))
    alike = functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"key{i}__")) for i, k in enumerate(keys)))
    return rows.join(named, alike, "left").drop(*(f"key{i}__" for i in range(len(keys))))


def running(rows: DataFrame, by: list[str], order: str, columns: dict[str, str]) -> DataFrame:
    """rows with sums (named as columns says) of the rows before, in order and within by. Rows are range-partitioned by both, and every partition adds what lies before it."""
    parts = settled(rows.repartitionByRange(*by, order).withColumn("part__", F.spark_partition_id()))
    own = Window.partitionBy("part__", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part__", *by).agg(*(F.sum(c).alias(f"t_{c}") for c in columns))
    # a row a partition, and one more for each group that begins in it
    earlier = (Window.partitionBy(*by) if by else Window).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part__", *by, *(F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0)).alias(f"t_{c}") for c in columns))
    out = met(parts, before, ["part__", *by])
    for c, name in columns.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"t_{c}"))
    return out.drop("part__", *(f"t_{c}" for c in columns))


def quantiles(df: DataFrame, value: Column, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """by, q0, q1, ...: the quantiles of value at probs (0 to 1), interpolated linearly; nulls don't count. Without by one row, null without values."""
    by = by or []
    counted = df.select(*by, value.cast("double").alias("v__")).filter("v__ is not null").groupBy(*by, "v__").agg(F.count("*").alias("c__"))
    rows = running(counted, by, "v__", {"c__": "b__"})
    rows = met(rows, rows.groupBy(*by).agg(F.sum("c__").alias("n__")), by)

    def at(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n__") - 1)
        held = lambda k: F.max(F.when((k >= F.col("b__")) & (k < F.col("b__") + F.col("c__")), F.col("v__")))
        low, high = held(F.floor(place)), held(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return rows.groupBy(*by).agg(*(at(p).alias(f"q{i}") for i, p in enumerate(probs)))


def quantiles_of(df: DataFrame, wanted: dict[str, tuple[Column, float]], by: list[str] | None = None) -> DataFrame:
    """by and a column for each of wanted: the quantile of its value at its probability. All are found in one dealing out."""
    by = by or []
    probs = sorted({p for _, p in wanted.values()})
    values: list[tuple[str, Column]] = []
    place = {}
    for name, (value, _) in wanted.items():
        text = str(value)
        place[name] = next((i for i, (t, _) in enumerate(values) if t == text), len(values))
        if place[name] == len(values):
            values.append((text, value))
    stacked = df.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("w__"), v.cast("double").alias("x__")) for i, (_, v) in enumerate(values)))).alias("s__")).select(*by, "s__.*")
    got = quantiles(stacked, F.col("x__"), probs, [*by, "w__"])
    return got.groupBy(*by).agg(*(F.max(F.when(F.col("w__") == place[n], F.col(f"q{probs.index(p)}"))).alias(n) for n, (_, p) in wanted.items()))
