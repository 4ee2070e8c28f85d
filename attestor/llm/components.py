"""Connected components by alternating large-star and small-star steps, with min aggregates and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from attestor.llm.common import dropped, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step on different edges with u > v. Each node's neighbours move to the least of them; the aggregate is combined map-side and the join can be split where a node has very many edges."""
    pairs = edges if small else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if small:
        # the edge to the least itself carries the node's own
        moved = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, stored, and what tells whether a step has changed them: their number and a hash, loops aside."""
    seen = Observation()
    loop = F.col("u") == F.col("v")
    marked = edges.observe(seen, F.count(F.when(~loop, 1)).alias("n"), F.sum(F.when(~loop, F.xxhash64("u", "v").cast("decimal(38,0)"))).alias("h"))
    out = stored(marked, "edges")
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the least node reachable. Each round halves distances; every round's edges are stored, and those of the round before removed.

    Self-loops, repeated and reversed edges are allowed; null ends are ignored; no edges give no rows.
    """
    edges = edges.select("u", "v").filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    given, mark = _kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops, now = given.filter(F.col("u") == F.col("v")), given.filter(F.col("u") != F.col("v"))
    last = None
    for _ in range(max_rounds):
        if not mark[0]:
            break
        now, seen = _kept(_star(_star(now, small=False), small=True))
        if last is not None:
            dropped(last)
        if seen == mark:
            break
        last, mark = now, seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # all nodes are still there, each with its root only
    own = now.select(F.col("v").alias("node"), F.col("v").alias("root")).unionByName(loops.select(F.col("u").alias("node"), F.col("v").alias("root")))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own).groupBy("node").agg(F.min("root").alias("root"))
