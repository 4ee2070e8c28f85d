"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one source or several. Documents are aggregated by membership pattern; what a pattern can supply
is its number of words, once for each repetition, and a further repetition costs more than the one before. The flow
network has the patterns on one side and the sources with their quotas on the other; its least-cost flow says how many
words each pattern gives to each source. A pattern's flow is then turned into documents: all of them as often as it
covers, and for the rest those that come first in a seeded order, which is found by ranges of the order's hash and not
by sorting a pattern.
"""

from __future__ import annotations

import json
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import WORD, has_columns, stored

#: Different membership patterns and sources that the driver's network may have; more raise an error.
MAX_PATTERNS = 100_000
RANGES = 4096
_PLAN = pa.schema({"pattern": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "copies": pa.int64(), "rest": pa.int64(), "credit": pa.list_(pa.struct({"source": pa.string(), "share": pa.float64()}))})
_LAST = pa.schema({"pattern": pa.string(), "last": pa.int64(), "before": pa.int64()})


def words_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, total: int | None = None) -> dict:
    """The words each source should give: sources in order of code point, null last, weigh by turns and share `share` of all words (`total`, if sources overlap); none goes over `most` times its words, and what is over is shared anew by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, out, left = list(names), {}, share * (sum(sizes.values()) if total is None else total)
    while open_:
        whole = sum(weigh[s] for s in open_)
        over = [s for s in open_ if left * weigh[s] > most * sizes[s] * whole]
        if not over:
            out.update({s: left * weigh[s] / whole for s in open_})
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            open_.remove(s)
        left -= sum(out[s] for s in over)
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[dict[int, int]]:
    """Words from each pattern to each source: the quotas are met as far as they can be, at the least total cost.

    The r-th repetition of a pattern's words costs r a word (r = 0, 1, ... repeats - 1), and nothing else costs. Shortest
    paths therefore cost r = 0 first, then 1, and so on: one maximal flow after another, each with a repetition more, and
    every one by blocking flows along shortest levels.
    """
    flow = [dict.fromkeys(sorted(x), 0) for x in members]
    sources = [list(x) for x in flow]
    patterns: list[list[int]] = [[] for _ in quota]
    for p, x in enumerate(sources):
        for s in x:
            patterns[s].append(p)
    left, need = [0] * len(capacity), list(quota)
    for _ in range(repeats):
        left = [a + b for a, b in zip(left, capacity, strict=True)]
        while (levels := _levels(flow, sources, patterns, left, need)) is not None:
            _block(flow, sources, patterns, left, need, *levels)
    return flow


def _levels(flow, sources, patterns, left, need):
    """Levels of patterns and sources from patterns with words left, up to the first sources that need some; None if there are none."""
    at_p, at_s = [0 if x > 0 else -1 for x in left], [-1] * len(need)
    edge, depth = [p for p, x in enumerate(left) if x > 0], 0
    while edge:
        reached = []
        for p in edge:
            for s in sources[p]:
                if at_s[s] < 0:
                    at_s[s] = depth
                    reached.append(s)
        if any(need[s] > 0 for s in reached):
            return at_p, at_s, depth
        edge, depth = [], depth + 1
        for s in reached:
            for p in patterns[s]:
                if at_p[p] < 0 and flow[p][s] > 0:  # words given to s may go elsewhere
                    at_p[p] = depth
                    edge.append(p)
    return None


def _block(flow, sources, patterns, left, need, at_p, at_s, depth) -> None:
    """Pushes words along the levels until no path is left in them."""
    next_s, next_p = [0] * len(left), [0] * len(need)
    for first in range(len(left)):
        path = [first]  # pattern, source, pattern, ...
        while path and left[first] > 0 and at_p[first] == 0:
            x = path[-1]
            if len(path) % 2:
                while next_s[x] < len(sources[x]) and at_s[sources[x][next_s[x]]] != at_p[x]:
                    next_s[x] += 1
                if next_s[x] < len(sources[x]):
                    path.append(sources[x][next_s[x]])
                    continue
            elif at_s[x] == depth:
                if need[x] > 0:
                    back = [flow[path[i + 1]][path[i]] for i in range(1, len(path) - 1, 2)]
                    push = min(left[first], need[x], *back) if back else min(left[first], need[x])
                    left[first] -= push
                    need[x] -= push
                    for i in range(0, len(path), 2):
                        flow[path[i]][path[i + 1]] += push
                    for i in range(1, len(path) - 1, 2):
                        flow[path[i + 1]][path[i]] -= push
                    path = [first]
                    continue
            else:
                while next_p[x] < len(patterns[x]) and not (at_p[p := patterns[x][next_p[x]]] == at_s[x] + 1 and flow[p][x] > 0):
                    next_p[x] += 1
                if next_p[x] < len(patterns[x]):
                    path.append(patterns[x][next_p[x]])
                    continue
            path.pop()  # a dead end
            if path and len(path) % 2:
                next_s[path[-1]] += 1
            elif path:
                next_p[path[-1]] += 1


def seeded(seed: int, *columns: str) -> Column:
    """63 bits that order documents; equal in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1)


def _local(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """The driver's rows by way of Arrow: to read plain tuples, each executor would start Python workers of another kind and keep them."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema))


def _mixed(docs: DataFrame, sources: Column, keep: list[str], identity: list[str], weights: tuple[int, ...], share: Fraction, most: int, seed: int, exact: bool) -> DataFrame:
    """row (struct of keep), size, pattern, source_size, target, credit, taken."""
    spark = docs.sparkSession
    # names of sources, in order; null for none
    pattern = F.when(F.size(F.coalesce(sources, F.array().cast("array<string>"))) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(sources)))
    rows = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.to_json(pattern).alias("pattern"), words_of(F.col("text")).alias("size"), seeded(seed, *identity).alias("turn")), "mix")
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted(((r["pattern"], tuple(json.loads(r["pattern"])), r["size"]) for r in found), key=lambda x: [(s is None, s or "") for s in x[1]])
    sizes: dict = {}
    for _, p, size in patterns:
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    want = targets(sizes, weights, share, most, sum(size for _, _, size in patterns))
    names = list(sizes)
    at = {s: i for i, s in enumerate(names)}
    flows = min_cost_flow([size for _, _, size in patterns], [[at[s] for s in p] for _, p, _ in patterns], [int(want[s]) for s in names], most)
    plan = []
    for (key, p, size), flow in zip(patterns, flows, strict=True):
        taken = sum(flow.values())
        copies = taken // size if size else 0
        credit = [{"source": s, "share": flow[at[s]] / taken} for s in p if flow[at[s]]]
        plan.append((key, sizes[p[0]], float(want[p[0]]), copies, taken - copies * size, credit))
    # at most MAX_PATTERNS rows
    planned = F.broadcast(_local(spark, plan, _PLAN))
    rows = rows.join(planned, "pattern").withColumn("range", F.shiftright("turn", 63 - RANGES.bit_length() + 1))
    # in which range of the order the rest ends, and the words before it
    ranges = rows.groupBy("pattern", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    sums = ranges.withColumn("before", F.sum("words").over(Window.partitionBy("pattern").orderBy("range")) - F.col("words"))
    last = sums.filter("before < rest and before + words >= rest").select("pattern", F.col("range").alias("last"), "before")
    last = _local(spark, [tuple(r) for r in last.collect()], _LAST)  # a row a pattern
    rows = rows.join(F.broadcast(last), "pattern", "left")
    inside = F.col("range") == F.col("last")
    whole = F.when(F.col("last").isNull(), False).otherwise(F.col("range") < F.col("last"))
    edge = rows.filter(inside)
    order = Window.partitionBy("pattern").orderBy("turn", "size")
    edge = edge.withColumn("left", F.col("rest") - F.col("before") - (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    part = F.greatest(F.lit(0), F.least("size", "left"))
    more = part if exact else F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(0)
    out = ["row", "size", "pattern", "source_size", "target", "credit"]
    taken = lambda x: (F.col("copies") * F.col("size") + x).cast("long").alias("taken")
    return edge.select(*out, taken(more)).unionByName(rows.filter(~F.coalesce(inside, F.lit(False))).select(*out, taken(F.when(whole, F.col("size")).otherwise(0))))


def mix(docs: DataFrame, sources: str = "sources", weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, size, pattern (JSON), source_size, target, credit and taken (words, repetitions counted).

    docs has doc_id, text and `sources`, the array of sources of a document (a null element is a source of its own; a null
    or empty array is the source null alone). Of a document with several sources, source_size and target are those of
    the first in the pattern; credit has the share of its taken words that counts for each of its sources. A null or empty
    text has size 0 and nothing is taken of it. Repeated rows are documents of their own;
    null doc_ids too. The last document taken of a pattern counts only for the words still missing, so that the words
    taken are the flow. Other columns are ignored; an empty table gives no rows.
    """
    has_columns(docs, ["doc_id", "text", sources])
    return _mixed(docs, F.col(sources), ["doc_id"], ["doc_id", "text"], weights, share, most, seed, True).select("row.*", "size", "pattern", "source_size", "target", "credit", "taken")


def mixed_documents(docs: DataFrame, sources: Column, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 42) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken; columns as they are, whatever their names. The last document of a pattern is taken whole or not, whichever is nearer; documents without words (null and empty texts) aren't taken. Null ids and sources, repeated rows, long texts and empty tables are as in mix()."""
    has_columns(docs, ["doc_id", "text"])
    out = _mixed(docs, sources, docs.columns, ["doc_id", "text"], weights, share, most, seed, False).filter("taken > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.expr("taken div size").cast("int")))).select("row.*")
