"""Adversarial negatives: claims keep their side and get other claims' evidence.

Positional modes are equi-joins on a dense index. Mining ranks centroids for each claim: exactly, through clusters whose
radius bounds what they can hold, and block by block where the centroids don't cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import pages_of
from attestor.functions.vectors import centroid, unit
from attestor.operators.clusters import BLOCK, greatest, ranked
from attestor.operators.frames import settled
from attestor.operators.geometry import spectral
from attestor.operators.ranks import quantiles

OFFSET, CANDIDATES = 37, 16
EVIDENCE = ("evidence", "evidence_ids", "evidence_vecs")
LABELS = {"hard_mined_v2": "NEG_HARD_V2", "hardest_energy": "NEG_HARDEST"}
MODES = ("cyclic", "offset", "deranged", "permute", "hard_mined", "hard_mined_v2", "hardest_energy")


def portable_hash(seed: int, *columns: Column) -> Column:
    """32 bits that other engines compute alike: the first half of an md5 of the joined texts."""
    text = F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def dense_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """df with a dense index from 0 in the given total order. Rows are range-partitioned and each partition adds the number of rows before it: no task sees all rows."""
    parts = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part__", F.spark_partition_id()).withColumn("mono__", F.monotonically_increasing_id()))
    # a row a partition
    counts = parts.groupBy("part__").agg(F.count("*").alias("n__"), F.min("mono__").alias("first__"))
    before = counts.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before.drop("n__")), "part__").withColumn(name, F.col("mono__") - F.col("first__") + F.col("before__")).drop("part__", "mono__", "first__", "before__")


def _take(pairs: DataFrame, partner: Column, label: str, index: str = "idx") -> DataFrame:
    """Claims with the evidence of the row whose index is partner; pairs has `index`."""
    there = [c for c in EVIDENCE if c in pairs.columns]
    claims = pairs.drop(*there, "label").withColumn("partner", partner.cast("long"))
    theirs = pairs.select(F.col(index).cast("long").alias("partner"), *there)
    return claims.join(theirs, "partner").withColumn("label", F.lit(label))


def offset_pairs(pairs: DataFrame, offset: int = OFFSET, index: str = "idx", label: str = "NEG") -> DataFrame:
    """The evidence `offset` rows on, cyclically; offset 0, or a multiple of the rows, counts as one more. pairs has a dense index."""
    n = pairs.count()
    if n > 1 and offset % n == 0:
        offset += 1
    return _take(pairs, (F.col(index) + offset) % max(1, n), label, index)


def cyclic_pairs(pairs: DataFrame, index: str = "idx") -> DataFrame:
    return offset_pairs(pairs, 1, index)


def deranged_pairs(pairs: DataFrame, seed: int = 1337, index: str = "idx") -> DataFrame:
    """Rows in a seeded order get the next row's evidence, cyclically: one cycle, so with two rows or more nobody keeps their own."""
    order = dense_index(pairs.select(index).withColumn("turn__", portable_hash(seed, F.col(index))), [F.col("turn__"), F.col(index)], "at__").select(index, "at__")
    n = pairs.count()
    following = order.select(F.col(index).alias("partner__"), F.pmod(F.col("at__") - 1, F.lit(max(1, n))).alias("at__"))
    matched = order.join(following, "at__").select(index, "partner__")
    return _take(pairs.join(matched, index), F.col("partner__"), "NEG", index).drop("partner__")


def shuffled_pairs(pairs: DataFrame, seed: int = 1337, index: str = "idx") -> DataFrame:
    """As a plain shuffle: rows that met their own evidence are left out."""
    order = dense_index(pairs.select(index).withColumn("turn__", portable_hash(seed, F.col(index))), [F.col("turn__"), F.col(index)], "at__").select(F.col(index).alias("partner__"), F.col("at__").alias(index))
    return _take(pairs.join(order, index).filter(F.col("partner__") != F.col(index)), F.col("partner__"), "NEG", index).drop("partner__")


def _centroids(pairs: DataFrame) -> Column:
    return centroid(F.col("evidence_vecs").cast("array<array<double>>"))


def candidates(pairs: DataFrame, k: int = CANDIDATES, index: str = "idx", block: int = BLOCK, own: bool = True) -> DataFrame:
    """(index, other, sim, rank): the k evidence centroids most similar to each claim, ties to the smaller index. With own, a claim's own evidence holds its place."""
    claims = pairs.select(F.col(index).cast("long").alias("query"), unit(F.col("claim_vec").cast("array<double>")).alias("vector")).filter("vector is not null")
    others = pairs.select(F.col(index).cast("long").alias("point"), _centroids(pairs).alias("vector")).filter("vector is not null")
    found = greatest(claims, others, k + (not own), block)
    if not own:
        found = ranked(found.drop("rank").filter("query <> point"), k)
    return found.select(F.col("query").alias(index), F.col("point").alias("other"), "sim", "rank")


def _with_evidence(pairs: DataFrame) -> int:
    """The rows whose evidence has a centroid."""
    return pairs.filter(_centroids(pairs).isNotNull()).count()


def hard_mined_pairs(pairs: DataFrame, index: str = "idx", seed: int = 1337) -> DataFrame:
    """The evidence whose centroid is most similar to the claim, the claim's own left out; adds sim. Fewer than two rows with evidence: deranged, sim null. Claims without a vector have no row."""
    pairs = settled(pairs)
    if _with_evidence(pairs) < 2:
        return deranged_pairs(pairs, seed, index).withColumn("sim", F.lit(None).cast("double"))
    best = candidates(pairs, 1, index, own=False)
    return _take(pairs.join(best.select(index, F.col("other").alias("partner__"), "sim"), index), F.col("partner__"), "NEG", index).drop("partner__")


def mined_pairs(pairs: DataFrame, by_energy: bool = False, k: int = CANDIDATES, page_mismatch: bool = True, disjoint_ids: bool = True, rank: int = 8, index: str = "idx", seed: int = 1337) -> DataFrame:
    """Of the k most similar evidence sets (a claim's own holds its place, then goes), one that shares no page and no id with the claim's own.

    Where there is none, pages may meet, then ids too; a claim without candidates gets any row that has evidence, by hash.
    The first by similarity is taken or, by_energy, that of least energy. The guards are inert without evidence_ids. Adds
    mined_energy and relaxed (0 to 3). Fewer than two rows with evidence: deranged, both null.
    """
    pairs = settled(pairs)
    usable = _with_evidence(pairs)
    if usable < 2:
        return deranged_pairs(pairs, seed, index).withColumns({"mined_energy": F.lit(None).cast("double"), "relaxed": F.lit(None).cast("int")})
    near = candidates(pairs, k, index).filter(F.col(index) != F.col("other"))
    ids = F.col("evidence_ids") if "evidence_ids" in pairs.columns else F.lit(None).cast("array<string>")
    facts = pairs.select(F.col(index).cast("long").alias("i__"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), pages_of(ids).alias("pages"), F.col("claim_vec"), F.col("evidence_vecs"))
    mine = facts.select(F.col("i__").alias(index), F.col("ids").alias("own_ids"), F.col("pages").alias("own_pages"), "claim_vec")
    theirs = facts.select(F.col("i__").alias("other"), "ids", "pages", "evidence_vecs")
    both = near.join(mine, index).join(theirs, "other")
    pages_meet, ids_meet = F.arrays_overlap("own_pages", "pages"), F.arrays_overlap("own_ids", "ids")
    step = F.when((~pages_meet | F.lit(not page_mismatch)) & (~ids_meet | F.lit(not disjoint_ids)), 0).when(~ids_meet | F.lit(not disjoint_ids), 1).otherwise(2)
    rated = spectral(both.withColumn("relaxed", step).select(index, "other", "rank", "relaxed", "claim_vec", "evidence_vecs"), rank=rank)
    # energies equal to nine places are ties, which the nearer candidate wins
    key = F.struct("relaxed", *([F.round("energy", 9).alias("e")] if by_energy else []), F.col("rank").alias("r"))
    best = settled(rated.groupBy(index).agg(F.min_by(F.struct(F.col("other").alias("partner__"), F.col("energy").alias("mined_energy"), "relaxed"), key).alias("best")).select(index, "best.*"))
    bare = pairs.join(best.select(index), index, "left_anti").select(index, "claim_vec")
    if bare.limit(1).count():
        valid = dense_index(pairs.filter(_centroids(pairs).isNotNull()).select(F.col(index).alias("partner__"), "evidence_vecs"), [F.col("partner__")], "at__")
        given = bare.withColumn("at__", portable_hash(seed, F.col(index)) % usable).join(valid, "at__")
        rest = spectral(given.select(index, "partner__", "claim_vec", "evidence_vecs"), rank=rank)
        best = best.unionByName(rest.select(index, F.col("partner__").cast("long").alias("partner__"), F.col("energy").alias("mined_energy"), F.lit(3).alias("relaxed")))
    return _take(pairs.join(best, index), F.col("partner__"), LABELS["hardest_energy" if by_energy else "hard_mined_v2"], index).drop("partner__")


def mining_facts(mined: DataFrame, mode: str, k: int = CANDIDATES) -> DataFrame:
    """One row about a mined_pairs result: mode, n, top_candidates, and mean, least and greatest energy."""
    return mined.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.lit(k).alias("top_candidates"), F.avg("mined_energy").alias("mean_energy"), F.min("mined_energy").alias("min_energy"), F.max("mined_energy").alias("max_energy"))


def negatives(pairs: DataFrame, mode: str, seed: int = 1337, offset: int = OFFSET, index: str = "idx") -> DataFrame:
    """Dispatch by mode name."""
    makers = {
        "cyclic": lambda: cyclic_pairs(pairs, index),
        "offset": lambda: offset_pairs(pairs, offset, index),
        "deranged": lambda: deranged_pairs(pairs, seed, index),
        "permute": lambda: deranged_pairs(pairs, seed, index),
        "hard_mined": lambda: hard_mined_pairs(pairs, index, seed),
        "hard_mined_v2": lambda: mined_pairs(pairs, False, index=index, seed=seed),
        "hardest_energy": lambda: mined_pairs(pairs, True, index=index, seed=seed),
    }
    if mode not in makers:
        raise ValueError(f"unknown mode: {mode}; known: {MODES}")
    return makers[mode]()


def negative_energies(pairs: DataFrame, mode: str, seed: int = 1337, rank: int = 8, index: str = "idx") -> DataFrame:
    """(index, partner, energy) of re-paired claims; those without evidence are left out."""
    got = negatives(pairs, mode, seed, index=index).filter(F.size("evidence_vecs") > 0)
    return spectral(got.select(index, "partner", "claim_vec", "evidence_vecs"), rank=rank).select(index, "partner", "energy")


def hard_gap_per_claim(hard: DataFrame, easy: DataFrame, claim: str = "claim", energy: str = "energy", order: str = "idx") -> DataFrame:
    """One row: n, mean, std, p90 and positive fraction of easy minus hard energy by claim text; of a claim's several hard rows the last counts."""
    last = hard.groupBy(claim).agg(F.max_by(energy, order).alias("hard__"))
    gap = easy.select(claim, F.col(energy).alias("easy__")).join(last, claim).select((F.col("hard__") - F.col("easy__")).alias("gap"))
    gap = settled(gap)
    out = gap.agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("std"), F.avg(F.when(F.col("gap") > 0, 1.0).otherwise(0.0)).alias("positive_fraction"))
    return out.crossJoin(quantiles(gap, F.col("gap"), [0.9]).toDF("p90")).select("n", "mean", "std", "p90", "positive_fraction")
