"""Sentence support: how far each sentence of a summary is backed by the paragraphs of its document."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.text import entailment_key, paragraphs, sentences, text_hash
from attestor.operators.evidence import blocked, energies, top_products
from attestor.operators.frames import settled

RANK = 32


def hashed(text: str) -> list[float]:
    """A deterministic 64-dimensional unit vector of hashed words, where no embedding model is at hand."""
    import numpy as np

    v = np.zeros(64)
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        v[h % 64] += 1 if h >> 31 else -1
    length = np.linalg.norm(v)
    return (v / length if length else v).tolist()


def hashing_model():
    """The stub as a factory of cache.build_vectors; a real model loads its weights here and takes the texts as a batch."""
    return lambda texts: [hashed(t) for t in texts]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_vector(c: pd.Series) -> pd.Series:
    return c.map(lambda text: None if text is None else hashed(text))


def embed(texts: DataFrame, store: DataFrame | None = None, model: str = "hashed", dim: int = 64, column: str = "text") -> DataFrame:
    """texts with vec: from a store (text_hash, model, dim, vec) where it has a vector of the right length, else computed. Each different text is embedded once."""
    distinct = texts.select(F.col(column)).filter(F.col(column).isNotNull()).distinct()
    if store is None:
        done = distinct.withColumn("vec", hashed_vector(F.col(column)))
    else:
        kept = store.filter((F.col("model") == model) & (F.size("vec") == dim)).select("text_hash", F.col("vec").cast("array<double>").alias("stored"))
        done = distinct.withColumn("text_hash", text_hash(F.col(column))).join(kept, "text_hash", "left")
        done = done.withColumn("vec", F.when(F.col("stored").isNotNull(), F.col("stored")).otherwise(hashed_vector(F.col(column)))).select(column, "vec")
    return texts.join(done, column, "left")


def _part(df: DataFrame, parts: Column, key: str, name: str) -> DataFrame:
    return df.select(key, F.posexplode(parts).alias(f"{name}_at", name))


def _entailed(tops: DataFrame, s: DataFrame, p: DataFrame, key: str, top_k: int, entailment: DataFrame) -> DataFrame:
    """key, sentence_at and the greatest, mean and least probability over the top_k paragraphs; only those pairs meet their texts."""
    pairs = tops.select(key, "sentence_at", F.explode(F.slice("tops", 1, top_k)).alias("top")).select(key, "sentence_at", F.col("top.at").alias("paragraph_at"))
    pairs = pairs.join(s.select(key, "sentence_at", "sentence"), [key, "sentence_at"]).join(p.select(key, F.col("paragraph_at").cast("long").alias("paragraph_at"), "paragraph"), [key, "paragraph_at"])
    rated = pairs.withColumn("key__", entailment_key(F.col("paragraph"), F.col("sentence"))).join(entailment.select(F.col("key").alias("key__"), "entailment_prob"), "key__", "left")
    prob = F.coalesce("entailment_prob", F.lit(0.0))
    return rated.groupBy(key, "sentence_at").agg(F.max(prob).alias("entailment_max"), F.avg(prob).alias("entailment_mean"), F.min(prob).alias("entailment_min"))


def sentence_support(df: DataFrame, key: str = "id", summary: str = "summary", document: str = "document", top_k: int = 3, entailment: DataFrame | None = None, store: DataFrame | None = None, with_energy: bool = True, covered: float = 0.3, rank: int = RANK) -> DataFrame:
    """A row a sentence: key, sentence_at, sim_top1, sim_margin, coverage, energy, and the mean, greatest and least entailment over the top_k paragraphs.

    Similarities are plain dot products of the vectors as they are stored. entailment: key (entailment_key of paragraph
    and sentence), entailment_prob; pairs it lacks count as 0. Without with_energy, energy is 0. Products are those of
    blocks of sentences and paragraphs, and a document's paragraphs are decomposed once for a block of sentences, so no row
    holds a document's vectors, however long it is. keys differ from document to document.
    """
    s = embed(_part(df, sentences(F.col(summary)), key, "sentence"), store, column="sentence").withColumnRenamed("vec", "sentence_vec")
    p = embed(_part(df, paragraphs(F.col(document)), key, "paragraph"), store, column="paragraph").withColumnRenamed("vec", "paragraph_vec")
    s, p = settled(s), settled(p)
    asked, held = blocked(s, key, "sentence_at", "sentence_vec"), settled(blocked(p, key, "paragraph_at", "paragraph_vec"))
    tops = top_products(asked, held, key, max(top_k, 2), covered).withColumnRenamed("query_at", "sentence_at")
    sim = lambda i: F.get("tops", F.lit(i))["sim"]
    out = tops.select(
        key,
        "sentence_at",
        sim(0).alias("sim_top1"),
        F.coalesce(sim(0) - sim(1), F.lit(0.0)).alias("sim_margin"),
        (F.col("above") / F.col("n")).alias("coverage"),
        *(F.lit(0.0).alias(f"entailment_{x}") for x in ("max", "mean", "min")),
        F.col("n").alias("paragraph_count"),
    )
    if entailment is not None:
        out = out.drop("entailment_max", "entailment_mean", "entailment_min").join(_entailed(tops, s, p, key, top_k, entailment), [key, "sentence_at"])
    if not with_energy:
        return out.withColumn("energy", F.lit(0.0))
    return out.join(energies(asked, held, key, rank).withColumnRenamed("query_at", "sentence_at"), [key, "sentence_at"])


def support_features(rows: DataFrame, key: str = "id", threshold: float = 0.5) -> DataFrame:
    """A row a summary: counts, and entailment, similarity, coverage and energy over its sentences."""
    e = F.col("energy")
    return rows.groupBy(key).agg(
        F.count("*").alias("sentence_count"),
        F.max("paragraph_count").alias("paragraph_count"),
        F.max("entailment_max").alias("max_entailment"),
        F.avg("entailment_mean").alias("mean_entailment"),
        F.min("entailment_min").alias("min_entailment"),
        F.avg("sim_top1").alias("mean_sim_top1"),
        F.min("sim_top1").alias("min_sim_top1"),
        F.avg("sim_margin").alias("mean_sim_margin"),
        F.min("sim_margin").alias("min_sim_margin"),
        F.avg("coverage").alias("mean_coverage"),
        F.min("coverage").alias("min_coverage"),
        F.max(e).alias("max_energy"),
        F.avg(e).alias("mean_energy"),
        F.min(e).alias("min_energy"),
        F.count(F.when(e > threshold, 1)).alias("high_energy_count"),
        F.percentile(e, F.lit(0.9)).alias("p90_energy"),
        F.avg(F.when(e > 0.5, 1.0).otherwise(0.0)).alias("frac_above_threshold"),
    )


def summary_diagnostics(df: DataFrame, key: str = "id", summary: str = "summary", document: str = "document", rank: int = RANK) -> DataFrame:
    """Support features without entailment, with the characters of summary and document."""
    rows = support_features(sentence_support(df, key, summary, document, rank=rank), key).drop("max_entailment", "mean_entailment", "min_entailment")
    return rows.join(df.select(key, F.length(summary).alias("summary_chars"), F.length(document).alias("document_chars")), key)


def summary_axes(features: DataFrame) -> DataFrame:
    """features with combined = max_energy * (1 - mean_coverage)."""
    return features.withColumn("combined", F.col("max_energy") * (1 - F.col("mean_coverage")))


def effect_size(df: DataFrame, axes: list[str], positive: Column) -> DataFrame:
    """axis, mean_pos, mean_neg, effect: the difference of class means over the pooled standard deviation (0 if that is under 1e-12)."""
    one = []
    for a in axes:
        p, n = F.when(positive, F.col(a)), F.when(~positive, F.col(a))
        pooled = F.sqrt((F.var_pop(p) + F.var_pop(n)) / 2)
        one.append(F.struct(F.lit(a).alias("axis"), F.avg(p).alias("mean_pos"), F.avg(n).alias("mean_neg"), F.when(pooled < 1e-12, 0.0).otherwise(F.try_divide(F.avg(p) - F.avg(n), pooled)).alias("effect")))
    return df.agg(F.array(*one).alias("x")).select(F.explode("x").alias("x")).select("x.*")
