"""Scans. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: the nested row of a scored dump
SCORED = """
meta struct<run_id: string, split: string, policy: string>, claim string, evidence array<string>,
difficulty struct<value: double, bucket: string>, effectiveness double,
embedding struct<claim_dim: int, evidence_count: int, embedding_backend: string>,
decision struct<verdict: string, trace: struct<tau_accept: double, tau_review: double, pr_threshold: double, sensitivity_threshold: double, margin_band: double>>,
stability struct<probe_variance: double>, label int,
energy struct<value: double, explained: double, identity_error: double, config: struct<evidence_topk: int, rank_cap: int>, geometry: struct<
spectral: struct<sigma1_ratio: double, sigma2_ratio: double, spectral_sum: double, participation_ratio: double, effective_rank: int>,
alignment: struct<alignment_to_sigma1: double>, similarity: struct<sim_top1: double, sim_top2: double, sim_margin: double>,
robustness: struct<sensitivity: double>, support: struct<effective_rank: int, used_count: int, entropy_rank: double>>>,
is_stable boolean
"""
PAIRS = "id string, claim string, evidence array<string>, label int"
EVIDENCE_SETS = "id string, claim string, label string, evidence array<struct<content: array<string>, context: map<string, array<string>>>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line (from 1): the lines of text files, blank ones too. Lines are counted by byte range, and a range adds the lines of its file's earlier ranges; no task reads a whole file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    ranges = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("file", "start", (before - F.col("first") + 1).alias("shift"))
    return rows.join(ranges, ["file", "start"]).select("value", "file", (F.col("at") + F.col("shift")).alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One JSON object a line; blank lines are skipped. With strict, a bad line fails the query with its file, line and text; without, it is a row of nulls."""
    full = f"{schema.strip().rstrip(',')}, _corrupt_record string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    if not strict:
        return spark.read.schema(full).options(**options).json(path).drop("_corrupt_record")
    lines = numbered_lines(spark, path).filter(F.trim(F.regexp_replace("value", r"\s", " ")) != "").withColumn("row", F.from_json("value", full, options))
    bad = F.concat(F.lit("bad JSON in "), F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), F.substring("value", 1, 200))
    wrong = F.col("row").isNull() | F.col("row._corrupt_record").isNotNull()
    return lines.filter(F.when(wrong, F.raise_error(bad).cast("boolean")).otherwise(True)).select("row.*").drop("_corrupt_record")


def evidence_sets(spark: SparkSession, path: str) -> DataFrame:
    """Claims with sets of evidence; a lone set is read as a list of one."""
    raw = spark.read.schema("id string, claim string, label string, evidence string").json(path)
    kind = "struct<content: array<string>, context: map<string, array<string>>>"
    sets = F.when(F.col("evidence").startswith("{"), F.array(F.from_json("evidence", kind))).otherwise(F.from_json("evidence", f"array<{kind}>"))
    return raw.withColumn("evidence", sets)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"').csv(path)


def scored(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, SCORED)


def flat_scored(rows: DataFrame) -> DataFrame:
    """The nested scored row as plain columns; missing axes are null."""
    g = "energy.geometry"
    return rows.select(
        F.col("meta.run_id").alias("run_id"), F.col("meta.split").alias("split"), F.col("meta.policy").alias("policy_name"), "claim", "evidence", "label", "effectiveness",
        F.col("difficulty.value").alias("difficulty"), F.col("decision.verdict").alias("verdict"), F.col("decision.trace.tau_accept").alias("tau_accept"), F.col("decision.trace.tau_review").alias("tau_review"),
        F.col("decision.trace.margin_band").alias("margin_band"), F.col("energy.value").alias("energy"), F.col("energy.explained").alias("explained"), F.col("energy.identity_error").alias("identity_error"),
        F.col(f"{g}.spectral.participation_ratio").alias("participation_ratio"), F.col(f"{g}.spectral.effective_rank").alias("effective_rank"), F.col(f"{g}.alignment.alignment_to_sigma1").alias("alignment"),
        F.col(f"{g}.similarity.sim_top1").alias("sim_top1"), F.col(f"{g}.similarity.sim_top2").alias("sim_top2"), F.col(f"{g}.similarity.sim_margin").alias("sim_margin"), F.col(f"{g}.robustness.sensitivity").alias("sensitivity"),
        F.col(f"{g}.support.entropy_rank").alias("entropy_rank"), "is_stable",
    )


def runs(spark: SparkSession, path: str, schema: str = SCORED) -> DataFrame:
    """All scored dumps under path, as pos_<mode>.jsonl and neg_<mode>.jsonl, with neg_mode and split from their names; modes without both are left out."""
    rows = json_lines(spark, f"{path}/*.jsonl", schema).withColumn("file__", F.regexp_extract(F.input_file_name(), r"([^/]*)\.jsonl$", 1))
    rows = rows.withColumn("split", F.regexp_extract("file__", "^(pos|neg)_", 1)).withColumn("neg_mode", F.regexp_replace("file__", "^(pos|neg)_", "")).filter("split <> ''")
    whole = rows.groupBy("neg_mode").agg(F.count_distinct("split").alias("n")).filter("n = 2").select("neg_mode")
    return rows.join(whole, "neg_mode").drop("file__")


def stored_vectors(texts: DataFrame, store: DataFrame, model: str, dim: int, column: str = "text") -> DataFrame:
    """texts with vec; null, a miss, where the store has none for the model or one of another length."""
    from attestor.functions.text import text_hash

    good = store.filter((F.col("model") == model) & (F.size("vec") == dim)).select("text_hash", "vec")
    return texts.withColumn("text_hash", text_hash(F.col(column))).join(good, "text_hash", "left").drop("text_hash")


def entailment_scores(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """pairs (premise, hypothesis) with entailment_prob, null where the store (key, entailment_prob) lacks it."""
    from attestor.functions.text import entailment_key

    return pairs.withColumn("key", entailment_key(F.col("premise"), F.col("hypothesis"))).join(store.select("key", "entailment_prob"), "key", "left").drop("key")
