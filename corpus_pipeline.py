"""A training corpus from documents: toxic ones out, near-duplicates out, personal data replaced, sources mixed, sequences packed.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. In every
stage nulls may stand in any column; a null text is one without words; texts are taken whole, however long; rows that are
repeated, or tied, are settled by ids, hashes of ids or all columns, so that reruns agree; an empty table gives an empty
one; columns beyond those of documents are kept, whatever their names (the last stage returns its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import mixing, packing, pii, shingles, toxicity
from attestor.llm.common import stored
from attestor.llm.queries import PII_KEY


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded toxic go. One without words, or without a label, is graded like any other; without labels of two grades all stay."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links of op3's fingerprints, by its range-join at two bits, and of five-word shingles at a similarity of 0.8 or more, as two bits only tell what is all but equal. Texts without words are copies of one another; the smallest doc_id of each group stays, a null one only where there is no other."""
    return shingles.shingle_dedup(docs, with_prints=True)


def personal_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with pseudonyms in their texts; null and empty texts stay as they are."""
    return pii.pseudonymise(docs, PII_KEY, found=None)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, a row for each time that one is taken; a null source is one of its own; documents without words aren't taken."""
    return mixing.mixed_documents(docs, F.array("source"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; a document without words has the end's id only. Repeated ids are documents of their own."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("near_duplicates", near_duplicates_out), ("pii", personal_data_replaced), ("mixing", sources_mixed), ("packing", packed)]

#: The stages train a model, follow links and tokenise; SQL expresses none of that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
