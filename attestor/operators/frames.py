"""Frames whose rows and partitions are settled, for steps that refer to them twice."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the checkpoint folder set by hand. Where neither is set, a session on one machine gets a folder of its own; on a cluster that raises, as other machines would not see it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        return current.get().rstrip("/")
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="attestor-")
    if not current.isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint in the shared folder.

    Range partitions are drawn from samples, and adaptive execution may merge them: a plan that is run twice may deal its
    rows out differently. What counts rows by partition and joins the counts back has to see one dealing.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def pieces(batches: Iterable[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `most` bytes, at least a row: what Python makes of a run is then bounded, however large Spark's batches are."""
    for b in batches:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for at in range(0, max(1, b.num_rows), step):
            yield b.slice(at, step)
