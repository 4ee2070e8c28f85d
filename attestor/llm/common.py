"""What the training-data operators share: the shared work folder and small text helpers."""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.operators.frames import shared_folder

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Of the rows that Spark hands to Python at a time, within batches_bounded().
BATCH_BYTES = 1 << 22


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession):
    """Within it, a finished query's shuffle files are removed at once instead of when the driver next collects garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def batches_bounded(spark: SparkSession):
    """Within it, a query sends Python batches of BATCH_BYTES or a row more, however long the rows are; Spark's own bound is 10,000 rows. It holds for what is written within, not for frames that are only built there."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions_kept(spark: SparkSession):
    """Within it, an aggregate leaves as many partitions as spark.sql.shuffle.partitions says, so that its output fits buckets of that number."""
    return _setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage is cut, the files outlive any executor."""
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Writes df to path in `buckets` hash buckets of keys and reads it back: later joins and aggregates on keys need no exchange of this side. df has to be partitioned by keys in that number, by an aggregate or by repartition(buckets, *keys)."""
    spark = df.sparkSession
    table = f"stored_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return _unnamed(spark, table)


def bucketed(spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """What stored_bucketed() has written to path, in this session or another."""
    table, by = f"stored_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return _unnamed(spark, table)


def _unnamed(spark: SparkSession, table: str) -> DataFrame:
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: the name goes, the files and out's plan stay
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def dropped(df: DataFrame) -> None:
    """Removes the files of a frame from stored() that nothing refers to any more."""
    files = df.inputFiles()
    if files:
        removed(df.sparkSession, files[0].rsplit("/", 1)[0])


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint. With spark.cleaner.referenceTracking.cleanCheckpoints Spark removes the files once the frame is no longer referenced; else they stay until the folder is emptied."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


def has_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def first_by_hash(rows: DataFrame, kind: str, count: int, key: str) -> DataFrame:
    """Of each kind, the `count` rows first by a hash of key, which no two rows share; all if it has no more. Kinds are few.

    The kinds are counted first, and only rows whose hash lies in the share of its range that should hold `count` rows,
    and some to spare, are ranked: however many rows a kind has, no task sees many more than `count` of them.
    """
    sizes = {r[kind]: r["n"] for r in rows.groupBy(kind).agg(F.count("*").alias("n")).collect()}
    return _ranked(_early(rows, kind, count, [key], sizes), kind, count, [key]) if sizes else rows


def different_by_hash(rows: DataFrame, kind: str, count: int, keys: Sequence[str], sizes: dict) -> DataFrame:
    """kind and keys of the `count` different rows of each kind that are first by a hash of keys; all if it has no more.

    sizes is kinds_of(rows, kind, keys). Rows alike in kind and keys are one: they are merged before they are shuffled,
    so that neither a key nor a row on any share of the table sends its copies to one task.
    """
    rows = rows.select(kind, *keys)
    if not sizes:
        return rows
    # the sketch's error is given room
    near = _early(rows, kind, count, keys, {k: max(1, d) / 1.3 for k, (_, d) in sizes.items()})
    return _ranked(near.distinct(), kind, count, keys)


def kinds_of(rows: DataFrame, kind: str, keys: Sequence[str]) -> dict:
    """Of each kind the number of rows, and about how many differ in keys (a sketch, off by 5 % as a rule)."""
    found = rows.groupBy(kind).agg(F.count("*").alias("n"), F.approx_count_distinct(_turn(keys), 0.05).alias("d")).collect()
    return {r[kind]: (r["n"], r["d"]) for r in found}


def _turn(keys: Sequence[str]):
    return F.shiftrightunsigned(F.xxhash64(*keys), 2)


def _early(rows: DataFrame, kind: str, count: int, keys: Sequence[str], sizes: dict) -> DataFrame:
    span = float(1 << 62)
    limits = [(k, int(span * min(1.0, (count + 8 * count**0.5 + 50) / n))) for k, n in sizes.items()]
    limit = functools.reduce(lambda out, x: out.when(F.col(kind) == x[0], x[1]), limits[1:], F.when(F.col(kind) == limits[0][0], limits[0][1]))
    return rows.withColumn("turn__", _turn(keys)).filter(F.col("turn__") <= limit)


def _ranked(rows: DataFrame, kind: str, count: int, keys: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(kind).orderBy("turn__", *keys))
    return rows.withColumn("rank__", rank).filter(F.col("rank__") <= count).drop("turn__", "rank__")
