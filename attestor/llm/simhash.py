"""SimHash near-duplicates, joined through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their bit counts (each 0, 1 or 2, packed again
into 64 bits) is the embedding. Flipping one bit moves one count by one, so the Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints. Fingerprints within Hamming distance 2 therefore have a lattice
point at Manhattan distance at most 1 from both: every fingerprint is entered in the grid cell of its own vector and in
those one step away, and only fingerprints that share a cell with another one go on.

Those are verified exactly in Hamming space by the same midpoint argument: two fingerprints differ in at most 2 bits if
and only if some 64-bit word differs from both in at most 1. Members of one midpoint are all linked to the least of
them, so links grow with the rows of a cell and never with their square, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import checkpointed, has_columns, stored, text_bytes
from attestor.llm.components import components

SEED = 42
_LANES = np.arange(8, dtype=np.int64) * 256
#: For each byte value, its bits from least to most significant.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_ONE = np.uint64(1)


def fingerprint(text: bytes | None, width: int = 3, seed: int = SEED) -> int:
    """The unsigned fingerprint of one UTF-8 text; 0 for null and for texts without a word."""
    words = text.lower().split() if text else []  # bytes.lower() changes A-Z only, split() cuts at ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)), strict=False)]
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((lanes + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (counts.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in b.column("bytes")), dtype=np.uint64, count=b.num_rows)
        yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(prints.view(np.int64))], names=["doc_id", "th", "fp"])


def popcount_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, cell) for the cell of each fingerprint's embedding and all cells at Manhattan distance 1."""
    low = np.uint64(0x5555555555555555)
    v = (fps & low) + ((fps >> _ONE) & low)
    out_f, out_c = [fps], [v]
    for i in range(32):
        shift = np.uint64(2 * i)
        count = (v >> shift) & np.uint64(3)
        up, down = count < 2, count > 0
        out_f += [fps[up], fps[down]]
        out_c += [v[up] + (_ONE << shift), v[down] - (_ONE << shift)]
    return np.concatenate(out_f), np.concatenate(out_c)


def hamming_midpoints(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, word) for the fingerprint itself and all words one bit away."""
    out = [fps, *(fps ^ (_ONE << np.uint64(i)) for i in range(64))]
    return np.tile(fps, 65), np.concatenate(out)


def _spread(kind):
    def run(batches):
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                f, c = kind(fps[at : at + 4096])
                yield pa.record_batch([pa.array(f.view(np.int64)), pa.array(c.view(np.int64))], names=["fp", "cell"])

    return run


def _shared(rows: DataFrame) -> DataFrame:
    """The cells that hold two or more different fingerprints, with the least."""
    return rows.groupBy("cell").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least <> most").select("cell", "least")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp` (long) that connect exactly those within Hamming distance 2."""
    # small rows become many: dealt out, or a few tasks would do all of it (by fp itself, Spark would leave them as they are)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = fps.repartition(parts, F.xxhash64("fp")).mapInArrow(_spread(popcount_cells), "fp long, cell long")
    near = stored(cells.join(_shared(cells), "cell", "left_semi").select("fp").distinct(), "near").repartition(parts, F.xxhash64("fp"))
    mids = near.mapInArrow(_spread(hamming_midpoints), "fp long, cell long")
    return mids.join(_shared(mids), "cell").filter("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as doc_id, th (a hash of the text), fp; and of each fp its root and the component's smallest doc_id."""
    has_columns(docs, ["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), text_bytes().alias("bytes")).mapInArrow(_fingerprints, f"doc_id {kind}, th long, fp long")
    rows = stored(rows, "simhash")
    by_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    return rows, named_components(by_fp, links(by_fp.select("fp")))


def named_components(by_fp: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, root and component_id (the component's smallest doc_id) from fp, first_doc and the edges (u, v) between them."""
    roots = components(edges)
    joined = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return checkpointed(joined.select("fp", "root").join(named, "root"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most 2 bits).

    One row per input row. Null, empty and all-space texts have fingerprint zero and are linked as any other; repeated
    doc_ids keep their rows; a null doc_id gets its component but never names one unless no other id is in it; other
    columns are ignored; an empty table gives no rows.
    """
    rows, classes = classified(docs)
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (of several such rows, the one whose columns hash least); columns as they are, whatever their names. Nulls, empty and long texts, repeated rows and empty tables are as in simhash_groups()."""
    return first_of_each(docs, *classified(docs))


def first_rows(rows: DataFrame) -> DataFrame:
    """Of each fp of rows (doc_id, th, fp) the first row as `one`: the smallest doc_id, a null one only where there is no other, and its least th."""
    return rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("one"))


def first_of_each(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """docs with the one row of each root, from rows (doc_id, th, fp) and classes (fp, root); a fp that classes lack is its own root."""
    # copies are merged before they meet anything
    roots = first_rows(rows).join(classes.select("fp", "root"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
    first = roots.agg(F.min("one").alias("one")).select(F.col("one.doc_id").alias("kept_id"), F.col("one.th").alias("kept_th"))
    # the texts move once, by document
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    joined = whole.join(first, whole["id"].eqNullSafe(first["kept_id"]) & (whole["th"] == first["kept_th"]))
    # rows with one id and text: one by a hash of all their columns that have one, so that reruns agree
    rest = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rank = F.row_number().over(Window.partitionBy("kept_id", "kept_th").orderBy(F.xxhash64(*(F.col(f"row.`{c}`") for c in rest))))
    return joined.withColumn("rank", rank).filter("rank = 1").select("row.*")
