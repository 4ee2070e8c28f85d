"""Near-duplicates by the Jaccard similarity of their word shingles, verified exactly.

A document is the set of its 5-word sequences; the same sets are one node. Candidates come from MinHash: 350 least
hashes are read as 50 bands of seven, and documents equal in a band share its cell; a pair of similarity 0.8 shares none
with a probability of (1 - 0.8 ** 7) ** 50, under 0.00001. Whatever is linked has been compared set with set.

Fingerprints of 64 bits can't do this job: at a similarity of 0.8 two of them differ in 9.7 bits on average and often
in 15, and the bit counts of their segments lie as far apart for unrelated texts. The embedding is therefore one of the
set itself: its shingles are counted by 256 segments of their hash. One shingle more or less moves one count by one, so
the Manhattan distance of two such vectors never exceeds the number of shingles that the sets don't share, of which a
pair of similarity s has at most (1 - s) / (1 + s) of both sizes. Pairs over that bound are dropped without a look at
their sets.

Of each cell, the members are compared with at most three of them first. Members that are linked by then, over whichever
cell, need no comparison. What is still apart in a cell, but for the largest class in it, is compared by the embedding
with the whole cell, in blocks of both, and only pairs within the bound are put out. So large groups of close copies cost
comparisons by their rows, and no link of a cell is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import simhash
from attestor.llm.common import batches_bounded, has_columns, stored, text_bytes
from attestor.llm.components import components
from attestor.llm.simhash import fingerprint, first_of_each, first_rows

WIDTH, LEAST, BANDS, ROWS, SEED = 5, 0.8, 50, 7, 42
MASKS = (0, 0x5A5A5A5A5A5A5A5A, -1)
#: Segments of the embedding; rows of a block of members that are apart, and of a block of the whole cell.
SEGMENTS, APART, BLOCK = 256, 1024, 4096
_MUL = np.uint64(0xD6E8FEB86659FD93)
_ODD, _XOR = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_ODD |= np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of the different shingles of one UTF-8 text; of all its words if it has fewer than width, none if it has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    at = np.array([digest(w) for w in words], dtype=np.uint64)
    n = max(1, len(at) - width + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(min(width, len(at))):
        grams = _mixed(grams + at[i : i + n])
    return np.unique(grams)


def cells(grams: np.ndarray) -> np.ndarray:
    """The cell of each band; none for an empty set."""
    if not len(grams):
        return np.empty(0, np.uint64)
    least = np.full(len(_ODD), 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 256):
        least = np.minimum(least, ((grams[at : at + 256] ^ _XOR) * _ODD).min(axis=1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * _MUL + column)
    return out


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32), pa.array(flat))


def _signed(width: int, with_prints: bool):
    def run(batches):
        for b in batches:
            sets, found, prints = [], [], []
            for x in b.column("bytes"):
                text = x.as_py()
                grams = shingles(text, width)
                sets.append(xxhash.xxh3_64_intdigest(grams.tobytes()) if len(grams) else 0)
                found.append(cells(grams))
                prints.append(fingerprint(text) if with_prints else 0)
            fp, bits = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sets, prints))
            yield pa.record_batch([b.column("doc_id"), b.column("th"), fp, _longs(found), bits], names=["doc_id", "th", "fp", "cells", "simhash"])

    return run


def segment_counts(grams: np.ndarray) -> bytes:
    """The shingles in each segment of the hash, 255 at most: what is cut off only shortens distances."""
    at = (grams >> np.uint64(64 - SEGMENTS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=SEGMENTS), 255).astype(np.uint8).tobytes()


def bound(sizes: np.ndarray, least: float) -> np.ndarray:
    """The most shingles that two sets of these sizes together may have but not share."""
    return (1 - least) / (1 + least) * sizes + 1e-9


def _sets(width: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [shingles(x.as_py(), width) for x in part.column("bytes")]
                yield pa.record_batch([part.column("fp"), _longs(sets), pa.array([len(x) for x in sets], pa.int32()), pa.array([segment_counts(x) for x in sets], pa.binary())], names=["fp", "grams", "n", "counts"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets have a similarity of at least `least`."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sizes = sets.select("fp", "n")
    for end in ("u", "v"):
        pairs = pairs.join(sizes.select(F.col("fp").alias(end), F.col("n").alias(f"n_{end}")), end)
    # sets too different in size have no such similarity: theirs need not be moved
    pairs = pairs.filter(F.least("n_u", "n_v") / F.greatest("n_u", "n_v") >= least).select("u", "v")
    left = pairs.join(sets.select(F.col("fp").alias("u"), F.col("grams").alias("a")), "u")
    both = left.join(sets.select(F.col("fp").alias("v"), F.col("grams").alias("b")), "v")
    common = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("n"), (F.size("a") + F.size("b")).alias("total"))
    return stored(common.filter(F.col("n") / (F.col("total") - F.col("n")) >= least).select("u", "v"), "alike")


def _near(least: float):
    """Of rows sorted by group (cell, i, j): pairs of one that is apart and one of the cell, of other roots, within the bound. A group may run over several batches; its rows are bounded by the blocks."""

    def pairs(held: list[pa.Table]) -> pa.RecordBatch:
        group = pa.concat_tables(held)
        fp, root, n, apart = (group[c].to_numpy() for c in ("fp", "root", "n", "apart"))
        counts = np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint8).reshape(-1, SEGMENTS).astype(np.int16)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        whole = np.flatnonzero(apart == 0)
        for x in np.flatnonzero(apart):
            # pairs of two that are apart come up twice and count once
            y = whole[(root[whole] != root[x]) & (np.minimum(n[whole], n[x]) >= least * np.maximum(n[whole], n[x]))]
            y = y[np.abs(counts[y] - counts[x]).sum(axis=1) <= bound(n[y] + n[x], least)]
            out.append((np.full(len(y), fp[x]), fp[y]))
        return pa.record_batch([pa.array(np.concatenate(part)) for part in zip(*out, strict=True)], names=["u", "v"])

    def run(batches):
        held: list[pa.Table] = []
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            ids = np.stack([t[c].to_numpy() for c in ("cell", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(ids)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if held and tuple(ids[low]) != key:
                    yield pairs(held)
                    held = []
                key = tuple(ids[low])
                held.append(t.slice(low, high - low))
        if held:
            yield pairs(held)

    return run


def links(shared: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Edges (u, v) that connect exactly those of shared (fp, cell) which share a cell and whose sets (fp, grams, n, counts) are alike."""
    # prints are hashes: the least under each mask is a member by chance, and mostly the same one in all cells of a group
    some = shared.groupBy("cell").agg(F.array_distinct(F.array(*(F.min(F.col("fp").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)) for m in MASKS))).alias("some"))
    pairs = shared.join(some.select("cell", F.explode("some").alias("v")), "cell").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    roots = components(_verified(pairs, sets, least)).withColumnRenamed("node", "fp")
    now = shared.join(roots, "fp", "left").select("cell", "fp", F.coalesce("root", "fp").alias("root"))
    # of each cell that holds several classes: the largest class, and the rows in and out of it
    classes = now.groupBy("cell", "root").agg(F.count("*").alias("k"))
    split = classes.groupBy("cell").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most")).filter(F.col("all") > F.col("most"))
    blocks = lambda rows, size: F.ceil(rows / size).cast("int")
    split = split.select("cell", "main", blocks(F.col("all") - F.col("most"), APART).alias("a"), blocks(F.col("all"), BLOCK).alias("b"))
    now = stored(now.join(split, "cell"), "split")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    apart = now.filter(F.col("root") != F.col("main")).select("cell", "fp", "root", F.lit(1).alias("apart"), own("a").alias("i"), every("b").alias("j"))
    whole = now.select("cell", "fp", "root", F.lit(0).alias("apart"), every("a").alias("i"), own("b").alias("j"))
    rows = apart.unionByName(whole).join(sets.select("fp", "n", "counts"), "fp").select("cell", "i", "j", "fp", "root", "apart", "n", "counts")
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    rest = _verified(grouped.mapInArrow(_near(least), "u long, v long"), sets, least)
    return rest.unionByName(roots.filter("fp <> root").select(F.col("fp").alias("u"), F.col("root").alias("v")))


def _print_links(rows: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the sets (fp of rows) of texts whose fingerprints (simhash of rows) are the same or linked by op3's range-join."""
    # of each fingerprint the least set stands for all: links between fingerprints become links between those
    least = stored(rows.groupBy("simhash").agg(F.min("fp").alias("least"), F.max("fp").alias("most")), "prints")
    several = least.filter("least <> most").select("simhash", F.col("least").alias("v"))
    same = rows.select("simhash", F.col("fp").alias("u")).distinct().join(several, "simhash").filter("u <> v").select("u", "v")
    near = simhash.links(least.select(F.col("simhash").alias("fp")))
    for end in ("u", "v"):
        near = near.join(least.select(F.col("simhash").alias(end), F.col("least").alias(f"set_{end}")), end)
    return same.unionByName(near.select(F.col("set_u").alias("u"), F.col("set_v").alias("v")).filter("u <> v"))


def shingle_dedup(docs: DataFrame, width: int = WIDTH, least: float = LEAST, with_prints: bool = False) -> DataFrame:
    """docs with one row of each component of documents linked at a similarity of at least `least`, that of the smallest doc_id (of several such rows, one); columns as they are.

    Null, empty and all-space texts are copies of one another; texts are taken whole, however long. A null doc_id comes
    after all others; of rows with one doc_id and text, that whose columns hash least stays. Columns may have any names;
    an empty table gives no rows. With with_prints, op3's links (fingerprints at two bits, by its range-join) count too.
    """
    has_columns(docs, ["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = [F.col("doc_id"), F.xxhash64("text").alias("th"), text_bytes().alias("bytes")]
    with batches_bounded(docs.sparkSession):
        rows = stored(docs.select(*key).mapInArrow(_signed(width, with_prints), f"doc_id {kind}, th long, fp long, cells array<long>, simhash long"), "signed")
    # the cells of a set are a function of it
    placed = rows.groupBy("fp").agg(F.first("cells").alias("cells")).select("fp", F.explode("cells").alias("cell"))
    crowded = placed.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("cell")
    shared = stored(placed.join(crowded, "cell", "left_semi"), "shared")
    one = first_rows(rows).join(shared.select("fp").distinct(), "fp", "left_semi").select("fp", F.col("one.doc_id").alias("id"), F.col("one.th").alias("t"))
    texts = docs.select(*key)
    texts = texts.join(one, texts["doc_id"].eqNullSafe(one["id"]) & (texts["th"] == one["t"])).select("fp", "bytes")
    with batches_bounded(docs.sparkSession):
        sets = stored(texts.mapInArrow(_sets(width), "fp long, grams array<long>, n int, counts binary").dropDuplicates(["fp"]), "sets")
    edges = links(shared, sets, least)
    if with_prints:
        edges = edges.unionByName(_print_links(rows))
    return first_of_each(docs, rows, components(edges).withColumnRenamed("node", "fp"))
