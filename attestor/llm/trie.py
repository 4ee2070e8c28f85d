"""The trie of conversation prefixes, by collapsing whole sequences.

Turns are range-partitioned by conversation and turn and numbered by partition, so that one long conversation is shared
out like any other rows. From then on a turn is two 64-bit hashes and a length. A prefix's key is its depth and the xor of
its turns' hashes, each hashed with its place: a running xor, which partitions continue from one another's totals.

Identical conversations are collapsed into one weighted sequence with the list of those that end there, and only its
smallest conversation goes on. Sequences that an anti-join doesn't find among proper prefixes are leaves. The rest follows
from sums over weighted prefixes without walking the tree: a sequence owns the nodes whose smallest member it is, which
are the end of its path, so what a subtree saves is the weighted length below each of its sequences less what they own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import has_columns, stored

#: A conversation begins with up to HEADS - 1 turns of the first conversation of its hundred.
HUNDRED, HEADS = 100, 6
KEY = ["depth", "x1", "x2"]
_HEAD, _ROOT = -1, -2  # parts before those of a conversation's own turns


def head_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def _before(column: str, how=F.sum) -> Column:
    """how over the conversation's earlier parts; 0 in its first."""
    return F.coalesce(how(column).over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, at (numbers that rise by 1 within a part), h1, h2, chars: the turns in order."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", filled("role"), filled("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    hashed = lambda seed: F.xxhash64(F.lit(seed), "role", "text")
    return stored(dealt.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), hashed(1).alias("h1"), hashed(2).alias("h2"), F.length("text").cast("long").alias("chars")), "turns")


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, one row each; conv_id, part, depth, s1, s2, chars: their rebuilt turns, s1 and s2 hashed with the place)."""
    rows = _numbered(conversations)
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.select("conv_id", "part", (_before("n") - F.col("first") + 1).alias("from"))
    place = F.col("at") + F.col("from")
    heads = rows.filter(F.col("conv_id") % HUNDRED == 0).join(parts, ["conv_id", "part"]).filter(place < HEADS)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "h1", "h2", "chars"))).alias("head"))
    named = parts.select("conv_id").distinct().withColumns({"base": F.col("conv_id") - F.col("conv_id") % HUNDRED, "skipped": head_turns(F.col("conv_id"))})
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("skipped"))
    convs = stored(named.join(heads, "base", "left").select("conv_id", "skipped", head.alias("head")), "conversations")
    moved = parts.join(convs.select("conv_id", "skipped", F.size("head").alias("taken")), "conv_id")
    own = rows.join(moved, ["conv_id", "part"]).filter(place > F.col("skipped")).select("conv_id", "part", (place - F.col("skipped") + F.col("taken")).alias("depth"), "h1", "h2", "chars")
    taken = convs.select("conv_id", F.lit(_HEAD).alias("part"), F.posexplode("head")).select("conv_id", "part", (F.col("pos") + 1).cast("long").alias("depth"), "col.h1", "col.h2", "col.chars")
    hashed = lambda seed: F.xxhash64(F.lit(seed), "depth", "h1", "h2")
    turns = own.unionByName(taken).select("conv_id", "part", "depth", hashed(3).alias("s1"), hashed(4).alias("s2"), "chars")
    return convs.select("conv_id"), stored(turns, "rebuilt")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members in order of key and id to comma-joined pieces: a piece for each key of a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy() for k in KEY])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        ids = b.column("conv_id")
        texts = ids.cast(pa.string()).to_pylist()
        ends = [*starts[1:].tolist(), b.num_rows]
        at = pa.array(starts)
        yield pa.record_batch([*(b.column(k).take(at) for k in KEY), ids.take(at), pa.array([",".join(texts[i:j]) for i, j in zip(starts.tolist(), ends, strict=True)])], names=[*KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of key and first id to one digest a key; only the hash's state is held."""
    key, state, schema = None, None, pa.schema([*((k, pa.int64()) for k in KEY), ("ends_sha256", pa.string())])
    for b in batches:
        done = []
        for *now, ids in zip(*(b.column(k).to_pylist() for k in (*KEY, "ids")), strict=True):
            if now == key:
                state.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, state.hexdigest()))
            key, state = now, hashlib.sha256(ids.encode())
        if done:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
    if key:
        yield pa.record_batch([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), schema.types, strict=True)], schema=schema)


def end_digests(members: DataFrame) -> DataFrame:
    """KEY and ends_sha256: the SHA-256 of the ids with that key, ascending, joined by commas. Ids are joined to pieces where they lie, so a key that very many share costs one task only its hashing."""
    names = ", ".join(f"{k} long" for k in KEY)
    pieces = members.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_joined, f"{names}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, f"{names}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node, all columns but the last long: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. A conversation's turns go by turn, nulls first, and where that ties by role
    and text, so repeated rows are turns of their own; null role and text are empty; rows without conv_id take no part.
    Conversation c is rebuilt from the first crc32(c) % 6 turns of c - c % 100, then its own after as many; it may be left
    without turns and is then a member of the root alone. Texts count whole, by hash (two of 64 bits), however long. An
    empty table has no nodes; other columns are ignored.
    """
    has_columns(conversations, ["conv_id", "turn", "role", "text"])
    convs, turns = _rebuilt(conversations)
    parts = turns.groupBy("conv_id", "part").agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"), F.sum("chars").alias("chars"), F.count("*").alias("n"))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"), F.sum("chars").alias("total"))
    members = stored(convs.join(whole, "conv_id", "left").na.fill(0), "members")
    sequences = stored(members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("total").alias("total")), "sequences")

    lead = sequences.select("conv_id", "weight", "total")
    earlier = parts.select("conv_id", "part", _before("s1", F.bit_xor).alias("e1"), _before("s2", F.bit_xor).alias("e2"), _before("chars").alias("above"))
    run = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    x1, x2 = (F.bit_xor(f"s{i}").over(run).bitwiseXOR(F.col(f"e{i}")) for i in (1, 2))
    path = turns.join(earlier.join(lead, "conv_id"), ["conv_id", "part"]).withColumns({"x1": x1, "x2": x2, "below": F.col("total") - F.col("above") - F.sum("chars").over(run) + F.col("chars")})
    path = path.select("conv_id", "part", *KEY, F.col("x1").bitwiseXOR(F.col("s1")).alias("up1"), F.col("x2").bitwiseXOR(F.col("s2")).alias("up2"), "chars", "below", "weight")
    zero = F.lit(0).cast("long")
    roots = lead.select("conv_id", F.lit(_ROOT).alias("part"), *(zero.alias(k) for k in (*KEY, "up1", "up2", "chars")), F.col("total").alias("below"), "weight")
    paths = stored(path.unionByName(roots), "paths")

    proper = paths.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up1").alias("x1"), F.col("up2").alias("x2")).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    nodes = stored(paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.max("chars").alias("chars")), "nodes")
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.sum("chars").alias("own"))
    facts = parts.select("conv_id", "part").unionByName(roots.select("conv_id", "part"))
    facts = facts.join(lead.select("conv_id"), "conv_id").join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    once = F.when(F.col("depth") >= F.col("since"), F.col("below")).otherwise(F.coalesce("own", F.lit(0)))
    sums = paths.join(facts, ["conv_id", "part"]).groupBy(*KEY).agg(F.sum(F.col("weight") * F.col("below") - once).alias("saved_tokens"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("x1"), F.col("up2").alias("x2")).agg(F.count("*").alias("n_children"))

    # the root has more children than any other node; as one row it joins without moving them
    root = nodes.filter("depth = 0")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("up1"), F.col("x2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.filter("depth > 1").join(parents, ["depth", "up1", "up2"])
    first = nodes.filter("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id"))))
    every = below.unionByName(first).unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = every.join(sums, KEY).join(children, KEY, "left").join(end_digests(members), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
