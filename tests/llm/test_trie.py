"""The prefix trie against a plain one: long and identical conversations, ties, nulls, odd ids, empty tables."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from attestor.llm import trie
from attestor.llm.queries import ORACLE

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = tuple(turns.get(base, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, cs in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += k not in children
    ends = defaultdict(list)
    for c, s in built.items():
        ends[s].append(c)
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted((min(cs), len(k), min(nodes[k[:-1]]) if k else -1, len(cs), children.get(k, 0), leaves[k], saved[k], digest(k)) for k, cs in nodes.items())


def got(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in trie.prefix_trie(df).collect())


def made():
    rows = [(c, t, "ua"[t % 2], f"text {t} {c % 3}") for c in range(60) for t in range(1 + c % 7)]
    rows += [(c, t, "u", "the same") for c in range(100, 400) for t in range(4)]  # most conversations are copies
    rows += [(500, t, "u", f"é{t}") for t in range(150)] + [(501, t, "u", f"é{t}") for t in range(149)]  # two long ones share a prefix
    rows += [(600, None, "u", "b"), (600, None, "u", "a"), (600, 1, None, None), (600, 1, None, None), (600, 1, "", ""), (601, 3, "u", None), (-7, 1, "u", "x" * 200_000), (-100, 5, "u", "y"), (-100, 4, "a", "𝄞"), (None, 1, "u", "no id"), (1 << 40, 1, "u", "z")]
    return rows


@pytest.mark.parametrize("parts", [4, 40])
def test_plain(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a conversation spans partitions
    try:
        df = spark.createDataFrame(made(), SCHEMA).withColumns({c: F.lit("x") for c in ("part", "depth", "base", "head", "x1", "weight", "at", "chars")})
        assert got(df) == plain(made())
        assert got(df.limit(0)) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)


def test_sql_on_made_rows(spark):
    rows = [r for r in made() if r[0] is None or r[0] < 500]
    con = duckdb.connect()
    con.register("t", __import__("pandas").DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("create view conversations as select * from t")
    order = "conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert con.sql(f"select {order} from ({ORACLE['op12_prefix_trie']})").fetchall().sort() == plain(rows).sort()


def test_one_key_of_many_ids(spark):
    ids = spark.range(50_000).select(F.lit(1).cast("long").alias("depth"), F.lit(2).cast("long").alias("x1"), F.lit(3).cast("long").alias("x2"), F.col("id").alias("conv_id"))
    rows = trie.end_digests(ids.repartition(7)).collect()
    assert [r["ends_sha256"] for r in rows] == [hashlib.sha256(",".join(map(str, range(50_000))).encode()).hexdigest()]
