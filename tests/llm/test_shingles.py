"""Near-duplicates by shingles: links against brute force, and what the pipeline's stage keeps."""

from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from attestor.llm import shingles

SF = "/root/testdata/sf0.01"


def kept(sets: dict) -> set:
    """The smallest id of each component of sets linked at a Jaccard similarity of 0.8, by brute force."""
    by, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i] or {None}:
            for j in by[s]:
                common[j] += 1
            by[s].append(i)
        for j, n in common.items():
            if not sets[i] or 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i for i in sets if parent[i] == i}


def word_sets(texts: dict) -> dict:
    out = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        out[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    return out


def test_stage_is_brute_force(spark):
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    want = kept(word_sets(dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))))
    got = corpus_pipeline.near_duplicates_out(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)


def test_groups_around_the_threshold(spark):
    """Groups whose members are partly under 0.8 to one another, and near copies without any text in common with others."""
    rng = np.random.default_rng(1)
    texts = {}
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(200)]
        for i in range(40):
            words = list(base)
            for at in rng.choice(200, int(rng.integers(0, 6)), replace=False):
                words[at] = f"x{g}_{i}_{at}"
            texts[g * 1000 + i] = " ".join(words)
    texts |= {9000: None, 9001: "", 9002: "a b", 9003: "A  b", 9004: "a b c"}
    want = kept(word_sets(texts))
    got = shingles.shingle_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    assert 6 < len(want) < 240


def as_sets(spark, sets):
    rows = [(i, [int(x) for x in g.view(np.int64)], len(g), shingles.segment_counts(g)) for i, g in sets]
    return spark.createDataFrame(rows, "fp long, grams array<long>, n int, counts binary")


def test_pairs_beside_the_first_compared(spark):
    """Two alike in a cell whose other members, compared first, are like neither."""
    name = np.random.default_rng(2).integers(0, 2**64, 1000, dtype=np.uint64)
    sets = [(i, name[100 * i : 100 * i + 20]) for i in range(1, 9) if i != 5] + [(5, name[400:421])]
    cell = spark.createDataFrame([(i, 7) for i in range(1, 9)], "fp long, cell long")
    got = shingles.links(cell, as_sets(spark, sets))
    assert [sorted(r) for r in got.collect()] == [[4, 5]]


def test_blocks(spark, monkeypatch):
    """A cell of many classes, in one block and in many: the same links, those of brute force."""
    rng = np.random.default_rng(3)
    sets = []
    for g in range(30):
        base = rng.integers(0, 2**64, 60, dtype=np.uint64)
        sets += [(100 * g + i + 1, np.concatenate([base[int(rng.integers(0, 12)) :], rng.integers(0, 2**64, int(rng.integers(0, 6)), dtype=np.uint64)])) for i in range(5)]
    alike = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    parent = {i: i for i, _ in sets}

    def root(at, i):
        while at[i] != i:
            i = at[i]
        return i

    def joined(edges):
        at = dict(parent)
        for u, v in edges:
            x, y = sorted((root(at, u), root(at, v)))
            at[y] = x
        return {i: root(at, i) for i in at}

    want = joined((i, j) for i, a in sets for j, b in sets if i < j and alike(a, b))
    cell = spark.createDataFrame([(i, 7) for i, _ in sets], "fp long, cell long")
    for apart, block in ((1024, 4096), (8, 16)):
        monkeypatch.setattr(shingles, "APART", apart)
        monkeypatch.setattr(shingles, "BLOCK", block)
        assert joined((r["u"], r["v"]) for r in shingles.links(cell, as_sets(spark, sets)).collect()) == want
    assert 30 <= len(set(want.values())) < len(sets)


def test_bound():
    """No pair at the threshold is beyond the bound, for sets that fill segments over and over too."""
    rng = np.random.default_rng(4)
    for size in (5, 50, 500, 200_000):
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate([a[: size - size // 9], rng.integers(0, 2**64, size // 9, dtype=np.uint64)])
        x, y = (np.frombuffer(shingles.segment_counts(s), np.uint8).astype(int) for s in (a, b))
        assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        assert np.abs(x - y).sum() <= shingles.bound(2 * size, 0.8)


def test_the_stage_takes_op3s_links_too(spark):
    """Texts within two bits of each other are one, though their five-word shingles differ in more than a fifth (F3)."""
    from attestor.llm import simhash

    rng = np.random.default_rng(8)
    made = None
    for _ in range(4000):
        base = " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, 6)) + " "
        # the repeated part weighs in the fingerprint by its count and in the set of shingles once
        a, b = base * 12 + "x y z", base * 12 + "q r s"
        sets = word_sets({1: a, 2: b})
        if bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1") <= 2 and len(sets[1] & sets[2]) < 0.8 * len(sets[1] | sets[2]):
            made = a, b
            break
    assert made
    docs = spark.createDataFrame([(3, made[1]), (2, made[0]), (5, "one two three four five six"), (9, None), (7, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingles.shingle_dedup(docs).collect()) == [2, 3, 5, 7]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates_out(spark, docs, SF).collect()) == [2, 5, 7]


def test_components_leave_no_shuffle_files_nor_old_rounds(spark):
    """What a round leaves behind adds up over the rounds, times the partitions squared."""
    from pathlib import Path

    from attestor.llm import components
    from attestor.operators.frames import shared_folder

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffled = lambda: {f for f in (files().apply(i).getName() for i in range(files().size())) if f.startswith("shuffle_")}
    folder = Path(shared_folder(spark).removeprefix("file:"))
    chain = spark.range(40).selectExpr("id u", "id + 1 v").unionByName(spark.createDataFrame([(90, 90), (7, 7), (None, 3)], "u long, v long"))
    before, there = shuffled(), set(folder.glob("edges-*"))
    found = components.components(chain)
    assert not shuffled() - before
    assert len(set(folder.glob("edges-*")) - there) == 2  # those given and those of the last round
    assert {r["node"]: r["root"] for r in found.collect()} == {n: 0 for n in range(41)} | {90: 90}


def test_prints_join_sets_across_both_kinds_of_links(spark):
    """Sets that only fingerprints link, at no bits and at two, directly or over a third text."""
    from attestor.llm import shingles, simhash

    a = " ".join(f"w{i}" for i in range(40))
    b = " ".join([a] * 3 + ["w0 w1"])  # other sets than a's, by repetition
    rows = [(5, a), (3, b), (9, "x " + a), (None, a), (2, "far away from all of them"), (7, None), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    prints = {d: simhash.fingerprint((t or "").encode()) for d, t in rows}
    sets = {d: set(shingles.shingles((t or "").encode()).tolist()) for d, t in rows}

    def alike(x, y):
        both = len(sets[x] | sets[y])
        return not both or len(sets[x] & sets[y]) >= 0.8 * both

    root = {d: d for d in prints}
    for _ in root:
        for x in root:
            for y in root:
                if alike(x, y) or (prints[x] ^ prints[y]).bit_count() <= 2:
                    root[x] = root[y] = min(root[x], root[y], key=lambda d: (d is None, d or 0))
    got = shingles.shingle_dedup(docs, with_prints=True).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted({r for r in root.values()})
