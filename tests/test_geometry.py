import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import clusters, evidence
from attestor.operators import geometry as G
from attestor.operators import negatives as N

SCHEMA = "i int, claim_vec array<double>, evidence_vecs array<array<double>>"


def plain(c, e, rank=8):
    c = np.asarray(c) / max(np.linalg.norm(c), 1e-12)
    e = np.array([x / (np.linalg.norm(x) if np.linalg.norm(x) >= 1e-12 else 1) for x in np.asarray(e, float)])
    _, s, vt = np.linalg.svd(e, full_matrices=False)
    keep = (s > 1e-6)[:rank]
    return float(((vt[:rank][keep] @ c) ** 2).sum()), s


def test_against_plain_decomposition(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), rng.normal(size=(n, 16)).tolist()) for i, n in enumerate([1, 2, 3, 8, 12, 20, 12, 3])]
    got = {r["i"]: r for r in G.geometry(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, c, e in rows:
        explained, s = plain(c, e)
        assert got[i]["explained"] == pytest.approx(explained, abs=1e-9)
        assert got[i]["energy"] == pytest.approx(np.clip(1 - explained, 0, 1), abs=1e-9)
        assert got[i]["spectral_sum"] == pytest.approx(s.sum(), abs=1e-9)
        assert got[i]["participation_ratio"] == pytest.approx(s.sum() ** 2 / (s**2).sum(), abs=1e-6)
        assert got[i]["is_stable"]


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0, 0.0], []),
        (1, [1.0, 0.0, 0.0], None),
        (2, [1.0, 0.0, 0.0], [[2.0, 0.0, 0.0]] * 3),  # repeated evidence is one direction
        (3, [0.0, 1.0, 0.0], [[2.0, 0.0, 0.0]] * 3),
        (4, [1.0, 0.0, 0.0], [[0.0, 0.0, 0.0]]),
        (5, [0.0, 0.0, 0.0], [[1.0, 0.0, 0.0]]),
        (6, None, [[1.0, 0.0, 0.0]]),
        (7, [1.0, 0.0, 0.0], [[-1.0, 0.0, 0.0], [0.0, -1.0, 0.0]]),
    ]
    got = {r["i"]: r for r in G.geometry(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in (0, 1):
        assert (got[i]["energy"], got[i]["explained"], got[i]["identity_error"], got[i]["participation_ratio"]) == (1.0, 0.0, 0.0, None)
    assert got[2]["energy"] == pytest.approx(0, abs=1e-12) and got[2]["effective_rank"] == 1
    assert got[3]["energy"] == 1.0
    assert got[4]["energy"] == 1.0 and got[4]["effective_rank"] == 0
    assert got[5]["energy"] == 1.0
    assert got[6]["energy"] is None
    assert got[7]["sensitivity"] == 1.0 and got[7]["sim_top1"] == 0.0  # no similarity above 0
    assert got[7]["energy"] == pytest.approx(0, abs=1e-12)


def test_lengths_have_to_agree(spark):
    with pytest.raises(Exception, match="differ in length"):
        G.geometry(spark.createDataFrame([(0, [1.0, 0.0], [[1.0]])], SCHEMA)).collect()


def test_top_k_only_on_request(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0, 0.0], [[1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])], SCHEMA)
    every, one = (G.geometry(rows, top_k=1, select_top_k=x).first()["energy"] for x in (False, True))
    assert every == pytest.approx(0, abs=1e-9) and one > 0.005


def test_difficulty(spark):
    with pytest.raises(ValueError):
        G.difficulty(0.1, 0.1, 1.0, (0.5, 0.5, 0.5, 0.5))
    row = spark.createDataFrame([(0.0, 2, 2, 2.0, 4.0)], "sim_margin double, effective_rank int, evidence_count int, sensitivity double, participation_ratio double")
    assert row.select(G.difficulty(0.1, 1.0, 2.0)).first()[0] == pytest.approx(1.0)


def test_dense_index_and_derangement(spark):
    rows = spark.range(57).selectExpr("id as idx", "cast(id as string) as claim", "array(id) as evidence")
    for got in (N.deranged_pairs(rows), N.cyclic_pairs(rows), N.offset_pairs(rows, 57), N.negatives(rows, "permute")):
        pairs = {r["idx"]: r["partner"] for r in got.collect()}
        assert sorted(pairs) == list(range(57)) and sorted(pairs.values()) == list(range(57))
        assert all(a != b for a, b in pairs.items())
    with pytest.raises(ValueError):
        N.negatives(rows, "nothing")


def test_guards_of_mining(spark):
    v = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0]]
    rows = [(i, "abc"[i], [f"P{i // 2}_sentence_{i}"], v[i], [v[i]]) for i in range(3)]
    pairs = spark.createDataFrame(rows, "idx long, claim string, evidence_ids array<string>, claim_vec array<double>, evidence_vecs array<array<double>>")
    free = {r["idx"]: r["partner"] for r in N.mined_pairs(pairs, page_mismatch=False).collect()}
    kept = {r["idx"]: (r["partner"], r["relaxed"]) for r in N.mined_pairs(pairs).collect()}
    assert free[0] == 1 and kept[0] == (2, 0)  # row 1 is on the same page
    assert kept[2] == (1, 0)


def test_mining_in_blocks(spark):
    """The same result in one block and in several, without adaptive execution to fold partitions together, and as by numpy."""
    rng = np.random.default_rng(5)
    claims, others = rng.standard_normal((90, 6)), rng.standard_normal((90, 2, 6))
    rows = spark.createDataFrame([(i, c.tolist(), e.tolist()) for i, (c, e) in enumerate(zip(claims, others))], "idx long, claim_vec array<double>, evidence_vecs array<array<double>>")
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    sims = unit(claims) @ unit(unit(others).mean(axis=1)).T
    want = {i: np.argsort(-sims[i])[:5].tolist() for i in range(90)}
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for block in (4096, 16):
            got = {}
            for r in N.candidates(rows, 5, block=block).orderBy("idx", "rank").collect():
                got.setdefault(r["idx"], []).append(r["other"])
            assert got == want
        np.fill_diagonal(sims, -2)
        assert {r["idx"]: r["partner"] for r in N.hard_mined_pairs(rows).collect()} == {i: int(sims[i].argmax()) for i in range(90)}
        assert N.mined_pairs(rows, by_energy=True).filter("mined_energy is null or relaxed <> 0").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def clustered(seed, n, groups, spread):
    r = np.random.default_rng(seed)
    x = r.standard_normal((groups, 16))[r.integers(groups, size=n)] + spread * r.standard_normal((n, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("spread,most", [(0.05, 0.1), (5.0, 1.0)])
def test_clusters_are_exact(spark, spread, most):
    """The same as all pairs: on clustered vectors with at most a tenth of them, on others block by block; a third are copies."""
    n, k = 3000, 8
    queries, points = clustered(1, n, 50, spread), clustered(1, n, 50, spread)
    points[: n // 3] = points[0]
    frame = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>")
    index = clusters.Clusters(frame(points, "point"), n, 100)
    got = {(r["query"], r["rank"]): (r["point"], r["sim"]) for r in clusters.ranked(index.greatest(frame(queries, "query"), k), k).collect()}
    assert len(got) == n * k and index.examined <= most * n * n
    sims = queries @ points.T
    for q in range(n):
        want = np.sort(sims[q])[::-1][:k]
        mine = [got[q, r + 1] for r in range(k)]
        assert np.allclose([s for _, s in mine], want, atol=1e-12) and np.allclose(sims[q][[p for p, _ in mine]], want, atol=1e-12)
        assert len({p for p, _ in mine}) == k


def test_mining_without_enough_evidence(spark):
    """Fewer than two rows with evidence: deranged, in the columns of a mined result; claims without candidates get a row that has evidence."""
    schema = "idx long, claim_vec array<double>, evidence_vecs array<array<double>>"
    bare = spark.createDataFrame([(0, [1.0, 0.0], [[1.0, 0.0]]), (1, [0.0, 1.0], []), (2, [1.0, 1.0], None)], schema)
    assert {(r["idx"] != r["partner"], r["mined_energy"], r["relaxed"]) for r in N.mined_pairs(bare).collect()} == {(True, None, None)}
    assert {r["sim"] for r in N.hard_mined_pairs(bare).collect()} == {None}
    some = spark.createDataFrame([(0, [1.0, 0.0], [[1.0, 0.0]]), (1, [0.0, 1.0], [[0.0, 1.0]]), (2, [1.0, 1.0], None)], schema)
    got = {r["idx"]: r for r in N.mined_pairs(some, k=1).collect()}
    assert all(r["partner"] in (0, 1) for r in got.values())
    assert got[0]["relaxed"] == 3 and abs(got[0]["mined_energy"] - (0.0 if got[0]["partner"] == 0 else 1.0)) < 1e-9
    assert got[2]["relaxed"] == 0 and abs(got[2]["mined_energy"] - 0.5) < 1e-9


def test_evidence_as_rows(spark):
    """The same diagnostics from rows as from an array: short and long evidence, repeated, zero and missing vectors, factors merged in a tree."""
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 12, 40, 700, 2500, 0]
    rows = [(i, rng.normal(size=12).tolist(), (rng.normal(size=(n, 12)) * rng.uniform(0.1, 3)).tolist()) for i, n in enumerate(sizes)]
    rows += [(20, [1.0] * 12, [[1.0] * 12] * 900), (21, [1.0] + [0.0] * 11, [[0.0] * 12]), (22, None, [[1.0] * 12]), (23, [0.0] * 12, [[1.0] * 12]), (24, [1.0] * 12, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    items = frame.select("i", F.posexplode("evidence_vecs").alias("at", "vector"))
    want = {r["i"]: r.asDict() for r in G.geometry(frame).drop("evidence_vecs", "claim_vec").collect()}
    got = {r["i"]: r.asDict() for r in evidence.geometry_rows(frame.drop("evidence_vecs"), items, "i", block=16).drop("claim_vec").collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        if i == 22:  # a null claim has no diagnostics but the number of its evidence
            assert {c: v for c, v in got[i].items() if v is not None and c not in ("i", "evidence_count")} == {}
            continue
        assert got[i].keys() == w.keys()
        for c, v in w.items():
            assert got[i][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (i, c)
    with pytest.raises(Exception, match="differ in length"):
        evidence.geometry_rows(frame.select("i", F.array(F.lit(1.0)).alias("claim_vec")), items, "i").collect()
    assert evidence.geometry_rows(frame.drop("evidence_vecs").limit(0), items, "i").count() == 0


def test_a_million_vectors_of_one_claim(spark):
    """No row of the factors grows with the evidence."""
    items = spark.range(1_000_000).select(F.lit("a").alias("k"), F.col("id").alias("at"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: F.sin(F.col("id") * j)).alias("vector"))
    blocks = evidence.blocked(items, "k", "at", "vector")
    assert blocks.agg(F.max(F.size("ats"))).first()[0] == evidence.BLOCK
    row = evidence.factors(blocks, "k").first()
    x = np.sin(np.arange(1_000_000)[:, None] * np.arange(1, 7))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    assert (row["n"], len(row["vectors"])) == (1_000_000, 6)
    assert np.allclose(np.linalg.svd(np.array(row["vectors"]), compute_uv=False), np.linalg.svd(x, compute_uv=False), rtol=1e-9)


def test_leave_one_out_by_downdates(spark):
    """As n decompositions: independent, dependent, repeated and nearly repeated evidence, and more directions than the cap."""
    rng = np.random.default_rng(8)
    cases = [rng.normal(size=(n, 24)) for n in (2, 5, 10, 11, 18, 40)]
    line = rng.normal(size=(1, 24))
    cases += [np.repeat(line, 3, axis=0), np.vstack([line, line * 2, rng.normal(size=(2, 24))]), np.vstack([line, line + 1e-5 * rng.normal(size=(1, 24)), rng.normal(size=(1, 24))]), rng.normal(size=(12, 3)) @ rng.normal(size=(3, 24)), np.zeros((3, 24)), line]
    rows = [(i, rng.normal(size=24).tolist(), e.tolist()) for i, e in enumerate(cases)] + [(99, [1.0] * 24, [])]
    got = {r["i"]: r for r in G.robustness(spark.createDataFrame(rows, SCHEMA)).collect()}
    energy = lambda c, e, rank: float(np.clip(1 - plain(c, e, rank)[0], 0, 1))
    for i, c, e in rows[:-1]:
        want = max(0.0, max(energy(c, np.delete(e, j, axis=0), 10) for j in range(len(e))) - energy(c, e, 10)) if len(e) > 1 else 1.0
        assert got[i]["leave_one_out"] == pytest.approx(want, abs=1e-9), i
        assert got[i]["probe_energies"] == pytest.approx([energy(c, e, r) for r in G.PROBES], abs=1e-9)
    assert got[99]["leave_one_out"] == 1.0 and got[99]["probe_energies"] == [1.0] * 3


def test_energy_of_fractions_has_no_lost_digit(spark):
    """Of hashed vectors energies are fractions, of which halves at the seventh place are rounded up (F1, F2)."""
    from fractions import Fraction

    from attestor.plans.queries import rounded

    rng = np.random.default_rng(5)
    made = [(i, rng.integers(-3, 4, 64), rng.integers(-3, 4, 64)) for i in range(300)]
    # the first is 1 - 19**2 / 1280, with a 5 at the eighth place
    ends = lambda *x: np.array([*x, *[0] * (64 - len(x))])
    made += [(300, ends(9, 5, 5, 5, 5, 5, 5, 5), ends(1, 2)), (301, ends(15, 5, 2, 1, 1), ends(1, 1, 1))]
    unit = lambda v: (v / np.sqrt(v @ v)).tolist()
    side = lambda at: evidence.blocked(spark.createDataFrame([(str(m[0]), 0, unit(m[at])) for m in made], "id string, at int, v array<double>"), "id", "at", "v")
    rows = evidence.energies(side(1), side(2), "id").select("id", "energy")
    want = {str(i): 1 - Fraction(int(q @ p) ** 2, int(q @ q) * int(p @ p)) for i, q, p in made}
    got = {r["id"]: r["energy"] for r in rows.collect()}
    assert got == pytest.approx({i: float(e) for i, e in want.items()}, abs=2e-14)
    assert [got["300"], got["301"]] == [round(float(want[i]), 14) for i in ("300", "301")]
    halves = spark.createDataFrame([(0.8101562499999999,), (0.70703125,), (0.7070312499,)], "energy double")
    assert [r["energy"] for r in rounded(halves, 7).collect()] == [0.8101563, 0.7070313, 0.7070312]


def test_all_pairs_move_rows_a_few_times(spark):
    """However many blocks the rows would fill, each meets the others in a few parts; copies tie to the last digit, in tiles too (F5, F6, F8, F9, F10)."""
    import pandas as pd

    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 7))
    x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True)] * 25)
    queries, points = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>") for name in ("query", "point"))
    found = clusters.by_blocks(queries, points, len(x), 1, 8)
    assert found.count() == len(x) * clusters.PARTS
    best = {r["query"]: r["point"] for r in clusters.ranked(found, 1).collect()}
    assert best == {i: i % 40 for i in range(len(x))}
    for tile, piece in ((1024, 1 << 22), (7, 64)):
        clusters.TILE, clusters.PIECE, kept = tile, piece, (clusters.TILE, clusters.PIECE)
        side = lambda name: pd.DataFrame({name: np.arange(len(x))[::-1], "vector": list(x[::-1])})
        got = clusters._best(30)(side("query"), side("point"))
        clusters.TILE, clusters.PIECE = kept
        want = {i: [i % 40 + 40 * j for j in range(25)] for i in range(len(x))}
        for i, group in got.groupby("query"):
            assert group["point"].tolist()[:25] == want[i] and len(group) == 30 and (np.diff(group["sim"]) <= 0).all()
            rest = np.sort(np.delete(x @ x[i], want[i]))[::-1][:5]
            assert group["sim"].to_numpy()[25:] == pytest.approx(rest)


def test_python_holds_pieces_of_a_batch(spark):
    """Decompositions turn a few rows of a batch at a time into Python's numbers, and doubles are sent once (F4, F7, F12, F13)."""
    import pyarrow as pa

    from attestor.operators.frames import pieces

    batch = pa.record_batch([pa.array(range(10_000)), pa.array(np.ones((10_000, 640)).tolist())], names=["i", "v"])
    cut = list(pieces([batch, batch.slice(0, 0)]))
    assert max(b.num_rows for b in cut) * 640 * 8 <= 1 << 22 and sum(b.num_rows for b in cut) == 10_000
    assert [x for b in cut for x in b.column("i").to_pylist()] == list(range(10_000))
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=64).tolist(), rng.normal(size=(10, 64)).tolist()) for i in range(1500)]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert G._doubles(frame, "claim_vec", "evidence_vecs")[0].columns == frame.columns
    got = {r["i"]: r["energy"] for r in G.geometry(frame).select("i", "energy").collect()}
    assert got == pytest.approx({i: float(np.clip(1 - plain(c, e)[0], 0, 1)) for i, c, e in rows}, abs=1e-9)
