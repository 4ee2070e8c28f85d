"""Every query against its SQL on DuckDB, over whole tables; and that the others run."""

import math
from pathlib import Path

import duckdb
import pytest

from attestor.plans import queries as Q

SF = "/root/testdata/sf0.001"
SLOW = {"score_fusion", "logreg_cv", "ablation", "residual_independence", "gbt_auc", "rf_importance", "gate_run", "boosted_cv", "seed_stability"}  # test_models.py and test_batched.py have tests of what they call


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{v + 0.0:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_as_sql(spark, db, name):
    got = Q.QUERIES[name](spark, SF)
    want = db.execute(Q.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE) - SLOW))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["split"] for r in rows} == {"pos", "neg"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
