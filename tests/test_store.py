"""A store under writes: old or new, whatever breaks off; and the line numbers of strict scans."""

import pytest
from pyspark.sql import functions as F

from attestor.sources import readers
from attestor.sources.store import Store


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id int, v string, updated_at int")


def seen(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_onto_itself(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read() is None and store.parts() == []
    store.upsert(rows(spark, (1, "a", 1), (2, "b", 1)), ["id"])
    early = store.read()
    store.upsert(rows(spark, (2, "c", 2), (3, "d", 2), (1, "older", 0)), ["id"])
    assert seen(store.read()) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    assert seen(early) == [(1, "a", 1), (2, "b", 1)]  # a reader that had begun
    store.put(store.read().filter("id > 1"))
    assert seen(store.read()) == [(2, "c", 2), (3, "d", 2)]


@pytest.mark.parametrize("step", ["write", "swap"])
def test_breaking_off(spark, tmp_path, monkeypatch, step):
    """A write that breaks off half-way through its rows, or before its manifest, leaves the old store; the next one clears up."""
    path = f"file://{tmp_path}/s"
    Store(spark, path).upsert(rows(spark, (1, "a", 1)), ["id"])
    if step == "swap":
        with monkeypatch.context() as m:
            m.setattr(Store, "_swap", lambda self, manifest: (_ for _ in ()).throw(OSError("gone")))
            with pytest.raises(OSError):
                Store(spark, path).upsert(rows(spark, (1, "b", 2)), ["id"])
    else:
        broken = rows(spark, (1, "b", 2), (2, "x", 2)).repartition(2, "id").withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
        with pytest.raises(Exception, match="lost"):
            Store(spark, path).put(broken)
    assert seen(Store(spark, path).read()) == [(1, "a", 1)]
    Store(spark, path).upsert(rows(spark, (1, "c", 3)), ["id"])
    assert seen(Store(spark, path).read()) == [(1, "c", 3)]
    assert sum(p.name.startswith("data-") for p in (tmp_path / "s").iterdir()) == 2  # in force, and for readers that had begun
    assert Store(spark, path).clean() == []


def test_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/r")
    store.replace_run(rows(spark, (1, "a", 1)), "one")
    store.replace_run(rows(spark, (2, "b", 1)), "two")
    store.replace_run(rows(spark, (3, "c", 1), (4, "d", 1)), "one")
    assert [(r["id"], r["run_id"]) for r in store.read().orderBy("id").collect()] == [(2, "two"), (3, "one"), (4, "one")]
    assert store.parts() == ["one", "two"] and store.read("two").count() == 1


def test_lines_of_many_ranges(spark, tmp_path):
    """Files of many byte ranges: every line has its number, and a bad one is named."""
    for f in range(3):
        (tmp_path / f"{f}.json").write_text("".join("\n" if i % 50 == 7 else f'{{"id": "{f}-{i}"}}\n' for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path)).filter("value <> ''").select(F.get_json_object("value", "$.id").alias("id"), F.regexp_extract("file", r"(\d)\.json", 1).alias("f"), "line").collect()
        assert {(r["id"], r["line"]) for r in lines} == {(f"{f}-{i}", i + 1) for f in range(3) for i in range(4000) if i % 50 != 7}
        assert readers.json_lines(spark, str(tmp_path), "id string", strict=True).count() == len(lines)
        with open(tmp_path / "1.json", "a") as f:
            f.write("{oops\n")
        with pytest.raises(Exception, match=r"1\.json, line 4001: \{oops"):
            readers.json_lines(spark, str(tmp_path), "id string", strict=True).collect()
        assert readers.json_lines(spark, str(tmp_path), "id string").filter("id is null").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
