"""Caches built with a model: once a key, once a worker, resumed after a failure."""

import os

import pytest
from pyspark.sql import functions as F

from attestor.operators import cache, support
from attestor.sources.store import Store


def counting(folder, broken=None):
    """A factory that leaves a file for each loading and each text; one text breaks it while there is a file named so."""

    def load():
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            for t in texts:
                if t == broken and os.path.exists(f"{folder}/broken"):
                    raise RuntimeError("model broke")
                open(f"{folder}/text-{t}-{uuid.uuid4().hex}", "w").close()
            return [[float(len(t)), 1.0] for t in texts]

        return model

    return load


def of(folder, kind):
    return [n for n in os.listdir(folder) if n.startswith(kind)]


def test_once_a_key_and_worker(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store = Store(spark, f"file://{tmp_path}/s")
    texts = spark.createDataFrame([("a",), ("bb",), ("bb",), (None,), ("ccc",)], "text string")
    first = cache.build_vectors(texts, store, "m1", counting(logs), rounds=2, batch=1).first()
    assert (first["wanted"], first["held"], first["computed"]) == (3, 0, 3)
    assert len(of(logs, "text")) == 3
    workers = [n.split("-")[1] for n in of(logs, "load")]
    assert len(workers) == len(set(workers))  # once a worker
    again = cache.build_vectors(texts.unionByName(spark.createDataFrame([("dddd",)], "text string")), store, "m1", counting(logs), rounds=2).first()
    assert (again["held"], again["computed"]) == (3, 1) and len(of(logs, "text")) == 4
    assert cache.build_vectors(texts, store, "m1", counting(logs)).first()["computed"] == 0 and len(of(logs, "text")) == 4
    assert cache.build_vectors(texts, store, "other", counting(logs)).first()["computed"] == 3  # another model's are its own
    store.compact()
    assert store.parts() == [""] and cache.vectors(store, "m1").count() == 4
    got = {r["text"]: r["vec"] for r in support.embed(texts, cache.vectors(store, "m1"), "m1", 2).collect()}
    assert got == {"a": [1.0, 1.0], "bb": [2.0, 1.0], "ccc": [3.0, 1.0], None: None}


def test_resumes(spark, tmp_path):
    """Rounds that were done before a failure stay done."""
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "broken").touch()
    store = Store(spark, f"file://{tmp_path}/s")
    texts = spark.createDataFrame([(f"t{i}",) for i in range(40)], "text string")
    last = texts.select("text", F.pmod(F.xxhash64(cache.text_hash(F.col("text"))), F.lit(8)).alias("r")).filter("r = 5").first()["text"]
    with pytest.raises(Exception, match="model broke"):
        cache.build_vectors(texts, store, "broken-once", counting(logs, broken=last), rounds=8)
    done = store.read().count()
    assert 0 < done < 40
    (logs / "broken").unlink()
    facts = cache.build_vectors(texts, store, "broken-once", counting(logs)).first()
    assert (facts["held"], facts["computed"]) == (done, 40 - done)
    assert store.read().groupBy("key").count().filter("count > 1").count() == 0 and store.read().count() == 40


def test_entailments(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    pairs = spark.createDataFrame([("it rains", "it is wet"), ("it rains", "it is wet"), ("x", None)], "premise string, hypothesis string")
    facts = cache.build_entailments(pairs, store, "nli", lambda: lambda rows: [0.25 if p < h else 0.75 for p, h in rows]).first()
    assert facts["computed"] == 1
    assert [r["entailment_prob"] for r in cache.entailments(store, "nli").collect()] == [0.75]
    with pytest.raises(Exception, match="gave 0 results"):
        cache.build_entailments(spark.createDataFrame([("a", "b")], "premise string, hypothesis string"), store, "short", lambda: lambda rows: [])
