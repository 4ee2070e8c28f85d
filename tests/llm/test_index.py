"""The fingerprint index kept beyond its session, and fingerprints that very many windows share."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import common, substring
from attestor.sources.store import Store

SCHEMA = "doc long, th string, bytes binary"


def _corpus(n=12, seed=4):
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"p{i}_{j}" for j in range(20)) for i in range(4)]
    return [" ".join(f"d{i}_{j}" for j in range(8)) + "".join(f" {passages[p]} e{i}_{p}" for p in rng.choice(4, 2, replace=False)) for i in range(n)]


def _wanted(texts):
    seen, out = {}, []
    for i, text in enumerate(texts):
        words, gone = text.split(), set()
        for at in range(len(words) - 12):
            if seen.setdefault(tuple(words[at : at + 13]), i) != i:
                gone |= set(range(at, at + 13))
        out.append((i, len(gone)))
    return out


def _ingested(spark, index, texts, low, high):
    rows = [(i, f"h{i}", texts[i].encode()) for i in range(low, high)]
    return [(r["doc"], r["n_removed"]) for r in index.ingest(spark.createDataFrame(rows, SCHEMA)).collect()]


SCRIPT = """
import sys
from pyspark.sql import SparkSession
from attestor.llm import substring
from tests.llm.test_index import _corpus, _ingested
base, path = sys.argv[1:]
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3")
         .config("spark.checkpoint.dir", base).config("spark.sql.warehouse.dir", base + "/warehouse").getOrCreate())
index = substring.FingerprintIndex(spark, path=path)
for low in (0, 2, 4):
    print("GOT", _ingested(spark, index, _corpus(), low, low + 2))
spark.stop()
"""


def test_an_index_outlives_its_session(spark, tmp_path):
    """Three batches by one process, the rest by another with other settings: rows as by brute force."""
    path, root = f"file://{tmp_path}/index", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", SCRIPT, f"file://{tmp_path}/shared", path], capture_output=True, text=True, timeout=300, cwd=root, env={**os.environ, "PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
    got = [x for line in done.stdout.splitlines() if line.startswith("GOT ") for x in eval(line[4:])]
    index = substring.FingerprintIndex.open(spark, path)
    assert index.buckets == 3 and index.compacted == 1 and [len(x) for x in index.levels] == [1, 1]
    texts = _corpus()
    for low in (6, 9):
        got += _ingested(spark, index, texts, low, low + 3)
        index = substring.FingerprintIndex.open(spark, path)
    assert sorted(got) == _wanted(texts)
    assert sum(n for _, n in got) > 0
    with pytest.raises(ValueError, match="holds an index"):
        substring.FingerprintIndex(spark, path=path)
    with pytest.raises(ValueError, match="follow"):
        _ingested(spark, index, texts, 1, 2)
    with pytest.raises(ValueError, match="no index"):
        substring.FingerprintIndex.open(spark, f"file://{tmp_path}/none")


def test_a_batch_that_breaks_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    """The batch ends before its state is in place, as it compacts: the index opens as it was and takes the batch again."""
    path, texts = f"file://{tmp_path}/index", _corpus()
    index = substring.FingerprintIndex(spark, path=path, buckets=2)
    got = _ingested(spark, index, texts, 0, 4)
    before = set(common.folders_in(spark, path))
    with monkeypatch.context() as m:
        m.setattr(Store, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("broken off")))
        with pytest.raises(RuntimeError):
            _ingested(spark, index, texts, 4, 8)
    assert set(common.folders_in(spark, path)) > before
    index = substring.FingerprintIndex.open(spark, path)
    assert set(common.folders_in(spark, path)) == before
    for low in (4, 8):
        got += _ingested(spark, index, texts, low, low + 4)
    assert sorted(got) == _wanted(texts)


def test_windows_of_one_fingerprint_are_shared_out(spark):
    """300 documents have one 5-gram of very small hash in common, and no window: it is the fingerprint of nine windows of each."""
    grams = [f"a{i} b{i} c{i} d{i} e{i}" for i in range(3000)]
    low = min(grams, key=lambda g: substring.windows(g.encode().split(), 5, 5)[1][0])
    texts = [" ".join([*(f"l{i}_{j}" for j in range(8)), low, *(f"r{i}_{j}" for j in range(8))]) for i in range(300)]
    index = substring.FingerprintIndex(spark, buckets=8)
    got = _ingested(spark, index, texts, 0, 150) + _ingested(spark, index, texts, 150, 300)
    assert sorted(got) == [(i, 0) for i in range(300)]
    windows = index.runs[0].windows
    counts = [r["count"] for r in windows.groupBy("fp").count().collect()]
    shares = [r["count"] for r in windows.groupBy(F.input_file_name()).count().collect()]
    assert max(counts) >= 300 * 8  # one fingerprint holds nearly all
    assert max(shares) < 0.25 * sum(shares)
