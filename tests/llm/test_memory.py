"""What Python workers and executors hold is bounded by settings, not by the rows' width or a batch of Spark's."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attestor.llm import mixing, packing, shingles, toxicity
from attestor.llm.common import BATCH_BYTES


def test_packing_holds_one_text_of_a_batch(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(packing, "TaskContext", Task)
    text = b"the quick brown fox " * 500
    batch = pa.record_batch([pa.array(range(2000)), pa.array([text] * 2000)], names=["doc_id", "bytes"])
    run = packing._pieces(packing.tokenizer_path(), 4096, 64, 2)
    list(run([batch.slice(0, 1)]))
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run([batch]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= 2000 and most < batch.nbytes / 4


def test_encoder_forgets(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", 100)
    encode, whole = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    texts = [f"word{i} Ab{i}! café{i} it's the {'x' * (60 + i % 9)},{i}" for i in range(300)]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(encode([t.encode()])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    known = encode.known
    assert len(known) <= 130 and len(known.before) <= 130 and max(map(len, [*known, *known.before])) <= packing.LONGEST


def _seen(monkeypatch, module, steps):
    """The frames that module stores by name, where Python puts out what batches it got."""
    frames, stored = {}, module.stored

    def spy(df, name, *rest):
        frames[name] = stored(df, name, *rest)
        return frames[name]

    monkeypatch.setattr(module, "stored", spy)
    for name, make in steps.items():
        monkeypatch.setattr(module, name, make)
    return frames


def test_packing_and_near_duplicates_get_bounded_batches(spark, monkeypatch):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat("id", F.repeat(F.lit(" abc"), 1500)).alias("text"))

    def sizes(*_):
        def run(batches):
            for b in batches:
                n = pa.array([b.nbytes])
                yield pa.record_batch([b.column("doc_id").slice(0, 1), *[n] * 6], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

        return run

    def signed(*_):
        def run(batches):
            for b in batches:
                n = pa.array([b.nbytes])
                yield pa.record_batch([b.column("doc_id").slice(0, 1), n, n, pa.array([[1]]), n], names=["doc_id", "th", "fp", "cells", "simhash"])

        return run

    frames = _seen(monkeypatch, packing, {"_pieces": sizes})
    packing.pack(docs)
    row = 6100
    assert 1 < frames["pieces"].count() and frames["pieces"].agg(F.max("length")).first()[0] <= BATCH_BYTES + row
    frames = _seen(monkeypatch, shingles, {"_signed": signed})
    shingles.shingle_dedup(docs)
    assert 1 < frames["signed"].count() and frames["signed"].agg(F.max("fp")).first()[0] <= BATCH_BYTES + row


def test_toxicity_takes_texts_one_by_one():
    model = toxicity.Ordinal({f: 1.0 for f in toxicity.features_of(b"bad")}, np.array([0.5]))
    texts = [b"bad day", None, b"", b"b" * 200 + b" bad"]
    got = model.at_least(x for x in texts)
    assert got.shape == (4, 1) and got[0, 0] == got[3, 0] > got[1, 0] == got[2, 0]
    assert set(model.known) == {b"bad", b"day"}


def test_mixing_sends_its_plan_without_python_workers(spark):
    docs = spark.createDataFrame([(i, f"a b c {i}", "xy"[i % 2] if i % 5 else None) for i in range(40)], "doc_id int, text string, source string")
    out = mixing.mixed_documents(docs, F.array("source"))
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()
    assert out.count() > 40 and mixing.mixed_documents(docs.limit(0), F.array("source")).count() == 0
