"""Text functions that need Python."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from attestor.functions import text as X


def test_composed_form_of_few_texts_at_a_time(spark, monkeypatch):
    """Equal to Python's own, whatever the batch; no run of more than NFC_ROWS texts is held as Python's (F11)."""
    texts = ["é ", None, "", " 한\n", "abc", "Å" * 3] * 200
    want = [None if t is None else unicodedata.normalize("NFC", t).strip() for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert [r["x"] for r in rows.select("i", X.nfc(F.col("t")).alias("x")).orderBy("i").collect()] == want
    assert X.nfc.func(pa.array([], pa.string())).to_pylist() == []
    monkeypatch.setattr(X, "NFC_ROWS", 7)
    assert X.nfc.func(pa.array(texts, pa.string())).to_pylist() == want
