"""Caches of what models give: each key is computed once, and a run that breaks off goes on where it stopped.

A model is a factory: a function that loads it and returns a function from a list of inputs (strings, or tuples where
there are several columns) to a list of results. It is called once in a Python worker and its model serves all batches of
all tasks there. Only keys that the store lacks are computed, each different one once, in rounds by hash; each round is
put into the store as one step, as a part of its own, so what is done stays done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.text import entailment_key, text_hash
from attestor.operators.frames import settled
from attestor.sources.store import Store

Factory = Callable[[], Callable[[list], list]]
ROUNDS, BATCH = 8, 64
_loaded: dict = {}


def loaded(name: str, factory: Factory) -> Callable[[list], list]:
    """The worker's model of that name; it stays for later batches and tasks."""
    if name not in _loaded:
        _loaded[name] = factory()
    return _loaded[name]


def _computed(name: str, factory: Factory, inputs: Sequence[str], batch: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(c).to_pylist() for c in inputs]
            rows = columns[0] if len(inputs) == 1 else list(zip(*columns, strict=True))
            model, out = loaded(name, factory), []
            for i in range(0, len(rows), batch):
                got = list(model(rows[i : i + batch]))
                if len(got) != len(rows[i : i + batch]):
                    raise ValueError(f"model {name} gave {len(got)} results for {len(rows[i : i + batch])} inputs")
                out += got
            yield pa.record_batch([b.column("key"), pa.array(out, kind)], names=["key", "value"])

    return run


def build(rows: DataFrame, store: Store, key: Column, inputs: Sequence[str], model: str, factory: Factory, kind: str = "array<double>", rounds: int = ROUNDS, batch: int = BATCH) -> DataFrame:
    """One row: wanted (different keys), held (of them, before), computed. The store then has key, model, value of all.

    rows has the columns `inputs`; those with a null among them are left out. kind: array<double> or double.
    """
    wanted = rows.select(key.alias("key"), *inputs).na.drop(subset=list(inputs)).dropDuplicates(["key"])
    held = store.read()
    mine = held.filter(F.col("model") == model).select("key") if held is not None else wanted.select("key").limit(0)
    missing = settled(wanted.join(mine, "key", "left_anti"))
    wanted_n, missing_n = wanted.count(), missing.count()
    arrow = {"array<double>": pa.list_(pa.float64()), "double": pa.float64()}[kind]
    fields = T.StructType([T.StructField("key", T.StringType()), *T.StructType.fromDDL(f"value {kind}")])
    for i in range(rounds if missing_n else 0):
        some = missing.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == i)
        done = some.mapInArrow(_computed(model, factory, inputs, batch, arrow), fields).select("key", F.lit(model).alias("model"), "value")
        store.append(done)
    return rows.sparkSession.createDataFrame([(model, wanted_n, wanted_n - missing_n, missing_n)], "model string, wanted long, held long, computed long")


def build_vectors(texts: DataFrame, store: Store, model: str, factory: Factory, column: str = "text", **more) -> DataFrame:
    """build() for embeddings of texts."""
    return build(texts, store, text_hash(F.col(column)), [column], model, factory, "array<double>", **more)


def build_entailments(pairs: DataFrame, store: Store, model: str, factory: Factory, premise: str = "premise", hypothesis: str = "hypothesis", **more) -> DataFrame:
    """build() for the probability that premise entails hypothesis."""
    return build(pairs, store, entailment_key(F.col(premise), F.col(hypothesis)), [premise, hypothesis], model, factory, "double", **more)


def vectors(store: Store, model: str) -> DataFrame | None:
    """The store's vectors as support.embed takes them: text_hash, model, dim, vec."""
    held = store.read()
    return None if held is None else held.filter(F.col("model") == model).select(F.col("key").alias("text_hash"), "model", F.size("value").alias("dim"), F.col("value").alias("vec"))


def entailments(store: Store, model: str) -> DataFrame | None:
    """The store's probabilities as support.sentence_support takes them: key, entailment_prob."""
    held = store.read()
    return None if held is None else held.filter(F.col("model") == model).select("key", F.col("value").alias("entailment_prob"))
