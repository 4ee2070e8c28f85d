"""Substring deduplication on a log-structured fingerprint index.

A window is 13 consecutive words. Its fingerprint is the least of the hashes of the 5-word sequences in it, so equal
windows have equal fingerprints and about a fifth as many fingerprints as windows come up. The index is a list of
immutable runs on levels. A run holds, sorted by fingerprint and bucketed, the least and greatest document of every
fingerprint of its batches; and beside it, bucketed alike, the verified windows of fingerprints that several documents
share: a hash of the window whole, the fingerprint and the least document.

A new batch becomes a run itself and is merge-joined with the earlier runs, bucket by bucket without an exchange. For a
fingerprint that an earlier run holds for one document, that document's windows are computed now and verified; if it was
held for several, they have been, and lie in the runs. So a batch computes windows of its own documents and of those
earlier ones it hits for the first time. Windows are the same if both 64-bit hashes are: that of the whole and the
fingerprint. They lie in buckets of both, so the many different windows around one common fingerprint are shared out.
`fanout` runs of a level are compacted into one of the next, and their files removed.

An index with a path of its own outlives its session: after each batch a new state is put in place of the last by one
rename, and FingerprintIndex.open() goes on from there. A batch that broke off has left no trace in the state and can be
given again; files that no state names are removed as the index is opened.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import bucketed, dropped, folders_in, has_columns, new_path, partitions_kept, removed, stored, stored_bucketed, text_bytes
from attestor.sources.store import Store

WIDTH, GRAM = 13, 5
#: Null doc_ids are given numbers from here on, by a hash of their text; none of them comes before another.
NULLS = 2**63 - 2**32
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def windows(words: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash, fingerprint) of each window of width words; empty for fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    at = np.array([digest(w) for w in words], dtype=np.uint64)
    whole = np.zeros(n, np.uint64)
    for i in range(width):
        whole = whole * _MUL[0] + at[i : i + n]
    m = n + width - gram
    grams = np.zeros(m, np.uint64)
    for i in range(gram):
        grams = grams * _MUL[1] + at[i : i + m]
    grams = _mixed(grams)
    least, span, want = grams, 1, width - gram + 1
    while span < want:  # minimum over a growing span
        step = min(span, want - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return _mixed(whole), least


def keep(words: list[bytes], repeated: np.ndarray, width: int = WIDTH) -> list[bytes]:
    """The words outside all windows flagged in repeated."""
    if not repeated.any():
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(repeated)] += repeated
    edge[width : width + len(repeated)] -= repeated
    free = np.cumsum(edge[:-1]) == 0
    return [w for w, f in zip(words, free, strict=True) if f]


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in some, a list without order."""
    some = np.sort(some)
    at = np.searchsorted(some, values)
    at[at == len(some)] = 0
    return some[at] == values if len(some) else np.zeros(len(values), bool)


def _words(x) -> list[bytes]:
    return (x.as_py() or b"").split()


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a, dtype=np.uint64).view(np.int64))


def _postings(width, gram):
    def run(batches):
        for b in batches:
            docs, prints = b.column("doc").to_numpy(), []
            for x in b.column("bytes"):
                p = windows(_words(x), width, gram)[1]
                prints.append(np.unique(p[np.r_[True, p[1:] != p[:-1]]]) if len(p) else p)  # neighbours mostly have one fingerprint
            yield pa.record_batch([_longs(np.concatenate(prints)) if prints else pa.array([], pa.int64()), pa.array(np.repeat(docs, [len(p) for p in prints]))], names=["fp", "doc"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate([np.empty(0, np.uint64), *arrays])))


def _verified(width, gram):
    """The different windows of a text with one of the shared fingerprints."""

    def run(batches):
        for b in batches:
            hashes, prints = [], []
            for x, shared in zip(b.column("bytes"), b.column("shared"), strict=True):
                whole, p = windows(_words(x), width, gram)
                mask = _among(p, shared.values.to_numpy().view(np.uint64))
                whole, first = np.unique(whole[mask], return_index=True)
                hashes.append(whole)
                prints.append(p[mask][first])
            yield pa.record_batch([b.column("doc"), _lists(hashes), _lists(prints)], names=["doc", "wholes", "fps"])

    return run


def _kept(width, gram):
    def run(batches):
        for b in batches:
            total, removed, text = [], [], []
            for x, repeated in zip(b.column("bytes"), b.column("repeated"), strict=True):
                words = left = _words(x)
                if repeated.is_valid:
                    left = keep(words, _among(windows(words, width, gram)[0], repeated.values.to_numpy().view(np.uint64)), width)
                total.append(len(words))
                removed.append(len(words) - len(left))
                text.append(b" ".join(left))
            yield pa.record_batch([b.column("doc"), b.column("th"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.binary())], names=["doc", "th", "n_words", "n_removed", "kept"])

    return run


def _before(a: Column, b: Column) -> Column:
    """Whether document a comes before b."""
    return F.least(a, F.lit(NULLS)) < F.least(b, F.lit(NULLS))


@dataclass
class Run:
    """In the folder of this name, prints: fp, least, most, in buckets of fp; windows: fp, whole, least, of shared fingerprints, in buckets of fp and whole."""

    name: str
    prints: DataFrame
    windows: DataFrame


@dataclass
class Texts:
    """The units of a batch, and its documents' bounds."""

    name: str | None
    units: DataFrame
    low: int
    high: int


PRINTS, WINDOWS = ("fp",), ("fp", "whole")
KEPT = "doc long, th string, n_words long, n_removed long, kept binary"


class FingerprintIndex:
    """The runs of one corpus. Batches come in order of document: no document of a batch is below one of an earlier batch.

    With a path the index is kept there, texts included, and open() finds it again; without, it lasts as long as the
    session and refers to the frames it is given. One writer at a time.
    """

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, buckets: int | None = None, fanout: int = 2, path: str | None = None):
        self.spark, self.width, self.gram, self.fanout = spark, width, gram, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = []
        self.texts: list[Texts] = []
        self.last: int | None = None
        self.compacted = 0
        self.durable = path is not None
        self.path = path.rstrip("/") if path else new_path(spark, "index")
        if self.durable and self._state().read() is not None:
            raise ValueError(f"{path} holds an index; open() goes on with it")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index kept at path, as its last whole batch left it."""
        rows = Store(spark, f"{path.rstrip('/')}/state").read()
        if rows is None:
            raise ValueError(f"{path} holds no index")
        state = json.loads(rows.first()["value"])
        index = cls(spark, state["width"], state["gram"], state["buckets"], state["fanout"])
        index.path, index.durable, index.last, index.compacted = path.rstrip("/"), True, state["last"], state["compacted"]
        kept = lambda name, schema, keys: bucketed(spark, f"{index.path}/{name}", schema, keys, index.buckets)
        index.levels = [[Run(n, kept(f"{n}/prints", "fp long, least long, most long", PRINTS), kept(f"{n}/windows", "fp long, whole long, least long", WINDOWS)) for n in level] for level in state["levels"]]
        index.texts = [Texts(n, kept(n, "doc long, th string, bytes binary", ["doc"]), low, high) for n, low, high in state["texts"]]
        index._clean()
        return index

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def _state(self) -> Store:
        return Store(self.spark, f"{self.path}/state")

    def _save(self) -> None:
        """Puts the state as it is in place of the last one; then what only that named can go."""
        if self.durable:
            state = {
                **{k: getattr(self, k) for k in ("width", "gram", "buckets", "fanout", "last", "compacted")},
                "levels": [[r.name for r in level] for level in self.levels],
                "texts": [[t.name, t.low, t.high] for t in self.texts],
            }
            self._state().put(self.spark.createDataFrame([(json.dumps(state),)], "value string"))
        self._clean()

    def _clean(self) -> None:
        named = {"state", *(r.name for r in self.runs), *(t.name for t in self.texts)}
        for name in folders_in(self.spark, self.path):
            if name not in named:
                removed(self.spark, f"{self.path}/{name}")

    def _bucketed(self, rows: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
        """rows, an aggregate on keys, in buckets of them; its own exchange mostly deals them out as the buckets need it."""
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            rows = rows.repartition(self.buckets, *keys)
        with partitions_kept(self.spark):
            return stored_bucketed(rows, f"{self.path}/{name}", keys, self.buckets)

    def _prints(self, rows: DataFrame, run: str) -> DataFrame:
        """rows (fp, least, most), any number a fingerprint, combined before they are dealt out."""
        return self._bucketed(rows.groupBy(*PRINTS).agg(F.min("least").alias("least"), F.max("most").alias("most")), f"{run}/prints", PRINTS)

    def _combined(self, rows: DataFrame, run: str) -> DataFrame:
        """rows (fp, whole, least), any number a window, combined alike."""
        return self._bucketed(rows.groupBy(*WINDOWS).agg(F.min("least").alias("least")), f"{run}/windows", WINDOWS)

    def _add(self, run: Run, level: int = 0) -> None:
        """Puts the run on its level and compacts a full level into the next."""
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self.levels[level], []
            prints, windows = (functools.reduce(DataFrame.unionByName, (getattr(r, c) for r in merged)) for c in ("prints", "windows"))
            name = f"run-{uuid.uuid4().hex}"
            self.compacted += 1
            self._add(Run(name, self._prints(prints, name), self._combined(windows, name)), level + 1)

    def _reached(self, docs: DataFrame) -> list[tuple[Texts, int, int]]:
        """The earlier batches that hold any of docs (doc), each with the least and greatest of those."""
        if not self.texts:
            return []
        mine = lambda t: F.when(F.col("doc").between(t.low, t.high), F.col("doc"))
        # one pass; batches share at most a bound
        found = docs.agg(*(f(mine(t)).alias(f"{n}{i}") for i, t in enumerate(self.texts) for n, f in (("a", F.min), ("b", F.max)))).first()
        return [(t, found[f"a{i}"], found[f"b{i}"]) for i, t in enumerate(self.texts) if found[f"a{i}"] is not None]

    def _windows(self, units: DataFrame, lists: DataFrame) -> DataFrame:
        """doc, wholes, fps: the windows of units whose fingerprint is in lists (doc, shared)."""
        return units.join(lists, "doc").select("doc", "bytes", "shared").mapInArrow(_verified(self.width, self.gram), "doc long, wholes array<long>, fps array<long>")

    def ingest(self, units: DataFrame, columns: list[Column] | None = None) -> DataFrame:
        """Adds units (doc long, th string, bytes binary; one row per different text of a doc) and returns, for each, what is left of it: columns, or doc, th, n_words, n_removed, kept (binary). A window goes if it starts in a document before."""
        columns = columns or [F.col(c.split(" ")[0]) for c in KEPT.split(", ")]
        bounds = units.agg(F.min("doc").alias("a"), F.max("doc").alias("b")).first()
        if bounds["a"] is None:
            return units.withColumn("repeated", F.lit(None).cast("array<bigint>")).mapInArrow(_kept(self.width, self.gram), KEPT).select(*columns)
        if self.last is not None and bounds["a"] < self.last:
            raise ValueError("a batch has to follow the earlier ones in order of document")
        name, texts = f"run-{uuid.uuid4().hex}", None
        if self.durable:
            texts = f"texts-{uuid.uuid4().hex}"
            units = stored_bucketed(units.select("doc", "th", "bytes").repartition(self.buckets, "doc"), f"{self.path}/{texts}", ["doc"], self.buckets)
        posting = stored(units.select("doc", "bytes").mapInArrow(_postings(self.width, self.gram), "fp long, doc long"), "postings")
        own = self._prints(posting.select("fp", F.col("doc").alias("least"), F.col("doc").alias("most")), name)
        runs = self.runs
        if runs:  # merge-joins of sorted buckets
            hits = functools.reduce(DataFrame.unionByName, (r.prints.join(own.hint("merge"), "fp", "left_semi") for r in runs))
            old = hits.groupBy("fp").agg(F.min("least").alias("first"), F.max("most").alias("last"))
            state = own.join(old, "fp", "left")
        else:
            state = own.withColumns({"first": F.lit(None).cast("long"), "last": F.lit(None).cast("long")})
        state = state.filter("least < most or first is not null")
        # fetch: the one earlier document whose windows haven't been computed
        shared = stored(state.select("fp", F.when(F.col("first") == F.col("last"), F.col("first")).alias("fetch")), "shared")
        lists = posting.join(shared.select("fp"), "fp").groupBy("doc").agg(F.collect_set("fp").alias("shared"))
        new = stored(self._windows(units, lists), "new")
        each = lambda df: df.select("doc", F.explode(F.arrays_zip("fps", "wholes")).alias("w")).select(F.col("w.fps").alias("fp"), F.col("w.wholes").alias("whole"), F.col("doc").alias("least"))
        fetched = shared.filter("fetch is not null").groupBy(F.col("fetch").alias("doc")).agg(F.collect_set("fp").alias("shared"))
        every = [each(new)]
        every += [each(self._windows(t.units.filter(F.col("doc").between(a, b)), fetched)) for t, a, b in self._reached(fetched)]
        windows = self._combined(functools.reduce(DataFrame.unionByName, every), name)
        # a document keeps the windows of which it is the least; so windows move once each, and not with every document
        first = windows.filter(F.col("least") >= F.lit(bounds["a"]))
        for r in runs:
            first = first.join(r.windows.select(*WINDOWS).hint("merge"), list(WINDOWS), "left_anti")
        own_windows = first.groupBy(F.col("least").alias("doc")).agg(F.collect_list("whole").alias("first"))
        held = new.groupBy("doc").agg(F.flatten(F.collect_list("wholes")).alias("wholes")).join(own_windows, "doc", "left")
        gone = held.select("doc", F.array_except("wholes", F.coalesce("first", F.array().cast("array<long>"))).alias("repeated"))
        if bounds["b"] >= NULLS:  # among null doc_ids none comes before another
            named = functools.reduce(DataFrame.unionByName, (w.filter(F.col("least") < NULLS).select(*WINDOWS) for w in (windows, *(r.windows for r in runs))))
            later = each(new.filter(F.col("doc") >= NULLS)).withColumnRenamed("least", "doc").join(named, list(WINDOWS), "left_semi")
            gone = gone.filter(F.col("doc") < NULLS).unionByName(later.groupBy("doc").agg(F.collect_set("whole").alias("repeated")))
        left = units.join(gone, "doc", "left").select("doc", "th", "bytes", "repeated").mapInArrow(_kept(self.width, self.gram), KEPT)
        out = stored(left.select(*columns), "left")
        for done in (posting, shared, new):
            dropped(done)
        self.last = bounds["b"]
        self.texts.append(Texts(texts, units, bounds["a"], bounds["b"]))
        self._add(Run(name, own, windows))
        self._save()
        return out


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = 3, fanout: int = 2, derive: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (string, the words left joined by one space); or, for kept, the columns that derive computes from it as binary.

    A word goes if a window over it also starts in a document with a smaller doc_id; windows are those of the input.
    Equal texts are worked on once, in their smallest document; later copies of `width` words or more lose all. Null
    and empty texts have no words; texts of any length are taken whole. Null doc_ids rank after all others, and none of
    them before another; others are below 2**63 - 2**32. Repeated doc_ids are no earlier documents to each other and keep
    their rows. Other columns are ignored; an empty table gives no rows. The documents go in as `batches` batches in order
    of doc_id, and every `fanout` runs of a level are compacted.
    """
    has_columns(docs, ["doc_id", "text"])
    derive = derive or {"kept": lambda kept: kept.cast("string")}
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    th = F.coalesce(F.sha2(text_bytes(), 256), F.lit(""))
    nulls = F.lit(NULLS) + F.pmod(F.xxhash64(th), F.lit(2**32))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), nulls).alias("doc"), th.alias("th"), text_bytes().alias("bytes"))
    narrow = stored(rows.select("doc_id", "doc", "th"), "texts")
    first = narrow.groupBy("th").agg(F.min("doc").alias("doc"))
    # a row for each text in its smallest document; copies of it there are told apart nowhere
    own = first.groupBy("doc").agg(F.collect_set("th").alias("own"))  # a doc_id's different texts: one, but for repeated doc_ids
    units = rows.drop("doc_id").repartition(buckets, "doc").join(own, "doc").filter(F.array_contains("own", F.col("th"))).select("doc", "th", "bytes")
    with partitions_kept(spark):
        units = stored_bucketed(units, new_path(spark, "units"), ["doc"], buckets)
    cuts = first.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    index, parts = FingerprintIndex(spark, width, gram, buckets, fanout), []
    columns = [F.col("th"), F.col("doc").alias("unit"), F.col("n_words"), F.col("n_removed"), *(f(F.col("kept")).alias(n) for n, f in derive.items())]
    for low, high in zip(edges, edges[1:], strict=False):
        part = units if low is None else units.filter(F.col("doc") > low)
        part = part if high is None else part.filter(F.col("doc") <= high)
        parts.append(index.ingest(part, columns))
    left = functools.reduce(DataFrame.unionByName, parts).dropDuplicates(["th", "unit"])
    later = _before(F.col("unit"), F.col("doc")) & (F.col("n_words") >= width)
    nothing = {n: f(F.lit(b"")) for n, f in derive.items()}
    return narrow.join(left, "th").select("doc_id", "n_words", F.when(later, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), *(F.when(later, v).otherwise(F.col(n)).alias(n) for n, v in nothing.items()))
