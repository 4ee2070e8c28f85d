"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades 0, 1, ... are ordered; for every threshold k the model gives the probability that the grade is at least k as the
logistic function of one score minus the threshold's own cut, so all thresholds share the score's weights. The score
adds a weight for each different word of a text, and the word's weight is the sum of those of the word itself and of its
beginnings of four, five and six bytes, which carry stems over to endings not seen in training. Features are hashed.
Features are counted by grade on the executors, and those that tell grades apart beyond chance enter the fit, which is by
proximal gradient steps with an absolute penalty and sets most weights to zero. The output is the expected severity: the
sum over thresholds of those probabilities.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import batches_bounded, different_by_hash, dropped, has_columns, kinds_of, stored, text_bytes

#: Labelled documents of one grade that the model learns from, at most; those first by a hash of doc_id.
TRAIN_DOCS = 4000
#: Bits of a feature's hash.
BITS = 22
#: Documents of the sample that a feature needs, and the standard deviations by which its share of toxic documents has to be off what chance gives.
LEAST, BEYOND = 3, 2.0
#: The penalty, as a share of the mean loss's slope.
PENALTY = 5e-5
#: Words whose weight a Python worker remembers, and the bytes of the longest of them.
REMEMBERED, LONGEST = 200_000, 64
_EDGES = b".,!?;:\"'()[]{}*&%$#|<>-_=+~`/\\"


def words_of(text: bytes | None) -> set[bytes]:
    """The different words, A-Z lowered and without punctuation around them."""
    return {w for w in (x.strip(_EDGES) for x in (text or b"").lower().split()) if w}


def features_of(word: bytes) -> list[int]:
    """Hashes of a word's features."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(word) & mask, *(zlib.crc32(b"^" + word[:n], n) & mask for n in (4, 5, 6) if len(word) >= n)]


def _features(batches):
    """A row's different features, ascending, and how many words have each, three at most."""
    for b in batches:
        names, counts = [], []
        for x in b.column("bytes"):
            n, c = np.unique(np.array([f for w in words_of(x.as_py()) for f in features_of(w)], dtype=np.int32), return_counts=True)
            names.append(n)
            counts.append(np.minimum(c, 3).astype(np.int8))
        yield pa.record_batch([b.column("grade"), pa.array(names, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int8()))], names=["grade", "features", "counts"])


class Ordinal:
    """weights: by feature hash. cuts: ascending, one for each threshold 1, 2, ..."""

    def __init__(self, weights: dict[int, float], cuts: np.ndarray):
        self.weights, self.cuts, self.known = weights, cuts, {}

    @classmethod
    def fit(cls, grades: np.ndarray, share: np.ndarray, sizes: np.ndarray, column: np.ndarray, value: np.ndarray, chosen: np.ndarray, top: int, rounds: int = 800, penalty: float = PENALTY) -> Ordinal:
        """grades 0 to top; share: the documents each stands for; sizes: the features of each; column and value: of all, one after the other, which of chosen and how often."""
        n = len(grades)
        share = share / share.sum()
        rows = np.repeat(np.arange(n, dtype=np.int32), sizes)
        value = value.astype(np.float64)
        weights = np.zeros(len(chosen))
        # cuts start at the grades' shares, smoothed so that a grade without documents has a finite cut
        above = np.array([(share * (grades >= k)).sum() for k in range(1, top + 1)])
        above = np.minimum.accumulate(np.clip(above, 1e-4, 1 - 1e-4)) * (1 - 1e-3) ** np.arange(top)
        cuts = np.log((1 - above) / above)
        hot = grades > 0
        # step: the loss curves by at most a quarter times the largest squared row norm, on average
        norms = np.bincount(rows, weights=value**2, minlength=n) + 1
        step = 4.0 / max(1e-9, float((share * norms).sum()))
        look, momentum = weights.copy(), 1.0
        for _ in range(rounds):
            score = np.bincount(rows, weights=value * look[column], minlength=n)
            low = np.where(hot, _sigmoid(score - np.concatenate([[0.0], cuts])[grades]), 1.0)
            high = np.where(grades < top, _sigmoid(score - np.append(cuts, 0.0)[grades]), 0.0)
            slope = -(1 - low - high)  # of the loss by the score
            weight_slope = np.bincount(column, weights=value * (share * slope)[rows], minlength=len(chosen))
            new = look - step * weight_slope
            new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
            after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            look = new + (momentum - 1) / after * (new - weights)
            weights, momentum = new, after
            chance = np.maximum(low - high, 1e-9)
            for k in range(top):
                up, down = grades == k + 1, grades == k
                at = _sigmoid(score - cuts[k])
                cut_slope = float((share * (np.where(up, 1.0, 0.0) - np.where(down, 1.0, 0.0)) * at * (1 - at) / chance).sum())
                cuts[k] -= 2.0 * cut_slope
            cuts = np.maximum.accumulate(cuts + np.arange(top) * 1e-9)
        return cls({int(c): float(w) for c, w in zip(chosen, weights, strict=True) if w}, cuts)

    def weight(self, word: bytes) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features_of(word))

    def score(self, text: bytes | None) -> float:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        words = words_of(text)
        new = {w: self.weight(w) for w in words.difference(known)}
        known.update((w, x) for w, x in new.items() if len(w) <= LONGEST)
        weights = [new[w] if w in new else known[w] for w in words]
        return float(np.sort(np.array(weights, np.float64)).sum())

    def scores(self, texts: Iterable[bytes | None]) -> np.ndarray:
        return np.fromiter(map(self.score, texts), np.float64)

    def at_least(self, texts: Iterable[bytes | None]) -> np.ndarray:
        """The probability of a grade of at least 1, 2, ... by text."""
        return _sigmoid(self.scores(texts)[:, None] - self.cuts)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(docs: DataFrame, graded: DataFrame, train_docs: int = TRAIN_DOCS) -> Ordinal | None:
    """From docs (doc_id, text) and graded (doc_id, grade; int, 0 and up; null: not labelled). At most train_docs different rows (id and text) a grade are read, however often one is repeated, each counting for its share of the grade. None without labels of two grades."""
    keys = ["doc_id", "mark"]
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), text_bytes().alias("bytes"))
    ids = marked.select(keys).join(graded.filter(F.col("grade").isNotNull()), "doc_id")
    sizes = kinds_of(ids, "grade", keys)
    found = {g: n for g, (n, _) in sizes.items()}
    if len(found) < 2:
        return None
    chosen = different_by_hash(ids, "grade", train_docs, keys, sizes)
    # at most train_docs rows a grade are broadcast; copies of one are merged before they move
    sample = marked.join(F.broadcast(chosen), keys).groupBy("grade", *keys).agg(F.first("bytes").alias("bytes"))
    with batches_bounded(docs.sparkSession):
        rows = stored(sample.select("grade", "bytes").mapInArrow(_features, "grade int, features array<int>, counts array<tinyint>"), "features")
    per_grade = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    total = sum(found[g] for g in per_grade)
    names = telling(rows, {g: found[g] / n / total for g, n in per_grade.items()}, sum(found[g] for g in per_grade if g > 0) / total)
    columns = docs.sparkSession.sparkContext.broadcast(names)
    got = rows.mapInArrow(_columns(columns), "grade int, features array<int>, counts array<tinyint>").toArrow().combine_chunks()
    dropped(rows)
    # rows in an order of their own, whatever that of the partitions
    marks = [zlib.crc32(x.values.to_numpy(), zlib.crc32(y.values.to_numpy())) for x, y in zip(got["features"], got["counts"], strict=True)]
    got = got.take(np.lexsort((marks, got["grade"].to_numpy()))).combine_chunks()
    grades = got["grade"].to_numpy().astype(np.int64)
    lists, counts = got["features"].combine_chunks(), got["counts"].combine_chunks()
    share = np.array([found[g] / per_grade[g] for g in grades.tolist()])
    return Ordinal.fit(grades, share, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), counts.flatten().to_numpy(), names, int(grades.max()))


def telling(rows: DataFrame, share: dict[int, float], rate: float, least: int = LEAST, beyond: float = BEYOND) -> np.ndarray:
    """The features, ascending, of rows (grade, features) in `least` documents or more whose share of toxic documents, rate overall, is off by `beyond` deviations or more. share: what a document of each grade stands for."""
    per = functools.reduce(lambda out, x: out.when(F.col("grade") == x[0], x[1]), list(share.items())[1:], F.when(F.col("grade") == next(iter(share)), next(iter(share.values()))))
    each = rows.select(F.explode("features").alias("feature"), per.alias("s"), (F.col("grade") > 0).alias("hit"))
    sums = each.groupBy("feature").agg(F.count("*").alias("n"), F.sum("s").alias("base"), F.sum(F.when(F.col("hit"), F.col("s")).otherwise(0.0)).alias("hits"), F.sum(F.col("s") * F.col("s")).alias("spread"))
    off = F.abs(F.col("hits") - rate * F.col("base")) >= beyond * F.sqrt(F.col("spread") * (rate * (1 - rate)))
    return np.sort(sums.filter((F.col("n") >= least) & off).select("feature").toArrow()["feature"].to_numpy())  # bounded by the sample


def _columns(names):
    """Of each row's features those in names, as places in it."""

    def run(batches):
        known = names.value
        for b in batches:
            lists, counts = b.column("features"), b.column("counts")
            f, c = lists.flatten().to_numpy(), counts.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, f), max(0, len(known) - 1))
            use = known[at] == f if len(known) else np.zeros(len(f), bool)
            ends = np.concatenate([[0], np.cumsum(use)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])].astype(np.int32)
            cut = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x[use], kind))
            yield pa.record_batch([b.column("grade"), cut(at.astype(np.int32), pa.int32()), cut(c, pa.int8())], names=["grade", "features", "counts"])

    return run


def _each(texts: pa.Array):
    """The texts one after the other, so that Python holds one besides Spark's batch."""
    return (x.as_py() for x in texts)


def _graded(model, threshold: float):
    def run(batches):
        m = model.value
        for b in batches:
            chance = m.at_least(_each(b.column("bytes"))) if m else np.zeros((b.num_rows, 1))
            severity = chance.sum(axis=1)
            yield pa.record_batch([*(b.column(c) for c in b.schema.names if c != "bytes"), pa.array(severity), pa.array((chance >= 0.5).sum(axis=1).astype(np.int32)), pa.array(chance[:, 0] >= threshold)], names=[*(c for c in b.schema.names if c != "bytes"), "severity", "grade", "toxic"])

    return run


def grade_of(toxic: str = "toxic", quality: str = "quality") -> Column:
    """Severity from labels: 0 clean, 1 toxic, 2 toxic and of low quality; null without a toxic label."""
    return F.when(F.col(toxic) == 0, 0).when(F.col(toxic) == 1, F.when(F.col(quality) == 0, 2).otherwise(1)).cast("int")


def grade(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), grade (the highest that is as likely as not), toxic (grade 1 or more has probability threshold or more).

    labels: doc_id, toxic, quality. Every whole text is graded, labelled or not and however long; a null or empty one has
    the score of no words. Without labels of two grades all severities are 0. Repeated rows keep theirs, null doc_ids
    too; labels that are repeated with other grades each count; null labels and labels without a document count for
    nothing. Other columns are ignored; an empty table gives no rows.
    """
    model = fitted(docs, labels, train_docs)
    rows = docs.select("doc_id", text_bytes().alias("bytes"))
    return rows.mapInArrow(_graded(model, threshold), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, severity double, grade int, toxic boolean")


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS):
    """The broadcast model; its weights are bounded by the sample."""
    has_columns(docs, ["doc_id", "text"])
    has_columns(labels, ["doc_id", "toxic", "quality"])
    graded = labels.select("doc_id", grade_of().alias("grade")).distinct()
    return docs.sparkSession.sparkContext.broadcast(train(docs, graded, train_docs))


def reject_toxic(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = 0.5) -> DataFrame:
    """docs without the rows graded toxic; columns as they are, whatever their names. Nulls, empty and long texts, repeated rows and missing labels are as in grade(); a text without words stays unless most documents are toxic."""
    model = fitted(docs, labels, train_docs)

    @F.arrow_udf("boolean")
    def toxic(texts: pa.Array) -> pa.Array:
        m = model.value
        return pa.array(m.at_least(_each(texts))[:, 0] >= threshold if m else np.zeros(len(texts), bool))

    return docs.filter(~toxic(text_bytes()))
