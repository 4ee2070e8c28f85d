"""Language identification by prediction by partial matching.

For each language a context tree over bytes, DEPTH bytes deep, counts which byte follows each context. A byte is coded
after the longest context that the tree holds: with its share there, or by an escape to the next shorter context and at
last to all 256 bytes alike; the escape's share is that of the number of different bytes seen (method C). The counts are
frozen after training. Every counted context is kept: the costs of what follows it, and of its escape, are in hash tables
by order, which grow with the training sample only; contexts of one byte and none are a plain table. A whole text is
scored by looking its bytes up; the language with the shortest code is predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import different_by_hash, has_columns, kinds_of, text_bytes

#: Documents a language is learned from, at most; those first by a hash of doc_id.
TRAIN_DOCS = 400
#: Bytes of the longest context; languages in one index.
DEPTH, GROUP = 4, 8
UNKNOWN = "und"
#: Symbols: bytes, and the start of a text; bits of one.
START, SYMBOLS, BITS = 256, 257, 9
_STEP = 1 << 18


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents no prediction may learn from; a null doc_id is one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def grams_of(text: bytes, depth: int = DEPTH) -> np.ndarray:
    """A number for each byte of the text with its context; symbols 256 stand before the text."""
    s = np.concatenate([np.full(depth, START, np.int64), np.frombuffer(text, np.uint8).astype(np.int64)])
    out = np.zeros(len(text), np.int64)
    for i in range(depth + 1):
        out = out << BITS | s[i : i + len(text)]
    return out


def _grams(depth: int):
    def run(batches):
        for b in batches:
            langs, keys, counts = [], [], []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("bytes"), strict=True):
                k, n = np.unique(grams_of(text.as_py(), depth), return_counts=True)
                langs += [lang] * len(k)
                keys.append(k)
                counts.append(n)
            empty = [np.empty(0, np.int64)]
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(np.concatenate(keys or empty)), pa.array(np.concatenate(counts or empty))], names=["lang", "gram", "n"])

    return run


def _last(numbers: np.ndarray, symbols: int) -> np.ndarray:
    """The numbers of so many of the last symbols."""
    return numbers & ((1 << BITS * symbols) - 1)


class Index:
    """Rows of bits by number (0 and up), in open addressing; all other numbers have none."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.rows = rows
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            slots, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[slots], self.values[slots] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        at = self._first(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Tree:
    """The frozen costs of one language from its grams (of depth + 1 symbols) and how often each was seen."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int = DEPTH):
        short, self.seen, self.escapes = np.full((1, SYMBOLS), 8.0), {}, {}  # order -1: all bytes alike
        for order in range(depth + 1):
            keys, inverse = np.unique(_last(grams, order + 1), return_inverse=True)
            count = np.bincount(inverse, weights=n)
            contexts, place = np.unique(keys >> BITS, return_inverse=True)
            total, kinds = np.bincount(place, weights=count), np.bincount(place)
            own, escape = -np.log2(count / (total + kinds)[place]), -np.log2(kinds / (total + kinds))
            if order < 2:
                table = np.repeat(short, SYMBOLS, axis=0) if order else short.copy()
                table[contexts] += escape[:, None]
                table[keys >> BITS, _last(keys, 1)] = own
                short = table
            else:
                self.seen[order], self.escapes[order] = (keys, own.astype(np.float32)), (contexts, escape.astype(np.float32))
        self.short = np.broadcast_to(short, (SYMBOLS, SYMBOLS)).astype(np.float32)

    def costs(self, numbers: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last symbol of each number after `order` symbols before it, if no longer context is looked at."""
        out, left = np.zeros(len(numbers), np.float32), np.arange(len(numbers))
        for o in range(order, 1, -1):
            keys, own = self.seen[o]
            numbers = _last(numbers, o + 1)
            at = np.minimum(np.searchsorted(keys, numbers), len(keys) - 1)
            hit = keys[at] == numbers
            out[left[hit]] += own[at[hit]]
            left, numbers = left[~hit], numbers[~hit]
            out[left] += self.escaped(numbers >> BITS, o)
        out[left] += self.short[_last(numbers >> BITS, 1), _last(numbers, 1)]
        return out

    def escaped(self, contexts: np.ndarray, order: int) -> np.ndarray:
        """Bits of the escape from each context; none from one that the tree doesn't hold."""
        keys, escape = self.escapes[order]
        at = np.minimum(np.searchsorted(keys, contexts), len(keys) - 1)
        return np.where(keys[at] == contexts, escape[at], np.float32(0))


class Group:
    """Some languages' trees in one index: a row has the cost in each of them, whichever of them has seen it."""

    def __init__(self, trees: list[Tree], depth: int):
        every = lambda c, o: np.unique(np.concatenate([getattr(t, c)[o][0] for t in trees]))
        stack = lambda keys, f: Index(keys, np.stack([f(t, keys) for t in trees], axis=1))
        self.depth = depth
        self.seen = {o: stack(every("seen", o), lambda t, k, o=o: t.costs(k, o)) for o in range(2, depth + 1)}
        self.escapes = {o: stack(every("escapes", o), lambda t, k, o=o: t.escaped(k, o)) for o in range(2, depth + 1)}
        self.short = np.stack([t.short for t in trees], axis=2)

    def costs(self, numbers: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language, from numbers as grams_of gives them."""
        out, left = np.zeros((len(numbers), self.short.shape[2]), np.float32), np.arange(len(numbers))
        for order in range(self.depth, 1, -1):
            numbers = _last(numbers, order + 1)
            at = self.seen[order].find(numbers)
            hit, miss = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            out[left[hit]] += self.seen[order].rows[at[hit]]
            left, numbers = left[miss], numbers[miss]
            at = self.escapes[order].find(numbers >> BITS)
            hit = np.flatnonzero(at >= 0)
            out[left[hit]] += self.escapes[order].rows[at[hit]]
        out[left] += self.short[_last(numbers >> BITS, 1), _last(numbers, 1)]
        return out


class Model:
    """The trees of some languages."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], depth: int = DEPTH):
        if depth < 1:
            raise ValueError("contexts have a byte at least")
        self.langs, self.depth, self._groups = langs, depth, None
        self.trees = [Tree(k, n, depth) for k, n in counts]

    @property
    def groups(self) -> list[Group]:
        """Built where they are used: what is sent holds each cost once. Rows are as wide as a group, so that they grow with the languages and not with their square."""
        if self._groups is None:
            self._groups = [Group(self.trees[i : i + GROUP], self.depth) for i in range(0, len(self.trees), GROUP)]
        return self._groups

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each whole text in each language; texts are worked on in pieces of 256 KB, short ones together."""
        out = np.zeros((len(texts), len(self.langs)))
        block, ids, held = [], [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), _STEP):
                piece = t[max(0, at - self.depth) : at + _STEP]
                block.append(grams_of(piece, self.depth)[min(at, self.depth) :])
                ids.append(i)
                held += len(block[-1])
                if held >= _STEP:
                    self._add(out, ids, block)
                    block, ids, held = [], [], 0
        if block:
            self._add(out, ids, block)
        return out

    def _add(self, out: np.ndarray, ids: list[int], block: list[np.ndarray]) -> None:
        numbers = np.concatenate(block)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in block])[:-1]])
        for at, group in enumerate(self.groups):
            np.add.at(out[:, at * GROUP : (at + 1) * GROUP], ids, np.add.reduceat(group.costs(numbers), starts, axis=0, dtype=np.float64))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language with the shortest code, of equal ones the first by name, and its probability if all are equally likely beforehand."""
        bits = self.bits(texts)
        best = bits.argmin(axis=1)
        with np.errstate(under="ignore"):
            share = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
        return [self.langs[i] for i in best], share


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, depth: int = DEPTH) -> Model | None:
    """A model from documents with text and lang that aren't held out; None if there are none. At most train_docs different rows (id and text) a language are read, however often an id or a row is repeated."""
    mark = F.xxhash64("text").alias("mark")
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = labelled.select("doc_id", "lang", mark)
    chosen = different_by_hash(ids, "lang", train_docs, ["doc_id", "mark"], kinds_of(ids, "lang", ["doc_id", "mark"]))
    # at most train_docs rows a language are broadcast; copies of one are merged before they move
    texts = labelled.select("doc_id", "lang", mark, text_bytes().alias("bytes")).join(F.broadcast(chosen), ["doc_id", "lang", "mark"])
    rows = texts.groupBy("doc_id", "lang", "mark").agg(F.first("bytes").alias("bytes")).select("lang", "bytes")
    grams = rows.mapInArrow(_grams(depth), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = grams.toArrow()  # bounded by the chosen documents
    if not found.num_rows:
        return None
    langs, gram, n = np.array(found["lang"].to_pylist(), dtype=object), found["gram"].to_numpy(), found["n"].to_numpy()
    names = sorted(set(langs))
    order = np.argsort(gram, kind="stable")
    langs, gram, n = langs[order], gram[order], n[order]
    return Model(names, [(gram[langs == x], n[langs == x]) for x in names], depth)


def _predicted(model):
    def run(batches):
        m = model.value
        for b in batches:
            letters = b.column("letters").to_pylist()
            texts = [t or b"" for t in b.column("bytes").to_pylist()]
            langs, score = m.predict(texts) if m else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array([x if y else UNKNOWN for x, y in zip(langs, letters, strict=True)], pa.string()), pa.array([float(x) if y and m else 0.0 for x, y in zip(score, letters, strict=True)], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text.

    Null texts, those without a letter, and all texts if nothing could be learned are `und` with score 0; so is an empty
    text. Long texts are scored whole, in pieces that keep their contexts. Repeated rows keep theirs; ties go to the
    language first by name; a null doc_id is held out; other columns are ignored; an empty table gives no rows. What is
    broadcast grows with the languages, each of which has at most train_docs documents to learn from.
    """
    has_columns(docs, ["doc_id", "text", "lang"])
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, train_docs, depth))
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), text_bytes().alias("bytes"))
    return rows.mapInArrow(_predicted(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
