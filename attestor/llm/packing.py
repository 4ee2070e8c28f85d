"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Lengths fall into reciprocal-capacity classes. Documents may be cut, so a document is split into pieces whose lengths are
exactly capacity // k (k = 1, 2, 3 ...) as long as that is at least `small`, greedily from the longest, and a rest below
`small`, which is a class of its own length. All pieces of a class are equally long and its bins take a fixed number of
pieces, capacity // length; so a piece's bin and offset follow from its rank in the class alone. Each worker ranks its
own pieces and the counts of (worker, class) give every worker its first rank: no worker waits for another's bins. The
last, unfilled bin of each class is undone; those pieces, whose number has a bound that depends on the capacity only,
are packed by first fit. A full bin of class length s wastes capacity mod s, fewer than capacity // s or s tokens.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import batches_bounded, has_columns, stored, text_bytes

CAPACITY, SMALL, END_ID = 4096, 64, 2
#: Chunks and their parts whose ids a Python worker remembers: those of the last turn and of the one before, each of so many; and the bytes of the longest of them.
REMEMBERED, LONGEST = 200_000, 64
_tokenizers: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# fixed values: how a tokenizer's file has to prepare texts for the way by chunks, and its pattern of what is tokenised by itself, for plain and for Latin letters
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
_PLAIN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_LATIN = regex.compile(_PATTERN)
_IS_PLAIN, _IS_LATIN = re.compile(rb"[!-~]*").fullmatch, re.compile("[!-~\u00c0-\u024f]*").fullmatch


def by_chunks(path: str) -> bool:
    """Whether the file's tokenizer prepares texts as Encoder's way by chunks does; all its added tokens begin with "<|"."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    steps = lambda x, many: x.get(many) if (x or {}).get("type") == "Sequence" else None
    added = all(t["content"].startswith("<|") for t in d.get("added_tokens") or [])
    return added and d["model"].get("type", "BPE") == "BPE" and steps(d.get("normalizer"), "normalizers") == _NORMALIZERS and steps(d.get("pre_tokenizer"), "pretokenizers") == _SPLITS


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others in order from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class _Chunks(dict):
    """Ids by chunk, and by part, which as a chunk would be its only part; a new one is encoded when it is first looked up. What was looked up in the turn before comes back from `before`."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.before, self.letters = tokenizer, tokenizer.model, {}, _byte_letters()

    def turn(self) -> None:
        """Forgets what hasn't been looked up in this turn."""
        self.before = dict(self)
        self.clear()

    def whole(self, text: bytes) -> bytes:
        return _packed(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _part(self, part: bytes) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            text = part.decode() if part.isascii() else "".join(map(self.letters.__getitem__, part))
            ids = _packed([t.id for t in self.model.tokenize(text)])
        return self._kept(part, ids)

    def _kept(self, chunk: bytes, ids: bytes) -> bytes:
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk)
        return self._kept(chunk, self._ids(chunk) if ids is None else ids)

    def _ids(self, chunk: bytes) -> bytes:
        if _IS_PLAIN(chunk):
            parts = _PLAIN.findall(chunk)
        else:
            text = chunk.decode("utf-8", "replace")
            parts = [x.encode() for x in _LATIN.findall(text.lower())] if _IS_LATIN(text) else None
        find = self.get
        return self.whole(chunk) if parts is None else b"".join([find(x) or self._part(x) for x in parts])


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, as the tokenizer gives them for the whole text.

    The tokenizer lower-cases and never joins tokens over white space, nor over the parts its pattern cuts a word into.
    So texts are cut at ASCII white space, A-Z is lowered, and every chunk is looked up; a new one of plain or Latin
    letters is cut into those parts and every different part goes through the BPE model once. Other new chunks, and
    texts with "<|", which may hold a special token's string, go through the whole tokenizer; so does everything if the
    file prepares texts in another way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known, self.chunked = _Chunks(Tokenizer.from_file(path)), by_chunks(path)

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        known, out = self.known, []
        for t in texts:
            if len(known) > REMEMBERED:
                known.turn()
            t = t or b""
            out.append(known.whole(t) if not self.chunked or b"<|" in t else b"".join(map(known.__getitem__, t.lower().split())))
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str) -> Encoder:
    """The worker's encoder for the file; it stays for later tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def cut(n: int, capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """The lengths of a document's pieces, in order."""
    pieces = [capacity] * (n // capacity)
    n %= capacity
    while n:
        if n < small:
            pieces.append(n)
            break
        size = capacity // (capacity // (n + 1) + 1)  # the longest reciprocal length of at most n
        if size < small:
            size = small if n >= small else n
        pieces.append(size)
        n -= size
    return pieces


def _pieces(path: str, capacity: int, small: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]):
        encode, part = encoder(path), TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            doc, start, length, crc, tokens, rank = [], [], [], [], [], []
            for i, x in enumerate(b.column("bytes")):
                ids = encode([x.as_py()])[0] + end
                at = 0
                for size in cut(len(ids) // 4, capacity, small):
                    doc.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    tokens.append(len(ids) // 4)
                    rank.append(ranks.get(size, 0))
                    ranks[size] = rank[-1] + 1
                    at += size
            long = lambda x: pa.array(x, pa.int64())
            yield pa.record_batch([b.column("doc_id").take(long(doc)), long(start), long(length), long(crc), long(tokens), pa.array([part] * len(doc), pa.int64()), long(rank)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    return run


def first_fit(capacity: int):
    """Packs the pieces left over from unfilled bins, long ones first."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "place"], ascending=[False, True], kind="stable").reset_index(drop=True)
        room: list[int] = []
        bins, offsets = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
        lowest, last = 0, None
        for i, size in enumerate(frame["length"].to_numpy()):
            if size != last:
                lowest, last = 0, size  # bins too full for one piece are so for all of its length
            while lowest < len(room) and room[lowest] < size:
                lowest += 1
            if lowest == len(room):
                room.append(capacity)
            bins[i], offsets[i] = lowest, capacity - room[lowest]
            room[lowest] -= size
        return frame.assign(bin=bins, offset=offsets)[["length", "place", "bin", "offset"]]

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, small: int = SMALL, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated and null doc_ids are packed as further documents. Other columns
    are ignored; an empty table gives no rows. sequence_id is unique but not dense.
    """
    has_columns(docs, ["doc_id", "text"])
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    with batches_bounded(docs.sparkSession):
        pieces = stored(docs.select("doc_id", text_bytes().alias("bytes")).mapInArrow(_pieces(path, capacity, small, end_id), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long"), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = stored(counts, "counts")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    classes = counts.groupBy("length").agg(F.sum("n").alias("total"))
    table = before.join(classes, "length").select("length", "part", F.coalesce("before", F.lit(0)).alias("before"), "total")
    per = F.expr(f"{capacity} div length")
    ranked = pieces.join(table, ["length", "part"]).withColumn("place", F.col("before") + F.col("rank"))
    full = F.col("place") < F.expr(f"total div ({capacity} div length) * ({capacity} div length)")
    slots = F.lit(2 * capacity)  # of ids a bin number is spread over, so that classes don't meet
    placed = ranked.filter(full).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.expr(f"place div ({capacity} div length)") * slots + F.col("length")).alias("sequence_id"), (F.col("place") % per * F.col("length")).alias("offset"))
    rest = ranked.filter(~full)
    bins = rest.select("length", "place").groupBy().applyInPandas(first_fit(capacity), "length long, place long, bin long, offset long")
    late = rest.join(bins, ["length", "place"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("bin") * slots + F.lit(capacity + 1)).alias("sequence_id"), "offset")
    return placed.unionByName(late)
