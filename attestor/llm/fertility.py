"""Quality by tokeniser fertility: how a public vocabulary cuts a text tells prose from what only looks like it.

Each word is tokenised by a SentencePiece vocabulary with byte fallback. A document's characters per token (shouting,
mojibake and identifiers fall into small pieces), its share of tokens that are single bytes (characters the vocabulary
doesn't know) and the entropy of its tokens in bits (repetition and tables have little, noise has much) are held against bands
of its language, or of its script where it has no language, among documents of about its length in tokens, as short texts
have less entropy and spread more. The bands are fences around the quartiles over all documents that pass the plain
rules, like measurements counted once, so that copies don't shift them; the quartiles are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import has_columns, stored, text_bytes
from attestor.operators.ranks import met, quantiles_of

#: The plain rules: fewer words fail, and so does a larger share (in per cent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: How many interquartile ranges a fence lies beyond its quartile; least distances: of characters a token as a share of the quartile, of byte shares and bits as they are; fewer different measurements make no bands.
FENCE, LEAST_SPREAD, LEAST_BYTES, LEAST_BITS, LEAST_GROUP = 3.0, 0.05, 0.02, 0.4, 50
ANY_LENGTH = -1
#: Words whose tokens a Python worker remembers; beyond it forgets all and starts again.
REMEMBERED = 400_000
SYMBOLS = b"#*$%&|<>"
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai"]
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
_models: dict = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """Token ids (little-endian 32-bit) by word; a word that is new is encoded when it is first looked up."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = np.array(self.model.encode(word.decode("utf-8", "replace"), num_threads=1), "<i4").tobytes()
        return ids


def pieces(path: str) -> Pieces:
    """The worker's tokens of the file; they stay for later tasks."""
    if path not in _models:
        _models[path] = Pieces(path)
    if len(_models[path]) > REMEMBERED:
        _models[path].clear()
    return _models[path]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(code.__getitem__, words), np.int64, n)
    pairs = np.unique(at[:-1] * len(code) + at[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * len(code) + at[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[window] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[again + k] = True
    return int(covered.sum())


def measure(text: bytes, known: Pieces) -> tuple:
    """The measures of one text, in their order; without words those of tokens are None."""
    words = text.split()  # bytes split at ASCII white space only
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, word_chars = len(words), len(b"".join(words).decode("utf-8", "replace"))
    plain = (n, word_chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))
    ids = np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4")
    if not len(ids):
        return (*plain, 0, None, None, None)
    times = np.bincount(ids)
    bytes_of = int(times[known.is_byte[: len(times)]].sum())
    share = times[times > 0] / len(ids)
    return (*plain, len(ids), word_chars / len(ids), bytes_of / len(ids), float(-(share * np.log2(share)).sum()) + 0.0)


def _measured(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.rsplit(" ", 1)[0] for x in MEASURES.split(", ")]
        types = [pa.int64()] * 6 + [pa.float64()] * 3
        for b in batches:
            known = pieces(path)
            rows = [measure(t or b"", known) for t in b.column("text__").to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.record_batch([b.column("carried"), b.column("band"), *columns], names=["carried", "band", *names])

    return run


def script(text: Column) -> Column:
    """The script of most letters among SCRIPTS, the first of equals; "none" without such a letter."""
    counts = F.array(*(F.struct(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(-i).alias("at"), F.lit(s).alias("name")) for i, s in enumerate(SCRIPTS)))
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["name"]).otherwise("none")


def bands(measured: DataFrame, fence: float = FENCE) -> DataFrame:
    """band, length (of documents of 2**length tokens up to twice as many; ANY_LENGTH: of all) and the limits of each measure.

    From the exact quartiles over the rows that pass the plain rules; measurements that are alike count once, and a group
    with fewer than LEAST_GROUP has no row.
    """
    distinct = measured.filter(~F.col("base_failed")).select("band", "length", "chars_per_token", "byte_share", "token_entropy").distinct()
    distinct = distinct.withColumn("length", F.explode(F.array("length", F.lit(ANY_LENGTH))))
    sized = distinct.groupBy("band", "length").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_GROUP)
    wanted = {f"{name}_{q}": (F.col(name), q / 4) for name in ("chars_per_token", "byte_share", "token_entropy") for q in (1, 3)}
    limits = quantiles_of(distinct, wanted, ["band", "length"]).join(sized.select("band", "length"), ["band", "length"])

    def around(name: str, least: Column) -> tuple[Column, Column]:
        low, high = F.col(f"{name}_1"), F.col(f"{name}_3")
        reach = F.greatest(fence * (high - low), least)
        return low - reach, high + reach

    chars = around("chars_per_token", LEAST_SPREAD * F.col("chars_per_token_1"))
    bits = around("token_entropy", F.lit(LEAST_BITS))
    return limits.select("band", "length", F.struct(chars[0].alias("chars_low"), chars[1].alias("chars_high"), around("byte_share", F.lit(LEAST_BYTES))[1].alias("bytes_high"), bits[0].alias("bits_low"), bits[1].alias("bits_high")).alias("limits"))


def _rated(docs: DataFrame, carried: Column, path: str | None, fence: float) -> DataFrame:
    group = F.when(F.col("lang").isNotNull(), F.concat(F.lit("lang:"), F.col("lang").cast("string"))).otherwise(F.concat(F.lit("script:"), script(F.coalesce(F.col("text"), F.lit("")))))
    rows = docs.select(carried.alias("carried"), group.alias("band"), text_bytes().alias("text__"))
    out = T.StructType([rows.schema["carried"], rows.schema["band"], *T.StructType.fromDDL(MEASURES)])
    rows = rows.mapInArrow(_measured(path or model_path()), out)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    length = F.when(F.col("n_tokens") > 0, F.length(F.bin("n_tokens")) - 1).otherwise(0)
    rows = stored(rows.withColumn("base_failed", failed).withColumn("length", length), "fertility")
    known = stored(bands(rows, fence), "fertility-bands")
    rated = met(rows, known, ["band", "length"])
    rated = met(rated, known.filter(F.col("length") == ANY_LENGTH).select("band", F.col("limits").alias("wide")), ["band"])
    x = F.coalesce("limits", "wide")
    within = F.col("chars_per_token").between(x["chars_low"], x["chars_high"]) & (F.col("byte_share") <= x["bytes_high"]) & F.col("token_entropy").between(x["bits_low"], x["bits_high"])
    return rated.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True))).drop("length", "limits", "wide")


def quality(docs: DataFrame, path: str | None = None, fence: float = FENCE) -> DataFrame:
    """doc_id, the MEASURES, band (the language or script whose bands held), base_failed and kept: a row for each of docs (doc_id, text, lang).

    A null text is one without words; it fails the plain rules, as all of fewer than 50 words do, and measures of tokens
    are null there. A language with fewer than 50 different measurements at a length takes its bands of all lengths, and with
    fewer than 50 in all it has none and nothing of it is rejected by them; without a language the script of most letters
    is taken. Texts are measured whole, however long; repeated rows
    have a row each; an empty table gives none; other columns are ignored. path: a SentencePiece model.
    """
    has_columns(docs, ["doc_id", "text", "lang"])
    return _rated(docs, F.col("doc_id"), path, fence).withColumnRenamed("carried", "doc_id")


def keep_good(docs: DataFrame, path: str | None = None, fence: float = FENCE) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns and whatever their names."""
    has_columns(docs, ["text", "lang"])
    return _rated(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), path, fence).filter("kept").select("carried.*")
