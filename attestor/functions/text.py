"""Text, id and JSON expressions. All are Column to Column; only Unicode normalisation and raw vector bytes need Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.vectors import let

SENTENCE_END = r"(?<=[.!?])\s+"
BLANK_LINE = r"\n\s*\n"
#: Texts that are composed at once.
NFC_ROWS = 256

# fixed values: kinds of page elements, in the order in which ids are tried
ELEMENT_KINDS = ("header_cell", "table_caption", "sentence", "cell", "item")
LOCAL_KINDS = ("_header_cell_", "_table_caption_", "_sentence_", "_cell_", "_item_", "_section_", "_list_", "_title")
PAGE_KINDS = ("_sentence_", "_cell_", "_section_", "_table_", "_list_")


def strip(c: Column) -> Column:
    """Without white space at both ends, by Unicode's definition."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    """Trimmed, runs of white space as one space; null as empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def wiki_cleanup(c: Column, underscores: bool = True) -> Column:
    """Links become their display text; underscores become spaces unless told otherwise."""
    c = F.regexp_replace(c, r"\[\[[^\|\]]+\|([^\]]+)\]\]", "$1")
    c = F.regexp_replace(c, r"\[\[([^\]]+)\]\]", "$1")
    return F.replace(c, F.lit("_"), F.lit(" ")) if underscores else c


def sentences(c: Column, longer_than: int = 20) -> Column:
    """Parts between ends of sentences, trimmed, of more than longer_than characters."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: F.length(s) > longer_than)


def paragraphs(c: Column, group: int = 5) -> Column:
    """Parts between blank lines; a text without any is cut into groups of sentences."""
    parts = F.split(c, BLANK_LINE)
    starts = lambda r: F.sequence(F.lit(0), F.floor((F.size(r) - 1) / group).cast("int"))
    grouped = let(F.split(c, SENTENCE_END), lambda r: F.transform(starts(r), lambda i: F.concat_ws(" ", F.slice(r, i * group + 1, F.lit(group)))))
    return F.filter(F.transform(F.when(F.size(parts) <= 1, grouped).otherwise(parts), strip), lambda p: p != "")


def prompt_segments(c: Column, most: int = 8, least_chars: int = 40) -> Column:
    """Paragraphs of a prompt; with fewer than two long enough, sentence-like parts; with none, the whole; at most `most`."""
    text = strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")))
    long_parts = lambda pattern: F.filter(F.transform(F.split(text, pattern), strip), lambda p: F.length(p) >= least_chars)
    by_blank, by_end = long_parts(BLANK_LINE), long_parts(r"(?<=[.?!])\s+(?=[A-Z(])")
    parts = F.when(F.size(by_blank) < 2, by_end).otherwise(by_blank)
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(text)).otherwise(F.slice(parts, 1, most))


def contract_spans(c: Column, longer_than: int = 30) -> Column:
    """Sentences of a contract: line ends as spaces, cut at a full stop and a space."""
    return F.filter(F.transform(F.split(F.replace(c, F.lit("\n"), F.lit(" ")), r"\. "), strip), lambda s: F.length(s) > longer_than)


def contract_claim(question: Column, answer: Column) -> Column:
    return F.format_string("The %s in this contract is %s.", F.lower(strip(question)), strip(answer))


def stable_unique(c: Column) -> Column:
    """Different values in order of first occurrence."""
    return F.array_distinct(c)


def first_text(*columns: Column) -> Column:
    """The first that is not null or blank, trimmed."""
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in columns))


def first_list(*columns: Column) -> Column:
    """The first array that is not empty."""
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in columns))


def required_ids(content: Column, context: Column) -> Column:
    """Content ids, then the ids in context of each of them; different ones in order."""
    extra = F.flatten(F.transform(content, lambda c: F.coalesce(F.try_element_at(context, c), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(content, extra))


def all_ids(content: Column, context: Column) -> Column:
    """As required_ids, with the keys and all values of context."""
    return F.array_distinct(F.concat(content, F.map_keys(context), F.flatten(F.map_values(context))))


def element_parts(c: Column) -> Column:
    """struct(page, kind, rest) of an element id; null where no kind is in it."""
    part = lambda page, kind, rest: F.struct(page.alias("page"), F.lit(kind).alias("kind"), rest.alias("rest"))
    title = part(F.regexp_replace(c, "_title$", ""), "title", F.lit(""))
    out = F.when(c.endswith("_title"), title)
    for kind in ("section", "list"):
        pattern = rf"(?s)^(.*)_{kind}_(\d+)$"
        out = out.when(c.rlike(pattern), part(F.regexp_extract(c, pattern, 1), kind, F.regexp_extract(c, pattern, 2)))
    for kind in ELEMENT_KINDS:
        pattern = rf"(?s)^(.*)_{kind}_(.*)$"
        out = out.when(c.contains(f"_{kind}_"), part(F.regexp_extract(c, pattern, 1), kind, F.regexp_extract(c, pattern, 2)))
    return out


def element_local(c: Column) -> Column:
    """struct(page, local): the id cut before its kind; else at the last underscore."""
    cut = lambda pattern: F.struct(F.regexp_extract(c, pattern, 1).alias("page"), F.regexp_extract(c, pattern, 2).alias("local"))
    out = None
    for kind in LOCAL_KINDS:
        found = cut(rf"(?s)^(.*)_({kind[1:]}.*)$")
        out = F.when(c.contains(kind), found) if out is None else out.when(c.contains(kind), found)
    return out.when(c.contains("_"), cut(r"(?s)^(.*)_([^_]*)$"))


def element_named(c: Column) -> Column:
    """struct(page, local), both null unless the id has a known kind, and a rest except for a title."""
    c = strip(c)
    pattern = r"(?s)^(.+?)_(header_cell|table_caption|sentence|section|title|cell|item|list)(?:_(.+))?$"
    page, kind, rest = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    local = F.when(kind == "title", kind).when(rest != "", F.concat(kind, F.lit("_"), rest))
    return F.struct(F.when(local.isNotNull() & (kind != ""), strip(page)).alias("page"), F.when(kind != "", strip(local)).alias("local"))


def page_of(c: Column) -> Column:
    """The page an element id is on, as well as can be told."""
    out = None
    for kind in PAGE_KINDS:
        found = F.substring_index(c, kind, 1)
        out = F.when(c.contains(kind), found) if out is None else out.when(c.contains(kind), found)
    parts = F.split(c, "_")
    return out.when(c.endswith("_title"), F.regexp_replace(c, "_title$", "")).when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), "_")).otherwise(c)


def pages_of(ids: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda i: i.isNotNull() & (i != "")), page_of))


def valid_text(c: Column) -> Column:
    """5 to 20000 characters, one of them an ASCII letter or digit."""
    return F.coalesce(F.length(c).between(5, 20000) & c.rlike("[A-Za-z0-9]"), F.lit(False))


def number_at(path: str) -> Column:
    """A nested number, 0.0 where it is missing."""
    return F.coalesce(F.col(path).cast("double"), F.lit(0.0))


def claim_id(claim: Column) -> Column:
    return F.sha1(normalised(claim).cast("binary"))


def evidence_id(evidence: Column) -> Column:
    kept = F.filter(F.transform(evidence, normalised), lambda e: e != "")
    return F.sha1(F.array_join(kept, "\n").cast("binary"))


def pair_id(claim: Column, evidence: Column) -> Column:
    kept = F.filter(F.transform(evidence, normalised), lambda e: e != "")
    return F.sha1(F.concat(normalised(claim), F.lit("\n---EVIDENCE---\n"), F.array_join(kept, "\n")).cast("binary"))


def row_id(split: Column, pair: Column, policy: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", split, pair, policy).cast("binary")), 1, 16)


def text_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def entailment_key(premise: Column, hypothesis: Column) -> Column:
    return F.sha2(F.concat(strip(premise), F.lit("|||"), strip(hypothesis)).cast("binary"), 256)


def to_int(c: Column) -> Column:
    """An integer, or null where the text is none."""
    return strip(c.cast("string")).try_cast("int")


@F.arrow_udf(T.StringType())
def nfc(c: pa.Array) -> pa.Array:
    """Unicode's composed form, trimmed. Few texts at a time become Python's, so that long ones don't add up."""
    done = ((None if x is None else unicodedata.normalize("NFC", x).strip() for x in c.slice(at, NFC_ROWS).to_pylist()) for at in range(0, len(c), NFC_ROWS))
    return pa.chunked_array([pa.array(x, pa.string()) for x in done], pa.string()).combine_chunks()


@F.pandas_udf(T.ArrayType(T.StringType()))
def title_variants(c: pd.Series) -> pd.Series:
    """Spellings under which a title may be stored, in order of preference."""

    def variants(title):
        if title is None:
            return None
        t = title.strip()
        plain = t.replace("–", "-").replace("—", "-")
        tries = (t, unicodedata.normalize("NFC", t), unicodedata.normalize("NFKC", t), plain, unicodedata.normalize("NFC", plain), t.replace("_", " "), t.replace(" ", "_"))
        return list(dict.fromkeys(x.strip() for x in tries if x.strip()))

    return c.map(variants)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_of_bytes(c: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    import numpy as np

    return c.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4").tolist())


@F.pandas_udf(T.BinaryType())
def bytes_of_vector(c: pd.Series) -> pd.Series:
    import numpy as np

    return c.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
