"""Tokeniser fertility against a plain version, on labels, and on odd rows."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from attestor.llm import fertility

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\v\f\r"


def words_of(text):
    out, word = [], ""
    for c in text + " ":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def plain_measures(text, model):
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    ids = [t for w in words for t in model.encode(w)]
    plain = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(ids))
    if not ids:
        return (*plain, None, None, None)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
    return (*plain, plain[1] / len(ids), sum(map(model.is_byte, ids)) / len(ids), entropy)


def quartile(values, q):
    values = sorted(values)
    at = q / 4 * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (values[math.ceil(at)] - values[low]) * (at - low)


def plain_kept(rows):
    """Of (lang, measures): whether each is kept."""
    failed = [m[0] < 50 or 100 * m[4] > 50 * m[0] for _, m in rows]
    length = [len(f"{m[5]:b}") - 1 for _, m in rows]
    groups = defaultdict(set)
    for (lang, m), bad, size in zip(rows, failed, length, strict=True):
        if not bad:
            groups[lang, size].add(m[6:])
            groups[lang, -1].add((size, *m[6:]))
    out = []
    for (lang, m), bad, size in zip(rows, failed, length, strict=True):
        group = groups[lang, size] if len(groups[lang, size]) >= 50 else [x[1:] for x in groups[lang, -1]]
        good = not bad
        if good and len(group) >= 50:
            for i, least in ((0, None), (1, 0.02), (2, 0.4)):
                low, high = quartile([x[i] for x in group], 1), quartile([x[i] for x in group], 3)
                reach = max(3 * (high - low), 0.05 * low if least is None else least)
                good = good and (low - reach <= m[6 + i] or i == 1) and m[6 + i] <= high + reach
        out.append(good)
    return failed, out


def test_against_plain(spark):
    pieces = fertility.Pieces(fertility.model_path())
    docs = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()
    rows = [(lang, plain_measures(text or "", pieces.model)) for _, text, lang in docs]
    failed, kept = plain_kept(rows)
    want = {d: (*m, b, k) for (d, _, _), (_, m), b, k in zip(docs, rows, failed, kept, strict=True)}
    got = fertility.quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(got) == len(want)
    for r in got:
        mine = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens, r.chars_per_token, r.byte_share, r.token_entropy, r.base_failed, r.kept)
        assert mine == pytest.approx(want[r.doc_id], rel=1e-9), r.doc_id
    assert {False, True} == {r.kept for r in got if not r.base_failed}


def test_labels(spark):
    """Of documents that pass the plain rules, at sf0.1: nearly all good ones stay, most poor ones go."""
    sf = "/root/testdata/sf0.1"
    got = fertility.quality(spark.read.parquet(f"{sf}/documents.parquet")).filter("not base_failed")
    rates = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rates}
    assert kept[1] > 0.99 and kept[0] < 0.5


def test_repeated_words():
    assert fertility.repeated_words(b"a b c x a b c".split()) == 6
    assert fertility.repeated_words(b"a a a a".split()) == 4
    assert fertility.repeated_words(b"a b c".split()) == fertility.repeated_words([]) == 0


ODD = [(1, None, "en"), (1, None, "en"), (2, "", None), (3, " \n\t", "fr"), (None, "один два три", None), (4, "中文字\u3000x y", None), (5, "a " * 300_000, "en"), (6, "#*$%&|<> " * 60 + "\n" + "x\nx\n y\ny", "xx")]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("carried", "band", "text__", "n_words", "kept", "length", "limits", "a.b")})
    rows = fertility.quality(docs).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[None].band == "script:Cyrillic" and by[4].band == "script:Han" and by[2].band == "script:none" and by[1].band == "lang:en"
    assert (by[4].n_words, by[4].word_chars) == (2, 6)  # only ASCII white space parts words
    assert (by[5].n_words, by[5].n_repeat_words, by[5].base_failed, by[5].token_entropy) == (300_000, 300_000, True, 0.0)
    assert (by[6].n_symbols, by[6].n_dup_lines) == (480, 1)
    assert by[1].n_tokens == 0 and by[1].chars_per_token is None and not by[1].kept
    assert fertility.keep_good(docs).columns == docs.columns and fertility.keep_good(docs).count() == 0
    assert fertility.quality(docs.limit(0)).count() == 0


def test_keep_good(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text, "en", i) for i in range(3)], "doc_id long, text string, lang string, `a.b` long")
    assert sorted(map(tuple, fertility.keep_good(docs).collect())) == [(i, text, "en", i) for i in range(3)]
