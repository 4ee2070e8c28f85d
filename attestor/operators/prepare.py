"""Preparation of inputs: converters, page elements, the evidence cache and what is complete in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as X
from attestor.operators.negatives import portable_hash

CACHE = "element_id string, ok boolean, text string, error string, kind string, page_id string, updated_at timestamp"


def missing_only(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What the cache lacks."""
    return wanted.join(cached.select(*keys), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    """One row a key, that written last; among equals the one that is last by all columns. Combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, at)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("x"))
    return best.select(*keys, "x.*").select(*rows.columns)


def build_facts(wanted: DataFrame, cached: DataFrame, resolved: DataFrame, key: str = "element_id") -> DataFrame:
    """One row about a cache build: wanted, hits (cached before), ok and failed (of the others, by resolved's ok)."""
    known = cached.select(key).distinct().withColumn("hit__", F.lit(True))
    new = resolved.select(key, "ok").groupBy(key).agg(F.bool_or("ok").alias("ok__"))
    rows = wanted.select(key).distinct().join(known, key, "left").join(new, key, "left")
    missed = F.col("hit__").isNull()
    return rows.agg(F.count("*").alias("wanted"), F.count("hit__").alias("hits"), F.count(F.when(missed & F.coalesce("ok__", F.lit(False)), 1)).alias("ok"), F.count(F.when(missed & ~F.coalesce("ok__", F.lit(False)), 1)).alias("failed"))


def sampled(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The first n rows by a hash of key that other engines compute alike."""
    return df.orderBy(portable_hash(seed, F.col(key)), key).limit(n)


def page_by_title(titles: DataFrame, pages: DataFrame, column: str = "title") -> DataFrame:
    """titles with the page that has the first of their spellings as its title; null columns where none has."""
    found = match_titles(titles.select(column).distinct(), pages, column)
    one = pages.withColumnRenamed("title", "found")
    return titles.join(found.join(one, "found", "left"), column, "left")


def load_counters(claims: DataFrame, complete: DataFrame, key: str = "id") -> DataFrame:
    """One row about a load: claims, sets, kept_claims, dropped_claims, complete_sets; complete is what complete_claims gives."""
    whole = claims.agg(F.count("*").alias("claims"), F.coalesce(F.sum(F.size("sets")), F.lit(0)).alias("sets"))
    kept = complete.agg(F.count("*").alias("kept_claims"), F.coalesce(F.sum(F.size("complete_sets")), F.lit(0)).alias("complete_sets"))
    return whole.crossJoin(kept).select("claims", "sets", "kept_claims", (F.col("claims") - F.col("kept_claims")).alias("dropped_claims"), "complete_sets")  # one row each


def upsert(cached: DataFrame, new: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    return latest(cached.unionByName(new), keys, at)


def failed(rows: DataFrame) -> DataFrame:
    """Failures as cache rows: the message cut to 500 characters, no text."""
    return rows.withColumn("ok", F.lit(False)).withColumn("text", F.lit(None).cast("string")).withColumn("error", F.substring("error", 1, 500))


def lookup(ids: DataFrame, resolved: DataFrame, key: str = "id", column: str = "ids") -> DataFrame:
    """key, texts in the order of the ids, cleaned of markup, and missing, the ids without a good text."""
    one = ids.select(key, F.posexplode(column).alias("at", "element_id"))
    good = resolved.filter("ok and text is not null").select("element_id", X.wiki_cleanup(F.col("text")).alias("text"))
    met = one.join(good, "element_id", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "element_id", "text"))).alias("x"))
    return met.select(key, F.transform(F.filter("x", lambda e: e["text"].isNotNull()), lambda e: e["text"]).alias("texts"), F.transform(F.filter("x", lambda e: e["text"].isNull()), lambda e: e["element_id"]).alias("missing"))


_CELL = "struct<id: string, value: string>"


def page_elements(pages: DataFrame, page_id: str = "page_id", body: str = "body", ordered_only: bool = True) -> DataFrame:
    """(page_id, local_id, text) for the title, sentences, sections, list items, table captions and cells of a page's JSON.

    With ordered_only, elements are those the page's `order` names; else all keys, and lists also give their joined text.
    """
    page = pages.select(page_id, F.get_json_object(body, "$.title").alias("title"), F.from_json(F.get_json_object(body, "$.order"), "array<string>").alias("order"), F.from_json(body, "map<string,string>").alias("m"))
    entries = page.select(page_id, "order", F.explode(F.map_entries("m")).alias("e")).select(page_id, "order", F.col("e.key").alias("k"), F.col("e.value").alias("v"))
    if ordered_only:
        entries = entries.filter(F.array_contains("order", F.col("k")))
    entries = entries.filter("v is not null")
    is_json = F.col("v").rlike(r"^\s*\{")
    sentence = entries.filter(F.col("k").startswith("sentence_") & ~is_json).select(page_id, F.col("k").alias("local_id"), F.col("v").alias("text"))
    section = entries.filter(F.col("k").startswith("section_") & is_json).select(page_id, F.col("k").alias("local_id"), F.get_json_object("v", "$.value").alias("text"))
    lists = entries.filter(F.col("k").startswith("list_") & is_json).select(page_id, "k", F.from_json(F.get_json_object("v", "$.list"), f"array<{_CELL}>").alias("items"))
    item = lists.select(page_id, F.explode("items").alias("i")).select(page_id, F.col("i.id").alias("local_id"), F.col("i.value").alias("text"))
    tables = entries.filter(F.col("k").startswith("table_") & is_json)
    caption = tables.select(page_id, F.concat(F.lit("table_caption_"), F.substring_index("k", "_", -1)).alias("local_id"), F.get_json_object("v", "$.caption").alias("text"))
    cells = tables.select(page_id, F.explode(F.flatten(F.from_json(F.get_json_object("v", "$.table"), f"array<array<{_CELL}>>"))).alias("c")).select(page_id, F.col("c.id").alias("local_id"), F.col("c.value").alias("text"))
    out = page.filter("title <> ''").select(page_id, F.lit("title").alias("local_id"), F.col("title").alias("text"))
    for part in (sentence, section, item, caption, cells):
        out = out.unionByName(part)
    if not ordered_only:
        joined = F.array_join(F.filter(F.transform("items", lambda i: X.strip(F.coalesce(i["value"], F.lit("")))), lambda x: x != ""), "\n")
        out = out.unionByName(lists.select(page_id, F.col("k").alias("local_id"), joined.alias("text")))
    return out.filter("local_id is not null and text is not null")


def resolve(ids: DataFrame, elements: DataFrame, column: str = "element_id") -> DataFrame:
    """element_id, page_id, kind, ok, text, error: missing_page, missing_element, bad_id or null. A title falls back to the page's id."""
    parts = ids.select(F.col(column).alias("element_id")).distinct().withColumn("p", X.element_parts(F.col("element_id")))
    parts = parts.select("element_id", F.col("p.page").alias("page_id"), F.col("p.kind").alias("kind"), F.when(F.col("p.kind") == "title", "title").otherwise(F.concat_ws("_", "p.kind", "p.rest")).alias("local_id"))
    found = parts.join(elements, ["page_id", "local_id"], "left").join(elements.select("page_id").distinct().withColumn("known", F.lit(True)), "page_id", "left")
    value = F.nullif(X.strip(F.coalesce("text", F.when(F.col("kind") == "title", F.col("page_id")))), F.lit(""))
    error = F.when(F.col("kind").isNull(), "bad_id").when(F.col("known").isNull(), "missing_page").when(value.isNull(), "missing_element")
    return found.select("element_id", "page_id", "kind", error.isNull().alias("ok"), F.when(error.isNull(), value).alias("text"), error.alias("error"))


def match_titles(ids: DataFrame, titles: DataFrame, column: str = "title") -> DataFrame:
    """column and found, the first spelling of it that titles has."""
    tries = ids.select(column).distinct().select(column, F.posexplode(X.title_variants(F.col(column))).alias("at", "try"))
    hits = tries.join(titles.select(F.col("title").alias("try")).distinct(), "try")
    return ids.join(hits.groupBy(column).agg(F.min_by("try", "at").alias("found")), column, "left")


def unique_element_ids(sets: DataFrame, content: str = "content", context: str = "context") -> DataFrame:
    return sets.select(F.explode(X.required_ids(F.col(content), F.col(context))).alias("element_id")).distinct()


def complete_claims(claims: DataFrame, resolved: DataFrame, vectors: DataFrame, key: str = "id", rule: str = "any") -> DataFrame:
    """Claims with their complete evidence sets only, if any (or all) of their sets are complete.

    claims: key, sets array<struct<content array<string>, context map<string, array<string>>>>. A set is complete if every
    id it requires has a good text and a vector. Claims without sets go.
    """
    if rule not in ("any", "all"):
        raise ValueError("rule is any or all")
    sets = claims.select(key, F.posexplode("sets").alias("set_at", "s")).withColumn("ids", X.required_ids(F.col("s.content"), F.coalesce(F.col("s.context"), F.create_map().cast("map<string,array<string>>"))))
    ready = resolved.filter("ok").select("element_id").distinct().join(vectors.select("element_id").distinct(), "element_id").withColumn("ready", F.lit(1))
    each = sets.select(key, "set_at", "s", F.explode_outer("ids").alias("element_id")).join(ready, "element_id", "left")
    by_set = each.groupBy(key, "set_at").agg(F.bool_and(F.col("ready").isNotNull()).alias("complete"), F.first("s").alias("s"))
    kept = by_set.groupBy(key).agg(F.bool_or("complete").alias("any"), F.bool_and("complete").alias("all"), F.array_sort(F.collect_list(F.when(F.col("complete"), F.struct("set_at", F.col("s.content").alias("content"))))).alias("complete_sets"))
    return claims.join(kept.filter(F.col(rule)).drop("any", "all"), key)


def cache_coverage(wanted: DataFrame, resolved: DataFrame, vectors: DataFrame, split: str = "split") -> DataFrame:
    """split, rows, missing_ids, repeated_ids, ok_share, vector_share of wanted element ids."""
    ok = resolved.filter("ok").select("element_id").distinct().withColumn("ok__", F.lit(1.0))
    vec = vectors.select("element_id").distinct().withColumn("vec__", F.lit(1.0))
    rows = wanted.join(ok, "element_id", "left").join(vec, "element_id", "left").fillna(0.0, ["ok__", "vec__"])
    return rows.groupBy(split).agg(F.count("*").alias("rows"), F.count(F.when(F.col("element_id").isNull(), 1)).alias("missing_ids"), (F.count("element_id") - F.count_distinct("element_id")).alias("repeated_ids"), F.avg("ok__").alias("ok_share"), F.avg("vec__").alias("vector_share"))


# --- converters to (id, claim, evidence, label) ---


def scientific_claims(claims: DataFrame, corpus: DataFrame, mode: str = "rationale") -> DataFrame:
    """claims: id, claim, evidence map<doc_id, array<struct<label, sentences array<int>>>>; corpus: doc_id, abstract array<string>. Rationale takes the sentences named and in range, abstract all; pairs without text go."""
    rows = claims.select("id", "claim", F.explode("evidence").alias("doc_id", "notes")).select("id", "claim", "doc_id", F.explode("notes").alias("note"))
    met = rows.join(corpus.select(F.col("doc_id").cast("string").alias("doc_id"), "abstract"), "doc_id")
    named = F.transform(F.filter("note.sentences", lambda i: (i >= 0) & (i < F.size("abstract"))), lambda i: F.get("abstract", i))
    return met.select("id", "claim", "doc_id", (named if mode == "rationale" else F.col("abstract")).alias("evidence"), F.col("note.label").alias("label")).filter(F.size("evidence") > 0)


def holdings(rows: DataFrame, wrong: int = 1, seed: int = 42, most: int = 8, least_chars: int = 40) -> DataFrame:
    """rows: example_id, citing_prompt, holdings array<string>, label (index, as text or number). The right holding has label 1; `wrong` others, by hash, 0."""
    right = X.to_int(F.col("label"))
    one = rows.select("example_id", "citing_prompt", right.alias("right"), F.posexplode("holdings").alias("at", "claim")).filter(X.strip(F.coalesce("claim", F.lit(""))) != "")
    one = one.withColumn("label", F.when(F.col("at") == F.col("right"), 1).otherwise(0)).filter("right is not null")
    turn = F.row_number().over(Window.partitionBy("example_id", "label").orderBy(portable_hash(seed, F.col("example_id"), F.col("at")), "at"))
    kept = one.withColumn("turn", turn).filter(F.when(F.col("label") == 1, True).otherwise(F.col("turn") <= wrong))
    return kept.select(F.concat_ws("_", F.col("example_id").cast("string"), F.col("at").cast("string")).alias("id"), F.col("example_id").cast("string").alias("group_id"), X.strip(F.col("claim")).alias("claim"), X.prompt_segments(F.col("citing_prompt"), most, least_chars).alias("evidence"), "label")


def unpivoted_summaries(rows: DataFrame) -> DataFrame:
    """rows: id, document, right_summary, hallucinated_summary; gives label 0 and 1."""
    out = rows.select("id", "document", F.expr("stack(2, right_summary, 0, hallucinated_summary, 1) as (claim, label)"))
    return out.filter(X.strip(F.coalesce("claim", F.lit(""))) != "").select("id", X.strip(F.col("claim")).alias("claim"), F.array("document").alias("evidence"), "label")


def contract_answers(rows: DataFrame, seed: int = 42) -> DataFrame:
    """rows: id, question, answer, text. Each claim with its answer has label 1, with another answer to the question (by hash) 0."""
    spans = X.contract_spans(F.col("text"))
    other = rows.select("question", F.col("answer").alias("wrong")).distinct()
    wrong = rows.join(other, "question").filter(F.col("answer") != F.col("wrong")).groupBy("id").agg(F.min_by("wrong", F.struct(portable_hash(seed, F.col("id"), F.col("wrong")), "wrong")).alias("wrong"))
    right = rows.select("id", X.contract_claim(F.col("question"), F.col("answer")).alias("claim"), spans.alias("evidence"), F.lit(1).alias("label"))
    return right.unionByName(rows.join(wrong, "id").select("id", X.contract_claim(F.col("question"), F.col("wrong")).alias("claim"), spans.alias("evidence"), F.lit(0).alias("label")))


def plain_pairs(rows: DataFrame, claim: str, evidence: str, label: Column | None = None) -> DataFrame:
    """Pairs from a claim column and an array of contexts; rows without either go."""
    out = rows.select(*(["id"] if "id" in rows.columns else []), X.strip(F.col(claim)).alias("claim"), F.filter(F.transform(evidence, X.strip), lambda e: e != "").alias("evidence"), (label if label is not None else F.lit(None).cast("int")).alias("label"))
    return out.filter("claim <> '' and size(evidence) > 0")


def routed(rows: DataFrame, label: str = "label", positive: tuple[str, ...] = ("Entailment", "entailment")) -> tuple[DataFrame, DataFrame]:
    """Rows of positive labels, and the others."""
    yes = F.coalesce(F.col(label).isin(*positive), F.lit(False))
    return rows.filter(yes), rows.filter(~yes)


def supporting_facts(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows: id, claim, supporting_facts array<struct<title, at int>>; pages: title, text. The sentences named, without repeats; claims without any go."""
    split = F.filter(F.transform(F.split("text", X.SENTENCE_END), X.strip), lambda s: s != "")
    facts = rows.select("id", "claim", F.posexplode("supporting_facts").alias("at", "f")).join(pages.select("title", split.alias("s")).withColumnRenamed("title", "t"), F.col("f.title") == F.col("t"))
    named = facts.withColumn("sentence", F.get("s", F.col("f.at"))).filter("sentence is not null")
    return named.groupBy("id", "claim").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"])).alias("evidence"))


def load_pairs(rows: DataFrame, limit: int | None = None, seed: int = 1337, claim_keys: tuple[str, ...] = ("claim", "claim_text", "text"), evidence_keys: tuple[str, ...] = ("evidence", "evidence_texts", "evidence_text", "contexts", "context", "passages")) -> DataFrame:
    """claim, evidence, label, pair_id from rows with any of the keys; claims without text or evidence go; with limit, those first in a seeded order."""
    kinds = dict(rows.dtypes)
    claim = X.first_text(*(F.col(k) for k in claim_keys if kinds.get(k) == "string"))
    lists = [F.filter(F.transform(k, X.strip), lambda e: e != "") if kinds[k].startswith("array<string") else F.filter(F.array(X.strip(F.col(k))), lambda e: e != "") for k in evidence_keys if k in kinds and (kinds[k] == "string" or kinds[k].startswith("array<string"))]
    out = rows.select(claim.alias("claim"), X.stable_unique(X.first_list(*lists)).alias("evidence"), *(["label"] if "label" in kinds else []))
    out = out.filter("claim is not null and size(evidence) > 0").withColumn("pair_id", X.pair_id(F.col("claim"), F.col("evidence")))
    return out.orderBy(portable_hash(seed, F.col("pair_id")), "pair_id").limit(limit) if limit is not None else out


def run_rates(runs: DataFrame, tau: str = "tau") -> DataFrame:
    """dataset, tpr, far, delta (mean negative minus mean positive energy) and effect, delta over the negatives' standard deviation. runs: dataset, split, energy and tau."""
    pos, neg = F.col("split") == "pos", F.col("split") == "neg"
    rate = lambda w: F.avg(F.when(w, F.when(F.col("energy") <= F.col(tau), 1.0).otherwise(0.0)))
    delta = F.avg(F.when(neg, F.col("energy"))) - F.avg(F.when(pos, F.col("energy")))
    return runs.groupBy("dataset").agg(rate(pos).alias("tpr"), rate(neg).alias("far"), delta.alias("delta"), F.try_divide(delta, F.stddev_pop(F.when(neg, F.col("energy")))).alias("effect"))
