"""The thin queries over the synthetic tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import ann, fertility, language, mixing, ogg, packing, pii, rtree, simhash, substring, toxicity, trie, warc

#: The key of the pseudonyms in these queries; a production run passes its own.
PII_KEY = "attestor-demo-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))), ",")
    return docs.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), kinds.alias("kinds"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("sources"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.round_trip(_table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    derive = {"kept_sha256": lambda kept: F.sha2(kept, 256)}
    return substring.substring_dedup(_table(spark, sf_dir, "documents"), derive=derive)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_warc, op3_simhash, op4_packing, op5_language, op6_mixing, op7_toxicity, op8_ogg, op9_ann, op10_substring, op11_hard_negatives, op12_prefix_trie, op13_quality, pipeline)}

BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i) // 4 + 1, 2))::INT >> (3 - i % 4)::INT) & 31) + 1, 1)), '')"

CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(x) + 1), lambda i: [ord(substr(x, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""

#: SQL for the queries that it can express. The others hash, train, tokenise, follow links or lay out files.
ORACLE: dict[str, str] = {
    "op2_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h)""",
    "op10_substring": """WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
g AS (SELECT DISTINCT k.doc_id, i + o AS p FROM k JOIN f USING (key), range(13) r(o) WHERE first < k.doc_id),
t AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
s AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.p = t.p WHERE g.p IS NULL GROUP BY t.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s ON s.doc_id = w.doc_id""",
    "op11_hard_negatives": """WITH r AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10""",
    "op12_prefix_trie": f"""WITH c AS (SELECT conv_id, conv_id::VARCHAR AS x, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, s, {CRC32} % 6 AS h FROM c),
b AS (SELECT h.conv_id, list_concat(coalesce(f.s, h.s[1:0])[1:h], h.s[h + 1 :]) AS s FROM h LEFT JOIN c f ON f.conv_id = h.conv_id - h.conv_id % 100),
n AS (SELECT s[1:d] AS k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM b) GROUP BY ALL),
kids AS (SELECT k[1 : depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
u AS (SELECT n.k, depth, CASE WHEN depth > 0 THEN (n_convs - 1) * length(n.k[depth].text) ELSE 0 END AS saves, (n_children IS NULL)::BIGINT AS leaf FROM n LEFT JOIN kids USING (k)),
t AS (SELECT k[1:j] AS k, sum(saves)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM (SELECT k, saves, leaf, unnest(range(depth + 1)) AS j FROM u) GROUP BY ALL),
e AS (SELECT s AS k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM b GROUP BY s)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN t USING (k) LEFT JOIN kids USING (k) LEFT JOIN e USING (k) LEFT JOIN n p ON n.depth > 0 AND p.k = n.k[1 : n.depth - 1]""",
}
