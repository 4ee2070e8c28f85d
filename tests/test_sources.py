import datetime
import json

import pytest
from pyspark.sql import functions as F

from attestor.functions import text as X
from attestor.functions.policies import Policy
from attestor.operators import prepare
from attestor.plans import queries as Q
from attestor.sources import readers, writers
from attestor.streaming import gate as stream_gate


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id":"1","claim":"c","evidence":["e"],"label":1}\n\n{"id":"2","claim":"d"}\n')
    rows = readers.json_lines(spark, str(path), readers.PAIRS).collect()
    assert [(r["id"], r["evidence"]) for r in rows] == [("1", ["e"]), ("2", None)]
    path.write_text("not json\n")
    with pytest.raises(Exception, match="bad JSON"):
        readers.json_lines(spark, str(path), readers.PAIRS, strict=True).collect()


def test_lone_evidence_set(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    one_set = {"content": ["a"], "context": {"a": ["b", "c"]}}
    path.write_text("\n".join(json.dumps({"id": i, "claim": "c", "evidence": e}) for i, e in (("1", one_set), ("2", [one_set, {"content": ["z", "a"], "context": {}}]))))
    got = {r["id"]: r["evidence"] for r in readers.evidence_sets(spark, str(path)).collect()}
    assert len(got["1"]) == 1 and len(got["2"]) == 2
    ids = readers.evidence_sets(spark, str(path)).select("id", F.explode("evidence").alias("e")).select("id", X.required_ids(F.col("e.content"), F.col("e.context")).alias("r")).collect()
    assert ["a", "b", "c"] in [r["r"] for r in ids] and ["z", "a"] in [r["r"] for r in ids]


def test_scored_round_trip(spark, tmp_path):
    flat = spark.createDataFrame([("pos", 0.3, 1.9, 0.5, "accept", True)], "split string, energy double, participation_ratio double, sensitivity double, verdict string, is_stable boolean")
    writers.json_lines(writers.nested_scored(flat), f"{tmp_path}/s")
    back = readers.flat_scored(readers.scored(spark, f"{tmp_path}/s")).first()
    assert (back["split"], back["energy"], back["participation_ratio"], back["verdict"], back["is_stable"], back["alignment"]) == ("pos", 0.3, 1.9, "accept", True, None)


def test_modes_are_found_in_pairs(spark, tmp_path):
    for name in ("pos_offset", "neg_offset", "pos_alone"):
        (tmp_path / f"{name}.jsonl").write_text('{"claim":"c"}\n')
    got = readers.runs(spark, str(tmp_path)).select("neg_mode", "split").collect()
    assert sorted(tuple(r) for r in got) == [("offset", "neg"), ("offset", "pos")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, x int")
    for run in ("r1", "r2", "r1"):
        writers.run_partition(rows.filter(F.col("run_id") == run), f"{tmp_path}/runs", run)
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2
    writers.csv(rows, f"{tmp_path}/c")
    assert readers.csv(spark, f"{tmp_path}/c", "run_id string, x int").count() == 2
    assert writers.markdown(rows, "T").splitlines()[2] == "| run_id | x |"
    assert json.loads(writers.report_json(rows.limit(1)))["x"] == 1
    assert json.loads(writers.proof({"m": {"auc": 0.5}}))["m"]["collapse"]


def test_views(spark):
    writers.views(Q.swept(spark, "/root/testdata/sf0.001"))
    assert spark.sql("select * from v_policy_rates").count() == 12


def test_latest_wins(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    old = spark.createDataFrame([("a", "x", at(1)), ("b", "y", at(1))], "k string, v string, updated_at timestamp")
    new = spark.createDataFrame([("a", "z", at(2)), ("c", "w", at(2))], "k string, v string, updated_at timestamp")
    got = {r["k"]: r["v"] for r in prepare.upsert(old, new, ["k"]).collect()}
    assert got == {"a": "z", "b": "y", "c": "w"}


def test_elements_of_a_page(spark):
    page = {"title": "T", "order": ["sentence_0", "section_0", "list_0", "table_0"], "sentence_0": "One.", "sentence_9": "not in order", "section_0": {"value": "S", "level": 1},
            "list_0": {"list": [{"id": "item_0_0", "value": "i"}, {"id": None, "value": "x"}]}, "table_0": {"caption": "C", "table": [[{"id": "header_cell_0_0_0", "value": "h"}, {"id": "cell_0_1_0", "value": "v"}]]}}
    pages = spark.createDataFrame([("T", json.dumps(page))], "page_id string, body string")
    got = {r["local_id"]: r["text"] for r in prepare.page_elements(pages).collect()}
    assert got == {"title": "T", "sentence_0": "One.", "section_0": "S", "item_0_0": "i", "table_caption_0": "C", "header_cell_0_0_0": "h", "cell_0_1_0": "v"}
    every = {r["local_id"]: r["text"] for r in prepare.page_elements(pages, ordered_only=False).collect()}
    assert every["sentence_9"] == "not in order" and every["list_0"] == "i\nx"
    ids = spark.createDataFrame([("T_sentence_0",), ("T_sentence_7",), ("U_cell_0_0_0",), ("T_title",), ("nonsense",)], "element_id string")
    out = {r["element_id"]: (r["ok"], r["error"]) for r in prepare.resolve(ids, prepare.page_elements(pages)).collect()}
    assert out == {"T_sentence_0": (True, None), "T_sentence_7": (False, "missing_element"), "U_cell_0_0_0": (False, "missing_page"), "T_title": (True, None), "nonsense": (False, "bad_id")}


def test_complete_sets(spark):
    claims = spark.createDataFrame([("1", [(["a"], {"a": ["b"]}), (["c"], {})]), ("2", [(["c"], None)])], "id string, sets array<struct<content: array<string>, context: map<string, array<string>>>>")
    resolved = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "element_id string, ok boolean")
    vectors = spark.createDataFrame([("a",), ("b",), ("c",)], "element_id string")
    got = prepare.complete_claims(claims, resolved, vectors).collect()
    assert [r["id"] for r in got] == ["1"] and [s["content"] for s in got[0]["complete_sets"]] == [["a"]]
    assert prepare.complete_claims(claims, resolved, vectors, rule="all").count() == 0


def test_lookup_keeps_order_and_tells_what_is_missing(spark):
    resolved = spark.createDataFrame([("a", True, "[[X|y]]_z"), ("b", False, "bad"), ("c", True, "c")], "element_id string, ok boolean, text string")
    got = prepare.lookup(spark.createDataFrame([("1", ["c", "b", "a", "d"])], "id string, ids array<string>"), resolved).first()
    assert got["texts"] == ["c", "y z"] and got["missing"] == ["b", "d"]


def test_converters(spark):
    claims = spark.createDataFrame([("1", "c", {"7": [("SUPPORT", [0, 9])], "8": [("CONTRADICT", [5])]})], "id string, claim string, evidence map<string, array<struct<label: string, sentences: array<int>>>>")
    corpus = spark.createDataFrame([(7, ["s0", "s1"]), (8, ["t0"])], "doc_id int, abstract array<string>")
    assert [(r["doc_id"], r["evidence"]) for r in prepare.scientific_claims(claims, corpus).collect()] == [("7", ["s0"])]
    assert prepare.scientific_claims(claims, corpus, "abstract").count() == 2
    contracts = spark.createDataFrame([("1", "Is it?", "yes", "A long enough first sentence of it. Short"), ("2", "Is it?", "no", "x")], "id string, question string, answer string, text string")
    rows = prepare.contract_answers(contracts).collect()
    assert {(r["id"], r["claim"], r["label"]) for r in rows if r["id"] == "1"} == {("1", "The is it? in this contract is yes.", 1), ("1", "The is it? in this contract is no.", 0)}
    yes, no = prepare.routed(spark.createDataFrame([("Entailment",), ("Contradiction",), (None,)], "label string"))
    assert (yes.count(), no.count()) == (1, 2)
    facts = spark.createDataFrame([("1", "c", [("P", 1), ("P", 1), ("P", 9)])], "id string, claim string, supporting_facts array<struct<title: string, at: int>>")
    pages = spark.createDataFrame([("P", "First one. Second one! Third.")], "title string, text string")
    assert prepare.supporting_facts(facts, pages).first()["evidence"] == ["Second one!"]


def test_pairs_by_key_lists(spark):
    rows = spark.createDataFrame([(None, " a ", ["x", "x", " "], None), ("c", None, None, "one"), ("d", None, [], " ")], "claim string, text string, evidence array<string>, context string")
    got = {r["claim"]: r["evidence"] for r in prepare.load_pairs(rows).collect()}
    assert got == {"a": ["x"], "c": ["one"]}
    assert prepare.load_pairs(rows, 1).count() == 1


def test_element_ids(spark):
    parts = lambda v: tuple(one(spark, X.element_parts, v) or ())
    assert parts("A_b_cell_2_13_1") == ("A_b", "cell", "2_13_1")
    assert parts("The cell_header_cell_0_1_1") == ("The cell", "header_cell", "0_1_1")
    assert parts("X_section_4") == ("X", "section", "4") and parts("X_title") == ("X", "title", "") and parts("plain") == ()
    assert tuple(one(spark, X.element_local, "A_sentence_0")) == ("A", "sentence_0")
    assert tuple(one(spark, X.element_local, "A_b_c")) == ("A_b", "c")
    assert tuple(one(spark, X.element_named, "A–b_item_1_2")) == ("A–b", "item_1_2")
    assert tuple(one(spark, X.element_named, "A_sentence")) == (None, None)
    assert one(spark, X.page_of, "A_b_cell_0_1") == "A_b" and one(spark, X.page_of, "a_b_c_d") == "a_b"


def test_text(spark):
    assert one(spark, X.sentences, "x" * 19 + ". " + "y" * 20 + ".") == ["y" * 20 + "."]
    assert one(spark, X.paragraphs, "a\n\n b \n \n") == ["a", "b"]
    assert len(one(spark, X.paragraphs, " ".join(f"S{i}." for i in range(11)))) == 3
    assert one(spark, X.prompt_segments, "") == [] and one(spark, X.prompt_segments, None) == []
    assert one(spark, X.prompt_segments, "short") == ["short"]
    assert one(spark, X.nfc, "é ") == "é"
    assert one(spark, X.title_variants, "A_b – c") == ["A_b – c", "A_b - c", "A b – c", "A_b_–_c"]
    assert one(spark, lambda c: X.vector_of_bytes(X.bytes_of_vector(c)), [0.5, -1.0], "array<float>") == [0.5, -1.0]
    assert one(spark, X.to_int, " 7 ") == 7 and one(spark, X.to_int, "x") is None
    assert not one(spark, X.valid_text, "abc") and one(spark, X.valid_text, "abc d")


def test_stream(spark, tmp_path):
    rows = Q.scored(spark, "/root/testdata/sf0.001").withColumn("ts", F.timestamp_seconds(F.col("idx") * 60))
    rows.write.parquet(f"{tmp_path}/in")
    policy = Policy("energy", tau=0.97)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = stream_gate.accept_rate(stream, policy).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from rates").first()[0] == rows.count()
