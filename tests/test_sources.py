import json

import pytest
from pyspark.sql import functions as F

from stemma.catalog import Catalog
from stemma.functions import text as tx
from stemma.operators import merge
from stemma.sources import knowledge
from stemma.sources.progress import Progress, choose_input
from stemma.streaming.ingest import ingest, merge_batch


def lines(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d, ensure_ascii=False),) for d in docs], "value string")


def binding(**values):
    return {k: {"type": "literal", "value": v} for k, v in values.items()}


def test_query_results(spark):
    uri = "http://host/entity/"
    made = {"results": {"bindings": [
        binding(item=uri + "Q923", itemLabel=" Thomas ", langLabel="German", nativeLabel="Tomas"), binding(item=uri + "Q923", itemLabel="Thomas", langLabel="English", genderLabel="male given name", description="a name"),
        binding(item=uri + "L1013360", itemLabel="x"), binding(item=uri + "Q5")]}}
    assert [r.asDict() for r in knowledge.parse_names(lines(spark, made, "{bad")).collect()] == [{"qid": "Q923", "label": "Thomas", "native_label": "Tomas", "language": "English", "gender": "male", "description": "a name"}]
    edges = {"results": {"bindings": [binding(a=uri + "Q1", b=uri + "Q2"), binding(a=uri + "Q1", b=uri + "L2")]}}
    assert [tuple(r) for r in knowledge.parse_edges(lines(spark, edges)).collect()] == [("Q1", "Q2")]
    assert [r[0] for r in knowledge.parse_count(lines(spark, {"results": {"bindings": [binding(count="12")]}}, {"results": {"bindings": []}})).collect()] == [12, 0]


def test_fold_is_in_order(spark):
    rows = [("Q1", "a", "x", None, None, None, 1), ("Q1", "b", None, "German", None, "d", 2), ("Q1", "c", None, None, "male", None, 3)]
    got = knowledge.dedupe_by_qid(spark.createDataFrame(rows, "qid string, label string, native_label string, language string, gender string, description string, o int"), "o").first()
    assert tuple(got) == ("Q1", "a", "x", "German", "male", "d")


def test_wiki_replies(spark):
    page = {"continue": {"sroffset": 50}, "query": {"searchinfo": {"totalhits": 77}, "search": [{"title": "Q12"}, {"title": "Talk:Q12"}]}}
    got = knowledge.search_page(lines(spark, page, {"query": {"search": [{"title": "Q1"}]}})).collect()
    assert [tuple(r) for r in got] == [(["Q12"], 77, 50), (["Q1"], 1, None)]
    with pytest.raises(ValueError):
        knowledge.search_page(lines(spark, page), 10_000)
    reply = {"entities": {"Q1": {"labels": {"de": {"value": "Eins "}}, "descriptions": {"en": {"value": "d"}}}, "Q2": {"missing": ""}, "Q3": {"labels": {"fr": {"value": "x"}, "en": {"value": "Three"}}}}}
    assert [tuple(r) for r in knowledge.entities(lines(spark, reply), "Q11879590").orderBy("qid").collect()] == [("Q1", "Eins", "English", "female", "d"), ("Q3", "Three", "English", "female", None)]
    used = {"names": [{"name": "Ann B", "usages": [{"usage_full": "English"}, {"usage_full": ""}, {"usage_full": "French"}], "related_names": [{"name": f"n{i}"} for i in range(40)]}, {"name": "other"}]}
    replies = spark.createDataFrame([("1", json.dumps(used)), ("2", json.dumps({"error": "no", "error_code": 50})), ("3", json.dumps({"names": []}))], "name_id string, value string")
    rows = {r["field"]: r for r in knowledge.usage_rows(replies).collect()}
    assert rows["usage"]["content"] == "Usages: English, French" and rows["related"]["content"].count(",") == 29 and len(rows) == 2


def test_text_functions(spark):
    rows = spark.createDataFrame([("  Maria\t", "a (b)~c!d'e é+*", "x/Q12", "Q7")], "a string, b string, c string, d string")
    got = rows.select(tx.trimmed(F.col("a")), tx.page_url(F.col("b")), tx.qid_of_uri(F.col("c")), tx.qid_number(F.col("d")), tx.shown_name(F.lit("-"), F.lit(" ")), tx.shown_name(F.lit(" "), F.lit("n")), tx.similarity(F.lit(""), F.lit("x")), tx.round_half_up(F.lit(2.5))).first()
    assert tuple(got) == ("Maria", "https://en.wiktionary.org/wiki/a_(b)~c!d'e_%C3%A9%2B*", "Q12", 7, "—", "n", 0.0, 3)


def test_merges_keep_ids_and_are_stable(spark):
    target = spark.createDataFrame([("1", "k1", "old", "English"), ("2", "k2", "two", None)], "id string, wiktionary_key string, label string, language string")
    rows = spark.createDataFrame([("k1", "new", None), ("k3", "three", "Latin"), (None, "lost", "x")], "wiktionary_key string, label string, language string")
    once = merge.upsert_names_by_key(target, rows)
    assert {tuple(r)[1:] for r in once.collect()} == {("k1", "new", "English"), ("k2", "two", None), ("k3", "three", "Latin")}
    assert {tuple(r) for r in merge.upsert_names_by_key(once, rows).collect()} == {tuple(r) for r in once.collect()}


def test_progress(tmp_path):
    path = str(tmp_path / "p.json")
    assert Progress.load(path) is None
    Progress(after="Q5", pendingPrefixes=["10"]).save(path)
    assert Progress.load(path) == Progress(after="Q5", pendingPrefixes=["10"])
    (tmp_path / "p.json").write_text("{broken")
    assert Progress.load(path) is None
    Progress.clear(path)
    with pytest.raises(FileNotFoundError):
        choose_input(fixture=path)


def test_streamed_lines_merge_once(spark, tmp_path):
    source, saved = tmp_path / "in", str(tmp_path / "catalog")
    source.mkdir()
    Catalog.load(spark, None).save(saved)
    entry = {"word": "Jaska", "lang": "Finnish", "lang_code": "fi", "head_templates": [{"name": "given name", "args": {"2": "male", "from": "sv:Jakob < la:Iacobus"}}], "senses": [{"glosses": ["a male given name"]}]}
    (source / "a.jsonl").write_text(json.dumps(entry) + "\n\n{broken\n")
    for _ in range(2):
        ingest(spark, str(source), saved, str(tmp_path / "check")).awaitTermination()
    merge_batch(spark, saved, spark.read.text(str(source)))
    got = Catalog.load(spark, saved)
    assert {r["wk"] for r in got.names.collect()} == {"fi:jaska", "sv:jakob", "la:iacobus"} and got.lineage.count() == 2
    assert Catalog.load(spark, None).names.count() == 0
