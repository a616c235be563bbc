import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from stemma.plans import queries
from stemma.sources import lexical


def given(gender, code, **args):
    """A head template that says what the entry is."""
    return [{"name": "given name", "args": {"1": code, "2": gender, **args}}]


def said(*texts):
    return [{"glosses": list(texts)}]


#: Invented for this test: a chain of three, a chain of one, two lists, a gloss, and an entry about no name.
DICTIONARY = [
    {"word": "Þórdís", "lang": "Icelandic", "lang_code": "is", "head_templates": given("female", "is", **{"from": "non:Þórdís < gmq:Thurdis < gem:Thuradisiz"}), "senses": said("a female given name, from an older one")},
    {"word": "Taavi", "lang": "Estonian", "lang_code": "et", "head_templates": given("male", "et", **{"from": "fi:Taavetti", "varof": "Taavet, Taaved"}), "senses": said("a male given name")},
    {"word": "Bětka", "lang": "Czech", "lang_code": "cs", "senses": said("a pet form", "a diminutive of the female given name Alžběta, in use since the last century")},
    {"word": "Iggi", "lang": "Welsh", "lang_code": "cy", "head_templates": given("unisex", "cy", dimof="Ignat", dimof2="la:Egnatia"), "senses": said("a short form")},
    {"word": "stool", "lang": "English", "lang_code": "en", "senses": said("a seat with three legs and no back")},
]
LINKS = {
    ("is:þórdís", "non:þórdís", "derived_from"), ("non:þórdís", "gmq:thurdis", "derived_from"), ("gmq:thurdis", "gem:thuradisiz", "derived_from"),
    ("et:taavi", "fi:taavetti", "derived_from"), ("et:taavi", "et:taavet", "variant_of"), ("et:taavi", "et:taaved", "variant_of"),
    ("cs:bětka", "cs:alžběta", "diminutive_of"), ("cy:iggi", "cy:ignat", "diminutive_of"), ("cy:iggi", "la:egnatia", "diminutive_of")}


def lines(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False),) for r in rows], "value string")


def transformed(spark, rows):
    return lexical.transform(lexical.parse(lines(spark, rows)))


def links(t):
    return {(r["child"], r["parent"], r["relation_type"]) for r in lexical.edges(t).collect()}


def test_dictionary(spark):
    t = transformed(spark, DICTIONARY)
    assert links(t) == LINKS
    rows = {r["key"]: r for r in lexical.names(t).collect()}
    assert set(rows) == {k for a, b, _ in LINKS for k in (a, b)}
    assert {k: rows[k]["gender"] for k in ("is:þórdís", "et:taavi", "cs:bětka", "cy:iggi", "cy:ignat")} == {"is:þórdís": "female", "et:taavi": "male", "cs:bětka": "female", "cy:iggi": "unisex", "cy:ignat": None}
    assert (rows["cs:bětka"]["language"], rows["gmq:thurdis"]["label"], rows["la:egnatia"]["lang_code"]) == ("Czech", "Thurdis", "la")
    assert rows["et:taavi"]["source_url"].endswith("/wiki/Taavi") and rows["cs:alžběta"]["source_url"].endswith("/wiki/Al%C5%BEb%C4%9Bta")
    assert lexical.counts(lines(spark, [*DICTIONARY, "", "[no object", "{cut off"])).first().asDict() == {"lines": 8, "given_names": 4}


def test_first_lines_win(spark):
    """Of entries with one key the first gives label and address; what it lacks comes from the next that has it."""
    rows = [{"word": "OLA", "lang": None, "lang_code": "nb", "senses": said("one given name")}, {"word": "Ola", "lang": "Norwegian", "lang_code": "NB", "senses": said("a male given name")}, {"word": "ola", "lang": "Bokmål", "lang_code": "nb", "senses": said("a female given name")}]
    one = lexical.names(transformed(spark, rows)).collect()
    assert [(r["key"], r["label"], r["language"], r["gender"]) for r in one] == [("nb:ola", "OLA", "Norwegian", "male")]
    twice = [{"word": w, "lang_code": "fi", "senses": said("variant of the given name Ilmari")} for w in ("Ilppo", "ILPPO")]
    made = lexical.edges(transformed(spark, twice)).collect()
    assert [(r["child"], r["source_url"].rpartition("/")[2]) for r in made] == [("fi:ilppo", "Ilppo")]


@pytest.mark.parametrize("more,want", [
    ({"etymology_templates": [{"name": "inh", "args": {"1": "sv", "2": "gmq-osw", "3": "Sighbrit"}}, {"name": "bor+", "args": {"2": "en", "3": "Sigbrit"}}]}, {("sv:sigrid", "gmq-osw:sighbrit", "derived_from")}),
    ({"etymology_templates": [{"name": "der", "args": {"1": "sv", "2": "non", "3": " Sigríðr "}}, {"name": "der", "args": {"2": "gem-pro", "3": "*Segafrīdaz"}}, {"name": "bor", "args": {"2": "??", "3": "Sig"}}]}, {("sv:sigrid", "non:sigríðr", "derived_from")}),
    ({"etymology_templates": [{"name": "suffix", "args": {"1": "sv", "2": "Sigge", "3": "-rid"}}]}, {("sv:sigrid", "sv:sigge", "diminutive_of")}),
    ({"senses": said("variant of the given name Sigrun.", "a female given name")}, {("sv:sigrid", "sv:sigrun", "variant_of")}),
    ({"descendants": [{"lang": "Finnish", "lang_code": "FI", "word": " Siiri "}, {"lang": "Latvian", "lang_code": "lv", "word": ""}, {"lang": "None", "lang_code": None, "word": "Zigrīda"}]}, {("fi:siiri", "sv:sigrid", "derived_from")}),
    ({"descendants": [{"lang": "Swedish", "lang_code": "sv", "word": "SIGRID"}]}, set()),
    ({}, set()),
])
def test_rules(spark, more, want):
    row = {"word": "Sigrid", "lang": "Swedish", "lang_code": "sv", "senses": said("a female given name, of many queens"), **more}
    got = links(transformed(spark, [row, row, row]))
    assert got == want


def test_given_name_predicate(spark):
    rows = [{"word": "none", "lang_code": "en", "senses": said("somewhere to sit")}, {"word": "category", "lang_code": "en", "categories": ["Swahili given names"]}, {"word": "link", "lang_code": "en", "senses": [{"links": [["given name", "given name#English"]]}]},
            {"word": "raw", "lang_code": "en", "senses": [{"raw_glosses": ["(rare) a unisex given name"]}]}, {"word": "nothing", "lang_code": "en"}, {"word": "inside", "lang_code": "en", "senses": said("a misgiven nameplate")}, {"word": "template", "lang_code": "en", "senses": [{"head_templates": given("male", "en")}]}]
    kept = lexical.parse(lines(spark, rows)).where(lexical.is_given_name(F.col("entry"))).select("entry.word")
    assert {r[0] for r in kept.collect()} == {"category", "link", "raw", "template"}


@pytest.mark.parametrize("raw,fallback,want", [
    ("sv:Åsa", "fi", ("sv", "Åsa")), ("GRC: Ζωή ", "el", ("grc", "Ζωή")), ("Old French", "fr", None), ("Slavic languages", "pl", None), ("Oddný", "is", ("is", "Oddný")), ("", "is", None), (" - ", "is", None), (None, "is", None),
    ("pl:Zosia<pos:noun><tr:zosia>", "de", ("pl", "Zosia")), ("far-too-long-a-code:Zosia", "pl", ("pl", "far-too-long-a-code:Zosia")), ("\tMaija \n Liisa ", "fi", ("fi", "Maija Liisa"))])
def test_segments(spark, raw, fallback, want):
    got = spark.createDataFrame([(raw, fallback)], "r string, f string").select(lexical.segment(F.col("r"), F.col("f"))).first()[0]
    assert (tuple(got) if got else None) == want


def test_gz_file_reads_like_plain(spark, tmp_path):
    body = "\n".join(json.dumps(e) for e in DICTIONARY) + "\n\n{cut off\n"
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write(body)
    (tmp_path / "x.jsonl").write_text(body)
    assert lexical.read(spark, str(tmp_path / "x.jsonl.gz")).count() == lexical.read(spark, str(tmp_path / "x.jsonl")).count() == len(DICTIONARY)


def test_entries_are_made_once(spark):
    """Conditions on a parsed entry don't parse it again, and a file of one row group is dealt out."""
    lines = spark.createDataFrame([('{"word": "x", "lang_code": "en"}',), ("[]",), (" ",)], "value string")
    plan = lexical.transform(lexical.parse(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("jsontostructs") + plan.count("from_json") == 1
    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        assert queries._entries(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
