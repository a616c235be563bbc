"""Schemas of the catalogue's tables and of the semi-structured inputs, as DDL (never inferred)."""

from __future__ import annotations

NAMES = "id string, wikidata_qid string, wiktionary_key string, label string, native_label string, language string, gender string, tradition_type string, created_at timestamp, updated_at timestamp"
ENRICHMENTS = "id string, name_id string, source string, field string, content string, source_url string, fetched_at timestamp"
RELATIONS = "name_a string, name_b string, relation_type string, confidence string"
LINEAGE = "child_id string, parent_id string, relation_type string, confidence string, source string, source_url string"
TABLES = {"names": NAMES, "name_enrichments": ENRICHMENTS, "name_relations": RELATIONS, "name_lineage": LINEAGE}
#: Values that writers leave out.
DEFAULTS = {"names": {"tradition_type": "etymological"}, "name_relations": {"relation_type": "cognate", "confidence": "community"},
            "name_lineage": {"relation_type": "derived_from", "confidence": "sourced", "source": "wiktionary"}}
#: Keys that hold one row each.
KEYS = {"names": [["id"], ["wikidata_qid"], ["wiktionary_key"]], "name_enrichments": [["id"], ["name_id", "source", "field"]],
        "name_relations": [["name_a", "name_b"]], "name_lineage": [["child_id", "parent_id", "relation_type"]]}
CHECKS = {"name_relations": "name_a < name_b", "name_lineage": "child_id <> parent_id"}
REQUIRED = {"names": ["id", "label", "tradition_type"], "name_enrichments": ["name_id", "source", "field", "content"],
            "name_relations": ["name_a", "name_b"], "name_lineage": ["child_id", "parent_id", "relation_type"]}

#: What a store keeps: columns, the key that holds one row, and the columns of the key that make the bucket.
GRAMS = "label_grams"
_PAIR, _ENTRY = "name_a string, name_b string", "value string, id string"
STORED = {
    "names": (NAMES, ("id",), ("id",)), "name_enrichments": (ENRICHMENTS, ("name_id", "source", "field"), ("name_id",)),
    "name_relations": (RELATIONS, ("name_a", "name_b"), ("name_a", "name_b")), "name_lineage": (LINEAGE, ("child_id", "parent_id", "relation_type"), ("child_id", "parent_id", "relation_type")),
    "names_by_qid": (_ENTRY, ("value",), ("value",)), "names_by_key": (_ENTRY, ("value",), ("value",)), GRAMS: ("gram string, id string, n int", ("gram", "id"), ("gram",)),
    "direct_relations": (_PAIR, ("name_a", "name_b"), ("name_a", "name_b")), "open_relations": (_PAIR, ("name_a", "name_b"), ("name_a", "name_b")),
    "component_of": ("id string, component string", ("id",), ("id",)), "component_members": ("component string, id string", ("component", "id"), ("component",)),
    "component_sizes": ("component string, size bigint", ("component",), ("component",))}
#: Tables that are kept with a table, by the column they follow, and those that are made anew after a table was replaced.
FOLLOWERS = {"names": {"names_by_qid": "wikidata_qid", "names_by_key": "wiktionary_key", GRAMS: "label"}}
DERIVED = {"name_relations": ("direct_relations", "open_relations", "component_of", "component_members", "component_sizes")}

_TEMPLATE = "struct<name:string,args:map<string,string>,expansion:string>"
LEXICAL_ENTRY = (
    "word string, lang string, lang_code string, pos string, "
    f"head_templates array<{_TEMPLATE}>, etymology_templates array<{_TEMPLATE}>, "
    f"descendants array<struct<lang:string,lang_code:string,word:string,raw_tags:array<string>,depth:int,templates:array<{_TEMPLATE}>>>, "
    "senses array<struct<glosses:array<string>,raw_glosses:array<string>,tags:array<string>,categories:array<string>,"
    f"links:array<array<string>>,head_templates:array<{_TEMPLATE}>>>, categories array<string>")
SPARQL_RESULT = "results struct<bindings:array<map<string,struct<type:string,value:string>>>>"
SEARCH_PAGE = "continue struct<sroffset:bigint>, query struct<searchinfo:struct<totalhits:bigint>,search:array<struct<title:string>>>"
ENTITIES = "entities map<string,struct<missing:string,labels:map<string,struct<value:string>>,descriptions:map<string,struct<value:string>>>>"
USAGE_REPLY = "error string, error_code int, names array<struct<name:string,gender:string,usages:array<struct<usage_full:string,usage_gender:string>>,related_names:array<struct<name:string>>>>"
PROGRESS = "phase string, type string, after string, windowStart bigint, searchOffset bigint, uriPrefix string, pendingPrefixes array<string>, completedTypes array<string>"
