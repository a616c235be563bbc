"""The keyed store: merges as deltas, commits by compare-and-set, rules, compaction; relations in parts."""

import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stemma import store as stored
from stemma.catalog import Catalog
from stemma.operators import merge
from stemma.plans.load import enrich
from stemma.plans.relations import components, merge_relations, skipped
from stemma.sources import remote, shared
from stemma.store import Conflict, Store, gone

LABELS = "id string, label string, wikidata_qid string"


def names(spark, *rows):
    return spark.createDataFrame([(i, f"label {i}", q) for i, q in rows], LABELS)


def held(store, table="names", *columns):
    return {tuple(r) if len(columns) > 1 else r[0] for r in store.snapshot().table(table).select(*(columns or ["id"])).collect()}


def test_two_writers(spark, tmp_path):
    """Writers that start from one version both survive if they write apart; else the later one fails, or begins anew."""
    path = str(tmp_path / "s")
    store = Store(spark, path, buckets=8)
    store.commit(store.snapshot(), {"names": names(spark, *((f"n{i}", f"Q{i}") for i in range(30)))})
    first, second = store.snapshot(), store.snapshot()
    store.commit(first, {"names": names(spark, ("a", "Q100"))})
    with pytest.raises(Conflict):
        store.commit(second, {"names": names(spark, ("a", "Q101"))})
    assert ("a", "Q100") in held(store, "names", "id", "wikidata_qid")
    buckets = {r["id"]: r["b"] for r in spark.createDataFrame([(f"x{i}",) for i in range(40)], "id string").select("id", store.bucket(["id"]).alias("b")).collect()}
    x, y = next((x, y) for x, y in itertools.combinations(buckets, 2) if buckets[x] != buckets[y])
    relation = lambda a, b: spark.createDataFrame([(a, b)], "child_id string, parent_id string").withColumn("relation_type", F.lit("variant_of"))
    one, two = store.snapshot(), store.snapshot()
    store.commit(one, {"name_lineage": relation(x, y)})
    store.commit(two, {"name_enrichments": spark.createDataFrame([(x, "s", "f", "said")], "name_id string, source string, field string, content string")})
    assert len(held(store, "name_lineage", "child_id")) == len(held(store, "name_enrichments", "name_id")) == 1
    tried = []

    def change(base):
        tried.append(base.version)
        rows = base.rows("names", spark.createDataFrame([("a",)], "id string")).withColumn("label", F.concat("label", F.lit("!")))
        if len(tried) == 1:  # another writer is faster
            store.commit(store.snapshot(), {"names": names(spark, ("a", "Q100")).withColumn("label", F.lit("other"))})
        return {"names": rows}

    store.transact(change)
    assert len(tried) == 2 and ("a", "other!") in held(store, "names", "id", "label")


def test_saves_name_the_version_they_come_from(spark, tmp_path):
    path = str(tmp_path / "s")
    Catalog.load(spark, None).save(path, buckets=2)
    one, two = Catalog.load(spark, path), Catalog.load(spark, path)
    replace(one, names=names(spark, ("1", "Q1"))).save(path, ("names",))
    with pytest.raises(Conflict):
        replace(two, names=names(spark, ("2", "Q2"))).save(path, ("names",))
    with pytest.raises(Conflict):
        Catalog.load(spark, None).save(path)
    replace(two, enrichments=spark.createDataFrame([("1", "s", "f", "x")], "name_id string, source string, field string, content string")).save(path, ("name_enrichments",))
    got = Catalog.load(spark, path)
    assert got.names.count() == got.enrichments.count() == 1 and Catalog.load(spark, path, 1).names.count() == 0


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    store.commit(store.snapshot(), {"names": names(spark, *((f"n{i}", f"Q{i}") for i in range(5000)))})
    before = store.snapshot()
    given = spark.createDataFrame([(f"Q{i}", f"new {i}") for i in (3, 4, 9000)], "wikidata_qid string, label string")

    def change(base):
        ids = base.rows("names_by_qid", given.select(F.col("wikidata_qid").alias("value")))
        return {"names": merge.upsert_names_by_qid(base.rows("names", ids.select("id")), given)}

    after = store.transact(change)
    new = {t: sum(p.rows for p in parts if p.path not in {x.path for x in before.tables[t]}) for t, parts in after.tables.items()}
    assert new["names"] == 3 and new["names_by_qid"] == 1 and new["label_grams"] < 60
    assert after.table("names").count() == 5001
    got = {r["wikidata_qid"]: r for r in after.table("names").where("label LIKE 'new %'").collect()}
    assert set(got) == {"Q3", "Q4", "Q9000"} and got["Q3"]["id"] == "n3" and got["Q9000"]["created_at"] and not got["Q3"]["created_at"] and got["Q3"]["updated_at"]
    grams = {tuple(r) for r in after.table("label_grams").where("id = 'n3'").select("gram", "n").collect()}
    assert ("  n", 6) in grams and ("  l", 6) not in grams and len(grams) == 6


@pytest.mark.parametrize("rows,rule", [([("b", "x", "Q1")], "unique wikidata_qid"), ([("b", "x", "Q7"), ("c", "y", "Q7")], "unique value"), ([("b", None, "Q2")], "not null label"), ([("b", "x", None), ("b", "y", None)], "unique id"), ([(None, "x", None)], "not null id")])
def test_rules(spark, tmp_path, rows, rule):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.commit(store.snapshot(), {"names": names(spark, ("a", "Q1"))})
    with pytest.raises(ValueError, match=rule):
        store.commit(store.snapshot(), {"names": spark.createDataFrame(rows, "id string, label string, wikidata_qid string")})
    with pytest.raises(ValueError, match="check name_a < name_b"):
        store.commit(store.snapshot(), {"name_relations": spark.createDataFrame([("b", "a")], "name_a string, name_b string")})
    assert store.snapshot().version == 1 and held(store) == {"a"}


def test_keys_move_within_a_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.commit(store.snapshot(), {"names": names(spark, ("a", "Q1"), ("b", "Q2"))})
    store.commit(store.snapshot(), {"names": names(spark, ("a", "Q2"), ("b", "Q1"))})
    store.commit(store.snapshot(), {"names": gone(names(spark, ("a", None)))})
    assert held(store, "names", "id", "wikidata_qid") == {("b", "Q1")} and held(store, "names_by_qid", "value", "id") == {("Q1", "b")}
    assert held(store, "label_grams", "id") == {"b"}


def test_compaction_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4, fanout=2)
    want = {}
    r = random.Random(2)
    for n in range(6):
        batch = {f"k{r.randrange(12)}": f"v{n}" for _ in range(4)}
        lost = [k for k in r.sample(sorted(want), min(2, len(want))) if k not in batch]
        want = {k: v for k, v in (want | batch).items() if k not in lost}
        rows = spark.createDataFrame([(k, v, False) for k, v in batch.items()] + [(k, None, True) for k in lost], "id string, component string, __gone boolean")
        store.commit(store.snapshot(), {"component_of": rows})
        assert held(store, "component_of", "id", "component") == set(want.items())
        assert len(store.snapshot().tables["component_of"]) <= 3
    assert store.vacuum() > 0 and len(store.versions()) == 2
    assert held(store, "component_of", "id", "component") == set(want.items())
    assert store.vacuum() == 0


def test_versions_never_replace_each_other(spark, tmp_path):
    for n, move in enumerate((stored.move_new, lambda s, a, b: stored.rename_new(s, *(stored.hadoop_path(s, f"file://{x}") for x in (a, b))))):
        target = str(tmp_path / f"target{n}")
        for text, moved in (("one", True), ("two", False)):
            stored.write_text(spark, str(tmp_path / text), text)
            assert move(spark, str(tmp_path / text), target) == moved
        assert stored.read_text(spark, target) == "one"


# Relations.

def closed(edges, cap):
    """The closure and the components of all edges, at once."""
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    groups = {}
    for x in up:
        groups.setdefault(root(x), []).append(x)
    pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    for members in groups.values():
        if len(members) <= cap:
            pairs |= set(itertools.combinations(sorted(members), 2))
    return pairs, {x: (root(x), len(groups[root(x)])) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_relations_in_parts_equal_the_whole(spark, tmp_path, seed):
    r = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(34)]
    store, at = Store(spark, str(tmp_path / "s"), buckets=4), 0
    for size, close in ((9, True), (2, False), (11, True), (12, True)):
        merge_relations(store, spark.createDataFrame(edges[at : at + size], "name_a string, name_b string"), cap=4, close=close)
        at += size
        if close:
            pairs, parts = closed(edges[:at], 4)
            assert held(store, "name_relations", "name_a", "name_b") == pairs
            assert {x["id"]: (x["component"], x["size"]) for x in components(store.snapshot()).collect()} == parts
    assert skipped(store, 4) == len({c for c, n in parts.values() if n > 4}) > 0


def test_a_chain_beyond_the_cap(spark, tmp_path):
    """A hundred names, loaded as 59 and 40 relations: the pairs of the first part go when the second joins them."""
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(99)]
    table = lambda rows: spark.createDataFrame(rows, "name_a string, name_b string")
    merge_relations(store, table(chain[:59]))
    assert store.snapshot().table("name_relations").count() == 60 * 59 // 2
    merge_relations(store, table(chain[59:]))
    assert held(store, "name_relations", "name_a", "name_b") == set(chain)
    version = store.snapshot().version
    assert merge_relations(store, table(chain[:5])).version == version  # nothing new, nothing written


def test_saved_relations_count_as_direct(spark, tmp_path):
    path = str(tmp_path / "s")
    given = spark.createDataFrame([("a", "b", "cognate", "sourced"), ("b", "c", "cognate", "sourced"), ("x", "y", "cognate", "community")], "name_a string, name_b string, relation_type string, confidence string")
    replace(Catalog.load(spark, None), relations=given).save(path, buckets=2)
    store = Store(spark, path)
    merge_relations(store, spark.createDataFrame([("y", "z"), (None, "a"), ("a", "a")], "name_a string, name_b string"))
    assert held(store, "name_relations", "name_a", "name_b", "confidence") == {("a", "b", "sourced"), ("b", "c", "sourced"), ("a", "c", "community"), ("x", "y", "community"), ("x", "z", "community"), ("y", "z", "community")}


def test_a_busy_usage_service(spark, tmp_path):
    """Busy replies are waited for; a service that fails for good loses only what wasn't merged."""
    path = str(tmp_path / "s")
    replace(Catalog.load(spark, None), names=names(spark, *((f"n{i}", f"Q{i}") for i in range(6)))).save(path, buckets=2)
    asked, slept = [], []

    def service(method, url, headers, body):
        asked.append(url)
        if len(asked) in (3, 4):
            return 429, {}, b"slow down"
        return (500, {}, b"") if len(asked) > 9 else (200, {}, b'{"names": [{"name": "x", "usages": [{"usage_full": "English"}], "related_names": [{"name": "kin"}]}]}')

    with pytest.raises(RuntimeError, match="500"):
        enrich(spark, path, "key", source=remote.Remote(service, slept.append))
    assert slept.count(60.0) == 2 + remote.USAGE_TRIES
    assert Catalog.load(spark, path).enrichments.count() == 8  # usage and kin of four names


def test_relations_are_counted_by_key_no_more(spark, tmp_path, monkeypatch):
    """Pairs that are made once aren't counted again by the commit, which counts other writers' rows as before."""
    wrote, kept = {}, Store._write
    monkeypatch.setattr(Store, "_write", lambda self, name, rows, base, once=False: wrote.setdefault(name, set()).add(once) or kept(self, name, rows, base, once))
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    table = lambda *rows: spark.createDataFrame(rows, "name_a string, name_b string")
    merge_relations(store, table(("a", "b"), ("b", "a"), ("c", "d"), ("a", "b")), cap=3)
    merge_relations(store, table(("b", "c"), ("a", "b"), ("x", "y"), ("y", "z"), ("x", "z")), cap=3)  # a pair that the closure finds too
    assert wrote["name_relations"] == wrote["direct_relations"] == {True} and wrote["component_of"] == {False}
    found = store.snapshot().table("name_relations").groupBy("name_a", "name_b").count().collect()
    assert {tuple(x) for x in found} == {(a, b, 1) for a, b in ("ab", "cd", "bc", "xy", "yz", "xz")}
    with pytest.raises(ValueError, match="unique"):
        store.commit(store.snapshot(), {"direct_relations": table(("m", "n"), ("m", "n"))})


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_keys_are_not_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    """Joins with the rows of a commit move both sides, whatever size Spark guesses; few rows go to all tasks. Either way the
    tables that follow are those of a store written at once."""
    wide = "id string, label string, wikidata_qid string, __gone boolean"
    first = [(f"n{i}", f"red label {i}", f"Q{i}") for i in range(40)]
    second = [(f"n{i}", "blue" if i % 2 else f"label red {i}", f"Q{i ^ 1}", False) for i in range(30)] + [("n30", None, None, True), ("n31", "red label 31", None, False), ("n32", "red label 32", "Q32", False), ("z", "new", "Q31", False)]
    want = {r[0]: r for r in first} | {r[0]: r[:3] for r in second if not r[3]}
    del want["n30"]
    indexes = {"names": ("id", "label", "wikidata_qid"), "names_by_qid": ("value", "id"), "label_grams": ("gram", "id", "n")}
    whole = Store(spark, str(tmp_path / "whole"), buckets=4)
    whole.commit(whole.snapshot(), {"names": spark.createDataFrame(sorted(want.values()), LABELS)}, ["names"])
    plans, kept = [], Store._write
    monkeypatch.setattr(Store, "_write", lambda self, name, rows, *a, **b: plans.append(final_plan(rows)) or kept(self, name, rows, *a, **b))
    for few in (3, 1000):
        monkeypatch.setattr(shared, "FEW", few)
        store = Store(spark, str(tmp_path / f"s{few}"), buckets=4)
        store.commit(store.snapshot(), {"names": spark.createDataFrame(first, LABELS)})
        base, rows = store.snapshot(), spark.createDataFrame(second, wide)
        plans[:] = [final_plan(base.rows("names", rows.select("id")))]
        store.commit(base, {"names": rows})
        assert any("BroadcastHashJoin" in x for x in plans) == (few == 1000)
        assert all(held(store, t, *c) == held(whole, t, *c) for t, c in indexes.items())
        with pytest.raises(ValueError, match="unique wikidata_qid: 1 values"):
            store.commit(store.snapshot(), {"names": spark.createDataFrame([("n33", "x", "Q32", False), *second[:5]], wide)})
