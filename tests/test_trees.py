"""Trees, neighbourhoods, islands and layouts of many names at once, against those of one name at a time."""

import random

import pytest
from pyspark.sql import functions as F

from stemma.catalog import Catalog
from stemma.operators import graph, growth, layout, layouts, search, tree, trees, viewport
from stemma.sources import shared


@pytest.fixture(scope="module")
def forest(spark):
    r = random.Random(5)
    ids = [f"n{i:02}" for i in range(60)]
    lineage = sorted({(ids[r.randrange(1, 60)], ids[min(59, int(r.paretovariate(0.6)) - 1)]) for _ in range(150)} - {(i, i) for i in ids})
    lineage += [(c, p) for c, p in lineage[:5]] + [("lost", ids[0]), (ids[3], "gone")]  # repeated edges, ends without a name
    relations = sorted({tuple(sorted(r.sample(ids, 2))) for _ in range(90)})
    names = [(i, r.choice(["Red", "A longer label than the others", "ö", "name"]) + i, "English") for i in ids] + [("alone", "alone", None)]
    named = spark.createDataFrame(names, "id string, label string, language string").withColumns({c: F.lit(None).cast("string") for c in ("native_label", "gender", "wikidata_qid", "wk")})
    notes = spark.createDataFrame([], "name_id string, source string, field string, content string")
    return Catalog(named.cache(), spark.createDataFrame(relations, "name_a string, name_b string").withColumn("confidence", F.lit("c")).cache(), spark.createDataFrame(lineage, "child_id string, parent_id string").cache(), notes)


@pytest.mark.parametrize("view", [(1200, 800), (500, 900)])
def test_trees_and_layouts(spark, forest, view):
    roots = [f"n{i:02}" for i in (0, 1, 2, 7, 30, 59)] + ["alone"]
    given = spark.createDataFrame([(i,) for i in [*roots, "n00", "unknown"]], "id string")
    rows = trees.lineage_trees(forest, given, *view).join(forest.names.select("id", "label"), "id").cache()
    placed = {(x["root"], x["id"]): (x["x"], x["y"], x["scale"]) for x in layouts.positions(rows, *view).collect()}
    assert {x["root"] for x in rows.collect()} == set(roots)
    lanes = {(x["root"], x["depth"]): (x["n"], x["lane"]) for x in layouts.lanes(layouts.positions(rows, *view), F.col("x")).collect()}
    made = {t.root: t for t in trees.shown_trees(forest, roots, *view)}
    for root in roots:
        want = tree.lineage_tree(forest, root, *view, resolve=False, collapse=False)
        got = made[root]
        assert got.nodes == want.nodes and set(got.edges) == set(want.edges)
        where, scale = layout.layout(want, *view)
        assert {i: (pytest.approx(x), pytest.approx(y), pytest.approx(scale)) for i, (x, y) in where.items()} == {i: p for (r, i), p in placed.items() if r == root}
        for depth in {n.depth for n in want.nodes}:
            n, lane = lanes[root, depth]
            assert n == sum(x.depth == depth for x in want.nodes) and lane == pytest.approx(layout.lane(want, where, depth, "horizontal"))
    assert trees.lineage_trees(forest, given.where("false"), *view).count() == 0


def test_neighborhoods_and_islands(spark, forest):
    both = graph.incident(forest.relations, "name_a", "name_b", "confidence").cache()
    roots = ["n00", "n13", "n44"]
    given = spark.createDataFrame([(i,) for i in roots], "id string")
    for most, hop1, hop2 in ((30, 28, 6), (9, 4, 2), (1, 3, 3)):
        got = {tuple(x) for x in graph.neighborhoods(forest.names, both, given, most, hop1, hop2).collect()}
        assert got == {(i, *x) for i in roots for x in graph.neighborhood(forest.names, both, i, most, hop1, hop2).collect()}
    links, degree = {}, {x["id"]: x["degree"] for x in graph.degrees(both).collect()}
    for x in both.select("id", "other").distinct().collect():
        links.setdefault(x["id"], []).append(x["other"])
    islands = {}
    for x in graph.islands(forest.names, both, given).collect():
        islands.setdefault(x["hub_id"], {})[x["id"]] = x["depth"]
    for i in roots:
        members = graph.pick_island(links, degree, i, 7)
        assert islands[i] == graph.island_depths({k: [v for v in vs if v in members] for k, vs in links.items()}, members, i)


def test_viewports_in_rows(spark):
    views = [(w, h) for w in (100, 300, 500, 777, 1200, 5000) for h in (100, 260, 640, 900, 4000)]
    got = spark.createDataFrame(views, "w int, h int").select("w", "h", viewport.capacity_of(F.col("w"), F.col("h")).alias("c")).collect()
    assert {(x["w"], x["h"]): tuple(x["c"]) for x in got} == {(w, h): tuple(vars(viewport.capacity(w, h)).values()) for w, h in views}
    cases = [(d, b, up, down) for d in range(2, 8) for b in (3, 5, 8, 14) for up in range(8) for down in range(8)]
    got = spark.createDataFrame(cases, "d int, b int, up int, down int").select("*", viewport.sides_of(*(F.col(c) for c in ("d", "b", "up", "down"))).alias("s")).collect()
    assert all(tuple(x["s"]) == tuple(vars(viewport.sides(viewport.Capacity("horizontal", x["d"], x["b"], 0), x["up"], x["down"])).values()) for x in got)


def test_search_by_postings(spark, forest, tmp_path):
    """The same hits with postings as by reading all labels; of the stored names only some buckets are read."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcéz1") for _ in range(r.randint(1, 6)))
    labels = [r.choice([" ", "-", "  "]).join(word() for _ in range(r.randint(1, 3))) for _ in range(250)] + ["", "Ab", "ÉZ 1", None]
    names = spark.createDataFrame([(f"i{n}", x) for n, x in enumerate(labels) if x is not None], "id string, label string").withColumns({c: F.lit(None).cast("string") for c in ("native_label", "language", "gender", "wk")})
    Catalog(names, forest.relations, forest.lineage.distinct().withColumn("relation_type", F.lit("derived_from")).where("child_id <> parent_id"), forest.enrichments).save(str(tmp_path / "s"), buckets=32)
    stored = Catalog.load(spark, str(tmp_path / "s"))
    queries = ["abc", "éz", " a b ", "z1%c", "b_a", "a", "-", "ABCÉ", "é z-a", "zzzzzz", "%", *(r.choice([x for x in labels if x])[1:5] for _ in range(3))]
    for q in queries:
        index = search.StoredIndex(stored)
        plain = {(x["id"], round(x["sim"], 9)) for x in search.matching(names, q).collect()}
        assert {(x["id"], round(x["sim"], 9)) for x in search.matching(stored.names, q, index=index).collect()} == plain, q
    stored.base.reads.clear()
    found = search.matching(stored.names, "zzzzzz", index=search.StoredIndex(replaced(stored)))
    assert found.count() >= 0 and stored.base.reads["names"] is not None and len(stored.base.reads["names"]) < 32
    postings = search.LabelIndex(search.trigram_index(names), names)
    assert {x["id"] for x in search.matching(names, "abc", index=postings).collect()} == {x["id"] for x in search.matching(names, "abc").collect()}
    assert search.contained_grams(spark, "Foo b%ar") == ["foo", "oo ", "  b"] and search.contained_grams(spark, "ab") == []


def test_many_hits_are_not_sent_to_all_tasks(spark, forest, monkeypatch):
    """Degrees of many hits come by joins that move both sides, with the same ranks as those of few."""
    found = forest.names.withColumn("sim", F.lit(0.5)).localCheckpoint()
    pages = {}
    for few in (3, 1000):
        monkeypatch.setattr(shared, "FEW", few)
        page = search.page_of(found, forest, page_size=50)
        pages[few] = [tuple(x[c] for c in ("id", "lineage_degree", "cognate_degree")) for x in page.collect()]
        assert ("BroadcastHashJoin" in page._jdf.queryExecution().executedPlan().toString()) == (few == 1000)
    assert pages[3] == pages[1000] and len(pages[3]) > 3


def replaced(catalog):
    """A catalogue whose version remembers only what is read from now on."""
    catalog.base.table = lambda name: catalog.base.store.frame(name, catalog.base.tables.get(name, []))
    return catalog


def test_frontiers_are_asked_by_need(spark):
    """A frontier's first names are asked, so many as would fill the start; the others only while it isn't full."""
    best = spark.createDataFrame([("a", ["p", "q", "s"]), ("h", ["q", "t", "u"])], "near string, others array<string>")
    begun = growth.begun(spark.createDataFrame([("r",), ("a",)], "root string")).withColumn("frontier", F.array(*map(F.lit, "abcdefgh")))
    asked = {x["root"]: (x["taken"], x["frontier"]) for x in growth._asked(begun.withColumns({"cap": F.lit(2), "fresh": F.expr("CAST(array() AS array<string>)")}), best, 1, 4, 1).collect()}
    assert asked["r"] == (["r", "p", "q"], list("cdefgh"))
    found = {x["root"]: x for x in growth.grown(begun, best, 1, F.lit(2), F.lit(True), 6).collect()}
    assert found["r"]["taken"] == ["r", "p", "q", "t", "u"] and found["r"]["frontier"] == ["p", "q", "t", "u"]
    assert [x["near"] for x in found["r"]["nodes"]] == [None, "a", "a", "h", "h"]
    off = growth.grown(begun, best, 1, F.lit(2), F.col("root") == "a", 6).where("root = 'r'").first()
    assert off["taken"] == ["r"] and off["frontier"] == []


def test_trees_of_all_names_are_laid_out_together(spark, forest):
    """Without roots every name with lineage has a tree, also one whose relatives have no name; layouts deal rows out once."""
    given = graph.incident(forest.lineage, "child_id", "parent_id").select("id")
    made, want = (trees.lineage_trees(forest, r) for r in (None, given))
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and made.count() > 60
    lost = Catalog(forest.names, forest.relations, spark.createDataFrame([("n01", "gone")], "child_id string, parent_id string"), forest.enrichments)
    assert [tuple(x) for x in trees.lineage_trees(lost).select("root", "id", "depth", "parent").collect()] == [("n01", "n01", 0, None)]
    rows = want.join(forest.names.select("id", "label"), "id").localCheckpoint()
    for made in (layouts.positions(rows, 1200, 800), layouts.weights(rows)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_relatives_are_sent_by_need(spark):
    """Ranks of rows that repeat; of a name's relatives a start is sent what it can pass over or take."""
    edges = spark.createDataFrame([("a", f"x{i}", 9 - i % 3) for i in range(9)] * 2 + [("b", None, 0)], "near string, other string, n int")
    best = growth.ranked(edges, [F.desc("n"), F.asc("other")], 4)
    assert {x["near"]: x["others"] for x in best.collect()} == {"a": ["x0", "x3", "x6", "x1"], "b": []}
    begun = growth.begun(spark.createDataFrame([("r",)], "root string"))
    made = growth.first(begun, F.array(*map(F.lit, ["r", "p", "q", "s"])), 1, F.lit(2), F.lit(True), 9).first()
    assert (made["taken"], made["frontier"]) == (["r", "p", "q"], ["p", "q"]) and [x["near"] for x in made["nodes"]] == [None, "r", "r"]
