import random

import pytest
from pyspark.sql import functions as F

from stemma.catalog import ADAPTERS, Catalog
from stemma.operators import graph, layout, lookalike, merge, search, tree
from stemma.operators.components import connected_components
from stemma.operators.viewport import capacity, sides
from stemma.plans.api import BadRequest, NotFound, Service


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "name_a string, name_b string")


@pytest.mark.parametrize("pairs,cap,want,skipped", [
    ([("A", "B"), ("B", "C")], 80, {("A", "B"), ("A", "C"), ("B", "C")}, 0), ([("Z", "A")], 80, {("A", "Z")}, 0),
    ([("A", "B"), ("B", "C"), ("C", "D")], 3, {("A", "B"), ("B", "C"), ("C", "D")}, 1), ([("A", "A")], 80, set(), 0), ([], 80, set(), 0)])
def test_closure(spark, pairs, cap, want, skipped):
    e = edges(spark, pairs)
    assert {tuple(r) for r in graph.closure(e, cap=cap).collect()} == want
    assert graph.closure_skipped(e, cap=cap).first()[0] == skipped


def test_components_of_chains_stars_and_noise(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 30)] + [(2000 + r.randrange(60), 2000 + r.randrange(60)) for _ in range(45)] + [(None, 5), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.fixture(scope="module")
def demo(spark):
    names = [("ma", "Maria", "Greek", None, "el:maria"), ("mb", "Mary", "English", None, None), ("mc", "Miriam", "Hebrew", None, None), ("ya", "Yusuf", "Arabic", None, None), ("yb", "Joseph", "English", None, None), ("xx", "MARY", None, None, None)]
    return Catalog(spark.createDataFrame(names, "id string, label string, language string, gender string, wk string").withColumns({"native_label": F.lit(None).cast("string"), "wikidata_qid": F.when(F.col("id") == "ma", "Q9")}).cache(),
                   spark.createDataFrame([("ma", "mb", "community"), ("ma", "mc", "community"), ("mb", "mc", "community"), ("ya", "yb", "community")], "name_a string, name_b string, confidence string").cache(),
                   spark.createDataFrame([("ma", "mc", "derived_from"), ("mb", "ma", "derived_from")], "child_id string, parent_id string, relation_type string").cache(),
                   spark.createDataFrame([("ma", "wikidata", "meaning", "beloved"), ("yb", "wikidata", "etymology", "he adds")], "name_id string, source string, field string, content string").cache())


def test_demo_tree_and_islands(spark, demo):
    made = tree.lineage_tree(demo, "ma")
    assert {(n.id, n.depth) for n in made.nodes} == {("mc", -1), ("ma", 0), ("mb", 1)} and set(made.edges) == {("mc", "ma"), ("ma", "mb")}
    assert tree.lineage_tree(demo, "nobody") is None
    assert tree.lineage_tree(demo, "xx").root == "mb"  # a name without lineage stands for its twin
    service = Service(demo)
    homes = service.graph_home()
    assert [i["hub_id"] for i in homes["islands"]] == ["ma", "ya"] and homes["hub_id"] == "ma" and len(homes["islands"][0]["edges"]) == 3
    assert service.graph_constellation("xx")["islands"][0]["nodes"][0]["id"] == "xx"
    assert {n["id"] for n in service.graph_expand("ma", most=2)["nodes"]} == {"ma", "mb"}
    assert len(service.graph_expand("ma", hop=1, most=1)["edges"]) == 2
    assert service.name("ma")["cognates"][0]["label"] == "Mary" and service.name("yb")["enrichments"][0]["content"] == "he adds" and service.name("xx")["enrichments"] == []
    featured = service.graph_tree(featured=True, rest=True)  # both have one child; fewer than five fit, so all count, by id
    assert featured["roots"] == ["ma", "mc"] and [t["root"] for t in featured["trees"]] == ["mc"] and {n["id"] for n in featured["trees"][0]["nodes"]} == {"mc", "ma", "mb"}
    assert service.name("ma")["cognates"][0].keys() == {"id", "label", "native_label", "language", "gender"} and service.name("ma")["wk"] == "el:maria"
    assert service.graph_expand("ma")["edges"] == [{"source": "ma", "target": i, "confidence": "community", "kind": "cognate"} for i in ("mb", "mc")]
    for call, error in ((lambda: service.graph_tree(), BadRequest), (lambda: service.graph_tree("nobody"), NotFound), (lambda: service.name("nobody"), NotFound), (lambda: service.graph_constellation("nobody"), NotFound), (lambda: service.graph_expand(None), BadRequest)):
        with pytest.raises(error):
            call()


def test_search(spark, demo):
    service = Service(demo, search.trigram_index(demo.names))
    # Maria and Miriam share too few trigrams with the query to be among the first two, but enough to be found.
    assert [r["id"] for r in service.names_search("mary")["results"]][:2] == ["mb", "xx"] and service.names_search("mary")["results"][0].keys() == {"id", "label", "native_label", "language", "gender"}
    assert [r["label"] for r in service.names_search("mary", suggestions=True)][0] == "Mary" and len({r["label"].lower() for r in service.names_search("mary", suggestions=True)}) == len(service.names_search("mary", suggestions=True))
    assert service.names_search("  ")["results"] == [] and service.names_search("m_r%")["total"] >= 3
    assert {r["id"]: round(r["sim"], 4) for r in search.indexed_similarity(search.trigram_index(demo.names), "Mary").collect()}["ma"] == round(3 / 8, 4)
    assert service.home(q="joseph") == "yb" and service.home(name="ya") == "ya" and service.search_page("mary", page=99)["page"] == 1


def model_neighborhood(links, degree, root, most, hop1, hop2):
    rank = lambda ids: sorted(ids, key=lambda i: (-degree[i], i))
    out, first = [(root, 0, None)], rank(links[root])[: max(0, min(hop1, most - 1))]
    out += [(i, 1, root) for i in first]
    seen = {i for i, *_ in out}
    for p in first:
        for n in [x for x in rank(links[p]) if x not in seen][:hop2]:
            if len(out) < most:
                seen.add(n)
                out.append((n, 2, p))
    return set(out)


def test_neighborhood_caps(spark):
    r = random.Random(3)
    pairs = sorted({tuple(sorted(r.sample([f"n{i:02d}" for i in range(40)], 2))) for _ in range(160)})
    links = {}
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    degree = {k: len(v) for k, v in links.items()}
    both = graph.incident(edges(spark, pairs).withColumn("confidence", F.lit("c")), "name_a", "name_b", "confidence").cache()
    names = spark.createDataFrame([(k, k) for k in links], "id string, label string").cache()
    for most, hop1, hop2 in ((30, 28, 6), (12, 4, 2), (2, 5, 5), (1, 3, 3)):
        assert {tuple(x) for x in graph.neighborhood(names, both, "n01", most, hop1, hop2).collect()} == model_neighborhood(links, degree, "n01", most, hop1, hop2)
    assert graph.neighborhood(names, both, "zz").count() == 0
    start = min(links)
    want = graph.pick_island({k: list(v) for k, v in links.items()}, degree, start, 7)
    assert {x["id"] for x in graph.grow_islands(names, both, [start]).collect()} == set(want)


def line(*ids, depth=1):
    return ids, depth


def test_collapse_and_expand():
    nodes = [tree.Node("r", "r", None, 0, None)] + [tree.Node(f"c{i}", f"c{i}", None, 1, "r") for i in range(6)] + [tree.Node(f"g{i}", f"g{i}", None, 2, "c0") for i in range(2)]
    t = tree.Tree("r", nodes, [("r", f"c{i}") for i in range(6)] + [("c0", "g0"), ("c0", "g1")])
    small = tree.collapse_siblings(t, 3)
    group = next(n for n in small.nodes if n.kind == "group")
    assert (group.id, group.label, len(group.members)) == ("group:r:1:4", "+4 more", 4) and {"c0", "c1", "g0", "g1"} <= {n.id for n in small.nodes}
    back = tree.expand_group(small, group.id)
    assert {n.id for n in back.nodes} == {n.id for n in nodes} and tree.collapse_siblings(t, 1) is t
    wide = tree.Tree("r", [tree.Node("r", "r", None, 0, None)] + [tree.Node(p, p, None, 1, "r") for p in "ab"] + [tree.Node(f"{p}{i}", f"{p}{i}", None, 2, p) for p in "ab" for i in range(5)], [("r", "a"), ("r", "b")] + [(p, f"{p}{i}") for p in "ab" for i in range(5)])
    capped = tree.collapse_depths(wide, 4)
    level = [n for n in capped.nodes if n.depth == 2]
    assert len(level) <= 4 and any(n.kind == "group" for n in level) and sum(max(1, len(n.members)) for n in level) == 10


def test_absorbed_ancestors_leave_the_focus():
    nodes = [tree.Node("r", "r", None, 0, None), tree.Node("p", "p", None, -1, "a0")] + [tree.Node(f"a{i}", f"a{i}", None, -2, "top") for i in range(5)] + [tree.Node("top", "top", None, -3, None)]
    t = tree.Tree("r", nodes, [("p", "r")] + [(f"a{i}", "p") for i in range(5)] + [("top", f"a{i}") for i in range(5)])
    assert {"r", "p"} <= {n.id for n in tree.collapse_depths(t, 3).nodes}


def test_layout_spreads_a_sparse_level():
    t = tree.Tree("r", [tree.Node("r", "r", None, 0, None), tree.Node("a", "a", None, 1, "r"), tree.Node("b", "b", None, 1, "r")] + [tree.Node(f"c{i}", "c", None, 2, "a") for i in range(3)], [("r", "a"), ("r", "b")] + [("a", f"c{i}") for i in range(3)])
    placed, scale = layout.layout(t, 1200, 800)
    span = max(y for _, y in placed.values()) - min(y for _, y in placed.values())
    leaves = [placed[f"c{i}"][1] for i in range(3)]
    assert max(leaves) - min(leaves) > 0.7 * span and 0.85 <= scale <= 1.5
    assert layout.layout(tree.Tree("r"), 10, 10) == ({}, 1.0) and layout.lane(t, placed, 9, "horizontal") is None
    assert layout.bracket((0, 0), (100, 50), "horizontal") == "M 16 0 H 40 V 50 H 86" and layout.bracket((0, 0), (50, 100), "vertical") == "M 0 16 V 51 H 50 V 86"


@pytest.mark.parametrize("view,want", [((1200, 800), ("horizontal", 7, 8, 48)), ((1200, 700), ("horizontal", 7, 6, 42)), ((400, 900), ("vertical", 5, 3, 15)), ((500, 400), ("horizontal", 2, 3, 8))])
def test_capacity(view, want):
    c = capacity(*view)
    assert (c.orientation, c.depth_slots, c.breadth_slots, c.max_nodes) == want


@pytest.mark.parametrize("view,hops,want", [((1200, 700), (4, 0), (4, 0, 6, 6, 3)), ((1200, 700), (3, 4), (1, 4, 1, 6, 3)), ((1200, 700), (2, 2), (2, 2, 3, 6, 3)), ((1200, 800), (7, 7), (1, 5, 1, 8, 4)), ((1200, 800), (0, 7), (0, 6, 1, 8, 4)), ((500, 400), (2, 2), (0, 1, 0, 3, 2))])
def test_sides(view, hops, want):
    s = sides(capacity(*view), *hops)
    assert (s.ancestor_depth, s.descendant_depth, s.ancestor_fanout, s.root_fanout, s.branch_fanout) == want


def test_lookalikes(spark):
    names = spark.createDataFrame([("1", "Marie"), ("2", "Mária"), ("3", "Potato"), ("4", "Mary"), ("5", "Li"), ("6", None)], "id string, label string")
    assert [(r["id"], r["score"]) for r in lookalike.rank(names, "Maria", ["4"], 3).collect()] == [("2", 1.0), ("1", 0.92)]
    from stemma.functions.unicode import jaro_winkler, plain

    assert (plain("Zoë"), round(jaro_winkler("john", "jon"), 6), round(jaro_winkler("amy", "may"), 6), round(jaro_winkler("katherine", "catherine"), 6)) == ("zoe", 0.933333, 0.555556, 0.925926)


def test_constraints(spark):
    bad = spark.createDataFrame([("b", "a", "x", "y"), ("a", "b", "x", "y"), ("a", "b", "x", "y"), (None, "b", "x", "y")], "name_a string, name_b string, relation_type string, confidence string")
    assert {r["rule"]: r["n"] for r in merge.violations(bad, "name_relations").collect()} == {"check name_a < name_b": 1, "unique name_a, name_b": 1, "not null name_a": 1}
    with pytest.raises(ValueError):
        merge.enforce(bad, "name_relations")


def test_cheaper_parts_have_the_same_rows(spark, tmp_path):
    """Repeated, missing and one-sided keys: what Spark runs gives the rows of the shared SQL, and groups numbers."""
    spark.createDataFrame([(1, 1, "A"), (1, 1, "N"), (2, 1, "A"), (2, 1, "A"), (None, 5, "R"), (5, None, None), (None, None, "A"), (9, 10, None)], "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(9, "m", 1), (10, "m", 1), (10, "m", 2), (11, "n", None), (None, "m", 1)], "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1), (None, None)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    for t in ("lineitem", "customer", "supplier", "nation"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").createOrReplaceTempView(t)
    for part, ends in (("relations", ("name_a", "name_b")), ("lineage", ("child_id", "parent_id"))):
        made = Catalog.part(spark, str(tmp_path), part)
        want = spark.sql(ADAPTERS[part].replace("AS S)", "AS STRING)"))
        assert made.columns == want.columns
        assert sorted(made.collect(), key=repr) == sorted(want.collect(), key=repr)
        assert "l_partkey#" in [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x and "l_" in x][0]


def test_rules_are_counted_in_one_pass(spark, tmp_path):
    rows = [("a", "b"), ("a", "b"), ("b", "a"), (None, "x"), ("c", "c")]
    spark.createDataFrame(rows, "name_a string, name_b string").write.parquet(f"{tmp_path}/r")
    broken = merge.violations(spark.read.parquet(f"{tmp_path}/r"), "name_relations")
    assert {x["rule"]: x["n"] for x in broken.collect()} == {"check name_a < name_b": 2, "not null name_a": 1, "unique name_a, name_b": 1}
    assert broken._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2  # for rows, and for keys


def test_components_look_at_few_edges_first(spark, monkeypatch):
    """Of dense edges two a node are contracted; the others are only checked, and go on where these leave parts apart."""
    from stemma.operators import components

    sizes, kept = {}, components.materialize
    def spy(df, label):
        out = kept(df, label)
        sizes.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(components, "materialize", spy)
    ids = [f"n{i:02}" for i in range(30)]
    dense = [(a, b) for a in ids for b in ids if a < b]
    assert {tuple(x) for x in connected_components(edges(spark, dense), "name_a", "name_b").collect()} == {(i, "n00") for i in ids}
    assert max(sizes["cc_edges"] + sizes["cc_few"]) <= 60
    # Two stars whose smallest and largest neighbours keep to themselves, and an edge between their middles.
    apart = [(x, f"{x}{i}") for x in "bc" for i in range(5)] + [(f"a{x}", f"{x}{i}") for x in "bc" for i in (1, 2)] + [(f"z{x}", f"{x}{i}") for x in "bc" for i in (1, 2)] + [("b1", "c1")]
    assert {x["root"] for x in connected_components(edges(spark, apart), "name_a", "name_b").collect()} == {"ab"}


def test_featured_roots_read_lineage_for_few_names(spark):
    """Parents are looked up for the few names that may be shown; all of lineage is grouped once, before."""
    names = spark.createDataFrame([("a", "Alpha"), ("b", "Beta"), ("c", "Gamma")], "id string, label string").withColumn("native_label", F.lit(None).cast("string"))
    lineage = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b")], "child_id string, parent_id string")
    made = tree.featured_roots(Catalog(names, None, lineage, None), 1)
    assert [tuple(x) for x in made.collect()] == [("a", "Alpha", 2)]
    assert "child_id" in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and " IN (" in plan
