"""The library's queries over the driver's tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.catalog import Catalog, oracle_with
from stemma.functions import text as tx
from stemma.functions.unicode import jaro_winkler_of, plain_label
from stemma.operators import graph, layout, layouts, lookalike, merge, search, tree, trees, viewport
from stemma.plans import relations as relation_loads
from stemma.plans.relations import merge_relations
from stemma.sources import knowledge, lexical
from stemma.sources.shared import fresh_path, materialize
from stemma.store import Store


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERM = "red"


def query(sql: str | None = None, *parts: str, steps: str = ""):
    """Registers a query under its function's name; sql follows the catalogue's parts and further steps of a WITH clause."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            lead = (oracle_with(*parts) if parts else "WITH RECURSIVE one AS (SELECT 1)") + ("," + steps if steps else "")
            ORACLES[f.__name__] = f"{lead} {sql}"
        return f

    return add


def both_ends(catalog: Catalog) -> DataFrame:
    return graph.incident(catalog.relations, "name_a", "name_b", "confidence")


BOTH = " both_ends AS (SELECT name_a AS id, name_b AS other, confidence FROM relations UNION ALL SELECT name_b, name_a, confidence FROM relations), deg AS (SELECT id, count(*) AS degree FROM both_ends GROUP BY id)"
LDEG = " ldeg AS (SELECT id, count(*) AS degree FROM (SELECT child_id AS id FROM lineage UNION ALL SELECT parent_id FROM lineage) GROUP BY id)"
GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"
_A, _B = GRAMS.format("label"), GRAMS.format(f"'{TERM}'")
FOUND = f" found AS (SELECT *, coalesce(len(list_intersect({_A}, {_B})) / nullif(len(list_distinct(list_concat({_A}, {_B}))), 0), 0) AS sim FROM names), hits AS (SELECT * FROM found WHERE sim >= 0.3 OR label ILIKE '%{TERM}%')"
RANKED = FOUND + "," + BOTH + "," + LDEG + """, ranked AS (SELECT h.*, coalesce(l.degree, 0) AS lineage_degree, coalesce(d.degree, 0) AS cognate_degree,
 row_number() OVER (ORDER BY sim DESC, coalesce(l.degree, 0) DESC, (wk IS NOT NULL) DESC, (language ILIKE 'english') DESC NULLS FIRST, coalesce(d.degree, 0) DESC, h.id) AS place
 FROM hits h LEFT JOIN ldeg l ON l.id = h.id LEFT JOIN deg d ON d.id = h.id)"""
SHOWN = ["id", "label", "language", "gender", "sim", "lineage_degree", "cognate_degree"]
NRL = ("names", "relations", "lineage")
SHOWN_SQL = "SELECT id, label, language, gender, sim, lineage_degree, cognate_degree FROM"


@query(f"{SHOWN_SQL} ranked WHERE place BETWEEN 21 AND 40", *NRL, steps=RANKED)
def search_page(spark, sf):
    return search.search(Catalog.from_tables(spark, sf), f" {TERM} ", page=2, page_size=20).select(SHOWN)


def _stored(spark, sf) -> Catalog:
    """The catalogue in a store: its names come first with other labels, which a second commit corrects, so that the index is
    one that was kept up to date. Names of the driver's tables may share a key or an item, which a store refuses: there the id
    is part of both."""
    c = Catalog.from_tables(spark, sf)
    store = Store(spark, fresh_path(spark, "stored_catalogue"), buckets=16)
    own = lambda x: F.concat(x, F.lit(" "), "id")
    names = c.names.withColumns({"wk": own("wk"), "wikidata_qid": own("wikidata_qid")}).withColumnRenamed("wk", "wiktionary_key")
    wrong = F.crc32("id") % 3 == 0
    whole = {"names": names.withColumn("label", F.when(wrong, F.lit("bored")).otherwise(F.col("label"))), "name_relations": c.relations, "name_lineage": c.lineage}
    # Relations are made once a pair; lineage has no columns but its key.
    store.commit(store.snapshot(), whole | {"name_lineage": c.lineage.distinct()}, whole, once=("name_relations", "name_lineage"))
    store.commit(store.snapshot(), {"names": names.where(wrong)})
    return Catalog.load(spark, store.path)


@query(f"{SHOWN_SQL} ranked WHERE place BETWEEN 21 AND 40", *NRL, steps=RANKED)
def search_indexed(spark, sf):
    """The same page out of a stored catalogue, by the postings of the query's trigrams."""
    c = _stored(spark, sf)
    return search.search(c, TERM, page=2, page_size=20, index=search.StoredIndex(c)).select(SHOWN)


@query(f"{SHOWN_SQL} (SELECT *, row_number() OVER (ORDER BY place) AS n FROM ranked WHERE language ILIKE 'standard') WHERE n <= 20", *NRL, steps=RANKED)
def search_language(spark, sf):
    return search.search(Catalog.from_tables(spark, sf), TERM, language="standard").select(SHOWN)


@query("SELECT count(*) AS total FROM hits", "names", steps=FOUND)
def search_total(spark, sf):
    return search.total(Catalog.from_tables(spark, sf), TERM)


@query(f"{SHOWN_SQL} (SELECT *, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY place) AS n FROM ranked WHERE place <= 50) WHERE n = 1 ORDER BY place LIMIT 10", *NRL, steps=RANKED)
def search_suggest(spark, sf):
    return search.suggest(Catalog.from_tables(spark, sf), TERM, 10).select(SHOWN)


@query(f"SELECT id, list_sort({GRAMS.format('label')}) AS grams FROM names", "names")
def trigram_sets(spark, sf):
    return Catalog.part(spark, sf, "names").select("id", F.array_sort(tx.trigrams(F.col("label"))).alias("grams"))


@query("SELECT language, n FROM (SELECT language, count(*) AS n FROM names WHERE language IS NOT NULL GROUP BY language ORDER BY n DESC, language LIMIT 80) WHERE trim(language) <> ''", "names")
def facet_languages(spark, sf):
    return search.language_facets(Catalog.part(spark, sf, "names"))


HUB = BOTH + ", hub AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1)"


def _hub(c: Catalog) -> str:
    found = graph.degrees(both_ends(c)).orderBy(F.desc("degree"), "id").first()
    return found["id"] if found else ""


@query("SELECT n.id, n.label, n.language FROM names n JOIN (SELECT DISTINCT other FROM both_ends WHERE id = (SELECT id FROM hub)) e ON e.other = n.id ORDER BY n.id LIMIT 50", "names", "relations", steps=HUB)
def detail_cognates(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return search.detail_cognates(c, _hub(c)).select("id", "label", "language")


@query("SELECT name_id, arg_min(content, (CASE field WHEN 'description' THEN '0' WHEN 'meaning' THEN '1' WHEN 'usage' THEN '2' ELSE '3' END) || source || field) AS content FROM enrichments GROUP BY name_id", "enrichments")
def meaning_choice(spark, sf):
    return search.meaning(Catalog.part(spark, sf, "enrichments"))


@query("SELECT n.id, coalesce(d.degree, 0) AS degree FROM names n LEFT JOIN deg d ON d.id = n.id", "names", "relations", steps=BOTH)
def degree_all(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return graph.name_degrees(c.names, both_ends(c))


@query("SELECT n.id, coalesce(d.degree, 0) AS degree FROM names n LEFT JOIN deg d ON d.id = n.id ORDER BY degree DESC, n.id LIMIT 1", "names", "relations", steps=BOTH)
def most_connected(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return graph.most_connected(c.names, both_ends(c))


@query("SELECT n.id, coalesce(d.degree, 0) AS degree FROM names n LEFT JOIN ldeg d ON d.id = n.id", "names", "lineage", steps=LDEG)
def degree_lineage(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return graph.name_degrees(c.names, graph.incident(c.lineage, "child_id", "parent_id"))


NEAR = HUB + ", near AS (SELECT e.other AS id, min(confidence) AS confidence FROM both_ends e WHERE e.id = (SELECT id FROM hub) GROUP BY e.other)"


@query("SELECT n.id, n.label, e.confidence, d.degree FROM near e JOIN names n ON n.id = e.id JOIN deg d ON d.id = e.id", "names", "relations", steps=NEAR)
def neighbors_1hop(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return graph.neighbors(c.names, both_ends(c), _hub(c))


@query("SELECT n.id, n.label, e.confidence, d.degree FROM near e JOIN names n ON n.id = e.id JOIN deg d ON d.id = e.id WHERE e.id <> (SELECT min(id) FROM near) ORDER BY d.degree DESC, n.id LIMIT 28", "names", "relations", steps=NEAR)
def expand_hop1_excl(spark, sf):
    c = Catalog.from_tables(spark, sf)
    both, hub = both_ends(c), _hub(c)
    first = both.where(F.col("id") == hub).agg(F.min("other")).first()[0]
    return graph.expand(c.names, both, hub, [first] if first else [])


@query("""SELECT n.id, n.label, n.language, n.gender, (SELECT string_agg(source || '|' || field || '|' || content, ';' ORDER BY source, field, content) FROM enrichments e WHERE e.name_id = n.id) AS notes,
 (SELECT string_agg(c.id || '|' || c.label, ';' ORDER BY c.id) FROM (SELECT k.id, k.label FROM names k JOIN (SELECT DISTINCT other FROM both_ends b WHERE b.id = n.id) o ON o.other = k.id ORDER BY k.id LIMIT 50) c) AS kin
 FROM names n WHERE n.id = (SELECT id FROM hub) OR n.id = (SELECT min(name_id) FROM enrichments)""", "names", "relations", "enrichments", steps=HUB)
def name_detail(spark, sf):
    """The detail of a name with relations and of one with enrichments."""
    c = Catalog.from_tables(spark, sf)
    told = search.detail(c, _hub(c)).union(search.detail(c, c.enrichments.agg(F.min("name_id")).first()[0]))
    joined = lambda c, *fields: F.nullif(F.array_join(F.transform(c, lambda x: F.concat_ws("|", *(x[f] for f in fields))), ";"), F.lit(""))
    return told.select("id", "label", "language", "gender", joined("enrichments", "source", "field", "content").alias("notes"), joined("cognates", "id", "label").alias("kin"))


def _two_hops(most: int, hop1: int, hop2: int) -> str:
    """The greedy choice in order: a parent's best neighbours not yet taken, the list of those taken handed from row to row."""
    return NEAR + f""", hop1 AS (SELECT id, r FROM (SELECT e.id, row_number() OVER (ORDER BY d.degree DESC, e.id) AS r FROM near e JOIN names n ON n.id = e.id JOIN deg d ON d.id = e.id) WHERE r <= {min(hop1, most - 1)}),
 near2 AS (SELECT h.r, h.id AS parent, list(b.other ORDER BY d.degree DESC, b.other) AS near FROM hop1 h JOIN (SELECT DISTINCT id, other FROM both_ends) b ON b.id = h.id JOIN names n ON n.id = b.other JOIN deg d ON d.id = b.other GROUP BY h.r, h.id),
 grow AS (SELECT CAST(0 AS BIGINT) AS k, list_concat([(SELECT id FROM hub)], (SELECT list(id ORDER BY r) FROM hop1)) AS taken, CAST([] AS VARCHAR[]) AS fresh, CAST(NULL AS VARCHAR) AS parent
  UNION ALL SELECT k + 1, list_concat(taken, added), added, up FROM (SELECT g.k, g.taken, n.parent AS up, list_slice(list_filter(n.near, lambda x: NOT list_contains(g.taken, x)), 1, least({hop2}, greatest(0, {most} - len(g.taken)))) AS added FROM grow g JOIN near2 n ON n.r = g.k + 1))"""


TWO_SQL = "SELECT id, 0 AS depth, CAST(NULL AS VARCHAR) AS parent FROM hub UNION ALL SELECT id, 1, (SELECT id FROM hub) FROM hop1 UNION ALL SELECT unnest(fresh), 2, parent FROM grow"


@query(TWO_SQL, "names", "relations", steps=_two_hops(30, 28, 6))
def focus_neighborhood(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return graph.neighborhood(c.names, both_ends(c), _hub(c))


@query(TWO_SQL, "names", "relations", steps=_two_hops(60, 15, 5))
def cognate_subgraph(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return graph.subgraph(c.names, both_ends(c), _hub(c))


@query(TWO_SQL, "names", "relations", steps=_two_hops(51, 28, 6))
def expand_two_hops(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return graph.expand_two(c.names, both_ends(c), _hub(c))


PARTS = BOTH + """, reach(id, root) USING KEY (id) AS (SELECT id, id AS root FROM deg UNION SELECT b.id, min(r.root) FROM reach r JOIN both_ends b ON b.other = r.id JOIN recurring.reach mine ON mine.id = b.id WHERE r.root < mine.root GROUP BY b.id),
 parts AS (SELECT id, root AS component FROM reach), sized AS (SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM parts)"""


@query("SELECT id, component, size FROM sized", "relations", steps=PARTS)
def components(spark, sf):
    return graph.components(Catalog.part(spark, sf, "relations"))


def _closure_sql(cap: int) -> str:
    return f"SELECT x.id AS a, y.id AS b FROM sized x JOIN sized y ON x.component = y.component AND x.id < y.id WHERE x.size <= {cap} UNION SELECT name_a, name_b FROM relations JOIN sized ON id = name_a WHERE size > {cap}"


@query(_closure_sql(80), "relations", steps=PARTS)
def closure(spark, sf):
    return graph.closure(Catalog.part(spark, sf, "relations"))


@query(_closure_sql(3), "relations", steps=PARTS)
def closure_capped(spark, sf):
    return graph.closure(Catalog.part(spark, sf, "relations"), cap=3)


@query("SELECT count(DISTINCT component) AS skipped FROM sized WHERE size > 3", "relations", steps=PARTS)
def closure_skipped(spark, sf):
    return graph.closure_skipped(Catalog.part(spark, sf, "relations"), cap=3)


def _in_parts(spark, sf, cap: int) -> Store:
    """A store whose relations came in two parts, by a hash of the pair."""
    store = Store(spark, fresh_path(spark, "relations_in_parts"), buckets=8)
    relations = Catalog.part(spark, sf, "relations").select("name_a", "name_b", F.pmod(F.xxhash64("name_a", "name_b"), F.lit(2)).alias("part"))
    relations = materialize(relations, "relations_given")
    for n in range(2):
        merge_relations(store, relations.where(F.col("part") == n), cap=cap)
    return store


@query(_closure_sql(80).replace("x.id AS a, y.id AS b", "x.id AS name_a, y.id AS name_b"), "relations", steps=PARTS)
def relations_in_parts(spark, sf):
    """What a store holds after two loads, each closed: the closure of all of them at once."""
    return _in_parts(spark, sf, 80).snapshot().table("name_relations").select("name_a", "name_b")


@query(_closure_sql(3).replace("x.id AS a, y.id AS b", "x.id AS name_a, y.id AS name_b"), "relations", steps=PARTS)
def relations_in_parts_capped(spark, sf):
    """The same with a cap that components pass from one load to the next, so that pairs go again."""
    return _in_parts(spark, sf, 3).snapshot().table("name_relations").select("name_a", "name_b")


@query("SELECT id, component, size FROM sized", "relations", steps=PARTS)
def components_in_parts(spark, sf):
    """The components that a store keeps from load to load."""
    return relation_loads.components(_in_parts(spark, sf, 80).snapshot())


HUBS = PARTS + ", best AS (SELECT component, id AS hub_id, degree, row_number() OVER (PARTITION BY component ORDER BY degree DESC, id) AS n FROM parts JOIN deg USING (id)), hubs AS (SELECT component, hub_id, degree FROM best WHERE n = 1 ORDER BY degree DESC, hub_id LIMIT 20)"


def _parts(c: Catalog) -> DataFrame:
    return graph.components(c.relations).select("id", "component")


@query("SELECT component, hub_id, degree FROM hubs", "relations", steps=HUBS)
def constellation_hubs(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return graph.hubs(both_ends(c), _parts(c))


def _islands(starts: str, name: str = "isle") -> str:
    """Breadth first from each start (hub_id), a node's neighbours by degree, seven nodes: the queue is handed from row to row."""
    return f""", {name}_near AS (SELECT b.id, list(b.other ORDER BY d.degree DESC, b.other) AS near FROM (SELECT DISTINCT id, other FROM both_ends) b JOIN deg d ON d.id = b.other GROUP BY b.id),
 {name}_grow AS (SELECT h.hub_id, [h.hub_id] AS taken, n.near AS queue, 0 AS step FROM {starts} h JOIN {name}_near n ON n.id = h.hub_id
  UNION ALL SELECT g.hub_id, CASE WHEN list_contains(g.taken, g.queue[1]) THEN g.taken ELSE list_append(g.taken, g.queue[1]) END,
   CASE WHEN list_contains(g.taken, g.queue[1]) THEN list_slice(g.queue, 2, len(g.queue)) ELSE list_concat(list_slice(g.queue, 2, len(g.queue)), list_filter(n.near, lambda x: NOT list_contains(g.taken, x) AND x <> g.queue[1])) END, g.step + 1
  FROM {name}_grow g JOIN {name}_near n ON n.id = g.queue[1] WHERE len(g.taken) < 7 AND len(g.queue) > 0),
 {name}_all AS (SELECT hub_id, unnest(taken) AS id FROM (SELECT *, row_number() OVER (PARTITION BY hub_id ORDER BY step DESC) AS n FROM {name}_grow) WHERE n = 1),
 {name} AS (SELECT hub_id, id, CASE WHEN id = hub_id THEN 0 WHEN EXISTS (SELECT 1 FROM both_ends b WHERE b.id = m.hub_id AND b.other = m.id) THEN 1 ELSE 2 END AS depth FROM {name}_all m)"""


WALK = HUBS + _islands("hubs")


@query("SELECT hub_id, id, depth FROM isle JOIN names USING (id)", "names", "relations", steps=WALK)
def constellation_islands(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return graph.constellation(c.names, both_ends(c), _parts(c))


def _around_sql(most: int, caps: tuple[int, ...], named: bool) -> str:
    """Breadth first from every name with relations, a cap for each depth: the queue is handed from row to row."""
    cap = " ".join(f"WHEN {d} THEN {c}" for d, c in enumerate(caps))
    only = "WHERE b.other IN (SELECT id FROM names)" if named else ""
    return BOTH + f""", near AS (SELECT b.id, list(b.other ORDER BY d.degree DESC, b.other) AS others FROM (SELECT DISTINCT id, other FROM both_ends) b JOIN deg d ON d.id = b.other {only} GROUP BY b.id),
 walk AS (SELECT id AS root, [id] AS taken, [{{'id': id, 'depth': 0}}] AS queue, CAST([] AS STRUCT(id VARCHAR, near VARCHAR, depth INTEGER)[]) AS got, 0 AS step FROM (SELECT DISTINCT id FROM both_ends JOIN names USING (id))
  UNION ALL SELECT root, list_concat(taken, picks), list_concat(queue[2:], list_transform(picks, lambda x: {{'id': x, 'depth': queue[1].depth + 1}})), list_concat(got, list_transform(picks, lambda x: {{'id': x, 'near': queue[1].id, 'depth': CAST(queue[1].depth + 1 AS INTEGER)}})), step + 1
  FROM (SELECT w.*, CASE WHEN queue[1].depth >= {len(caps)} OR n.others IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_filter(n.others, lambda x: NOT list_contains(taken, x))[1:greatest(0, least(CASE queue[1].depth {cap} END, {most} - len(taken)))] END AS picks
   FROM walk w LEFT JOIN near n ON n.id = queue[1].id WHERE len(queue) > 0 AND len(taken) < {most})),
 around AS (SELECT root, root AS id, 0 AS depth, CAST(NULL AS VARCHAR) AS near FROM walk WHERE step = 0 UNION ALL SELECT root, g.id, g.depth, g.near FROM (SELECT root, unnest(got) AS g FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY step DESC) AS last FROM walk) WHERE last = 1))"""


@query("SELECT root, id, depth, near AS parent FROM around", "names", "relations", steps=_around_sql(30, (28, 6), True))
def neighborhoods(spark, sf):
    """The neighbourhoods of all names with relations."""
    c = Catalog.from_tables(spark, sf)
    both = both_ends(c)
    return graph.neighborhoods(c.names, both, both.select("id"))


@query("SELECT root AS hub_id, id, least(depth, 2) AS depth FROM around JOIN names USING (id)", "names", "relations", steps=_around_sql(7, (7,) * 6, False))
def islands(spark, sf):
    """The islands around all names with relations."""
    c = Catalog.from_tables(spark, sf)
    both = both_ends(c)
    return graph.islands(c.names, both, both.select("id").join(c.names.select("id"), "id", "left_semi"))


@query("SELECT DISTINCT x.hub_id, name_a AS a, name_b AS b FROM relations JOIN isle x ON x.id = name_a JOIN isle y ON y.hub_id = x.hub_id AND y.id = name_b", "names", "relations", steps=WALK)
def constellation_edges(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return graph.induced_edges(c.relations, graph.constellation(c.names, both_ends(c), _parts(c)))


OWN = HUBS + ", who AS (SELECT component AS name_id, hub_id AS hub FROM hubs ORDER BY degree DESC, hub_id LIMIT 1), tops AS (SELECT hub AS hub_id FROM who), owns AS (SELECT name_id AS hub_id FROM who)" + _islands("tops") + _islands("owns", "mine")


@query("""SELECT hub_id, id, depth FROM isle JOIN names USING (id) WHERE (SELECT name_id FROM who) IN (SELECT id FROM isle)
 UNION ALL SELECT CASE WHEN (SELECT hub FROM who) IN (SELECT id FROM mine) THEN (SELECT hub FROM who) ELSE hub_id END, id, depth FROM mine JOIN names USING (id) WHERE (SELECT name_id FROM who) NOT IN (SELECT id FROM isle)""", "names", "relations", steps=OWN)
def island_for_name(spark, sf):
    c = Catalog.from_tables(spark, sf)
    both, parts = both_ends(c), _parts(c)
    best = graph.hubs(both, parts, 1).first()
    return graph.island_of(c.names, both, parts, best["component"] if best else "")


@query("SELECT parent_id AS id, child_id AS child FROM lineage WHERE parent_id IN ('N11', 'S1', 'R0')", "lineage")
def children_of(spark, sf):
    return tree.children_of(Catalog.part(spark, sf, "lineage"), ["N11", "S1", "R0"])


@query("SELECT child_id AS id, parent_id AS parent FROM lineage WHERE child_id IN ('N11', 'S1', 'C7')", "lineage")
def parents_of(spark, sf):
    return tree.parents_of(Catalog.part(spark, sf, "lineage"), ["N11", "S1", "C7"])


@query("SELECT n.id, count(l.child_id) AS n FROM names n LEFT JOIN lineage l ON l.parent_id = n.id GROUP BY n.id", "names", "lineage")
def child_counts(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return tree.child_counts(c.names, c.lineage)


@query("""SELECT f.id, CASE WHEN d.degree > 0 THEN f.id ELSE coalesce((SELECT t.id FROM names t JOIN ldeg x ON x.id = t.id WHERE lower(t.label) = lower(f.label)
  ORDER BY x.degree DESC, (t.language ILIKE coalesce(f.language, 'english')) DESC NULLS FIRST, (t.wk IS NOT NULL) DESC, t.id LIMIT 1), f.id) END AS twin
  FROM names f LEFT JOIN ldeg d ON d.id = f.id""", "names", "lineage", steps=LDEG)
def twin_resolve(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return tree.resolve_twins(c, c.names)


FIT = "(length(trim({0})) >= 2 AND NOT regexp_matches(trim({0}), '^[-–—.*·•_…]+$') AND regexp_matches({0}, '\\p{{L}}'))"


def _featured_sql(count: int) -> str:
    return f"""SELECT id, label, kids FROM (SELECT *, sum(CAST(good AS INT)) OVER () AS n_good FROM (
 SELECT id, label, kids, (SELECT count(*) FROM lineage l WHERE l.child_id = x.id) = 0 AND NOT contains(label, ',') AND len(regexp_split_to_array(label, '\\s+')) <= 2 AS good FROM (
 SELECT t.id, trim(CASE WHEN {FIT.format("n.label")} THEN n.label WHEN {FIT.format("n.native_label")} THEN n.native_label END) AS label, t.kids
 FROM (SELECT parent_id AS id, count(*) AS kids FROM lineage GROUP BY parent_id ORDER BY kids DESC, id LIMIT {count * 40}) t JOIN names n ON n.id = t.id) x WHERE label IS NOT NULL))
 WHERE n_good < {count} OR good ORDER BY kids DESC, id LIMIT {count}"""


@query(_featured_sql(5), "names", "lineage")
def featured_roots(spark, sf):
    return tree.featured_roots(Catalog.from_tables(spark, sf), 5)


@query(_featured_sql(6), "names", "lineage")
def featured_roots_usable(spark, sf):
    return tree.featured_roots(Catalog.from_tables(spark, sf), 6)


def _trees_sql(roots: str) -> str:
    """Breadth first from each root down, then up: the queue and the nodes taken are handed from row to row."""
    room = viewport.capacity(1200, 800)
    plan = trees.plans(room)
    pick = lambda n: "CASE " + " ".join(f"WHEN up = {u} AND down = {d} THEN {row[n]}" for (u, d), row in plan.items()) + " END"

    def walk(name: str, start: str, best: str, sign: int, levels: str, at_root: str) -> str:
        return f""" {name} AS (SELECT root, levels_down, levels_up, root_down, root_up, branch, taken, [{{'id': root, 'depth': 0}}] AS queue, CAST([] AS STRUCT(id VARCHAR, near VARCHAR, depth INTEGER)[]) AS got, 0 AS step FROM {start}
  UNION ALL SELECT root, levels_down, levels_up, root_down, root_up, branch, list_concat(taken, picks), list_concat(queue[2:], list_transform(picks, lambda x: {{'id': x, 'depth': queue[1].depth + 1}})),
   list_concat(got, list_transform(picks, lambda x: {{'id': x, 'near': queue[1].id, 'depth': CAST({sign} * (queue[1].depth + 1) AS INTEGER)}})), step + 1
  FROM (SELECT w.*, CASE WHEN queue[1].depth >= {levels} OR b.others IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_filter(b.others, lambda x: NOT list_contains(taken, x))[1:greatest(0, least(CASE WHEN queue[1].depth = 0 THEN {at_root} ELSE branch END, {room.max_nodes} - len(taken)))] END AS picks
   FROM {name} w LEFT JOIN {best} b ON b.near = queue[1].id WHERE len(queue) > 0)),
 {name}_done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY step DESC) AS last FROM {name}) WHERE last = 1)"""

    return f""" kids AS (SELECT parent_id AS id, count(*) AS n FROM lineage GROUP BY 1), ups AS (SELECT child_id AS id, count(*) AS n FROM lineage GROUP BY 1),
 below AS (SELECT parent_id AS near, list(child_id ORDER BY coalesce(k.n, 0) DESC, child_id) AS others FROM (SELECT DISTINCT parent_id, child_id FROM lineage JOIN names ON names.id = child_id) LEFT JOIN kids k ON k.id = child_id GROUP BY 1),
 above AS (SELECT child_id AS near, list(parent_id ORDER BY coalesce(u.n, 0) DESC, coalesce(k.n, 0) DESC, parent_id) AS others FROM (SELECT DISTINCT parent_id, child_id FROM lineage JOIN names ON names.id = parent_id) LEFT JOIN kids k ON k.id = parent_id LEFT JOIN ups u ON u.id = parent_id GROUP BY 1),
 begun AS (SELECT root, {pick(0)} AS levels_down, {pick(1)} AS levels_up, {pick(2)} AS root_down, {pick(3)} AS root_up, {pick(4)} AS branch, [root] AS taken
  FROM (SELECT root, root IN (SELECT near FROM above) AS up, root IN (SELECT near FROM below) AS down FROM ({roots}))),
{walk("fell", "begun", "below", 1, "levels_down", "root_down")},{walk("rose", "fell_done", "above", -1, "levels_up", "root_up")},
 climbed AS (SELECT root, n, unnest.id AS id, unnest.near AS near, unnest.depth AS depth FROM (SELECT root, unnest(got) AS unnest, generate_subscripts(got, 1) AS n FROM rose_done)),
 grown AS (SELECT root, root AS id, 0 AS depth, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS near, 0 AS place FROM begun UNION ALL SELECT root, g.id, g.depth, g.near, g.near, n FROM (SELECT root, unnest(got) AS g, generate_subscripts(got, 1) AS n FROM fell_done)
  UNION ALL SELECT root, id, depth, (SELECT arg_max(o.id, o.n) FROM climbed o WHERE o.root = c.root AND o.near = c.id), near, 1000 + n FROM climbed c)"""


ALL_ROOTS = "SELECT id AS root FROM names JOIN (SELECT parent_id AS id FROM lineage UNION SELECT child_id FROM lineage) USING (id)"


@query("SELECT id, label, depth, parent FROM grown JOIN names USING (id)", "names", "lineage", steps=_trees_sql("SELECT 'N11' AS root"))
def lineage_tree(spark, sf):
    return tree.tree_rows(spark, tree.lineage_tree(Catalog.from_tables(spark, sf), "N11", collapse=False))[0].select("id", "label", "depth", "parent")


@query("SELECT root, id, depth, parent FROM grown", "names", "lineage", steps=_trees_sql(ALL_ROOTS))
def lineage_trees(spark, sf):
    """The trees around all names with lineage, in one plan."""
    c = Catalog.from_tables(spark, sf)
    return trees.lineage_trees(c).select("root", "id", "depth", "parent")


_PLACED = """, t AS (SELECT grown.*, sign(depth) AS side, label FROM grown JOIN names USING (id)),
 hung AS (SELECT root, side, id, near FROM t WHERE depth <> 0 AND (root, side, id) NOT IN (SELECT (root, side, near) FROM t WHERE depth <> 0) UNION ALL SELECT t.root, t.side, t.id, t.near FROM hung JOIN t ON t.root = hung.root AND t.side = hung.side AND t.id = hung.near),
 w AS (SELECT root, side, id, count(*) AS weight FROM hung GROUP BY ALL),
 sib AS (SELECT t.root, t.side, t.id, t.near, depth, weight, sum(weight) OVER s AS whole, count(*) OVER s AS n, sum(weight) OVER (s ORDER BY place) - weight AS before, row_number() OVER (s ORDER BY place) - 1 AS idx
  FROM t JOIN w ON t.root = w.root AND t.side = w.side AND t.id = w.id WINDOW s AS (PARTITION BY t.root, t.side, t.near)),
 pos AS (SELECT DISTINCT root, side, root AS id, 0 AS depth, -26.0::DOUBLE * whole AS low, 26.0::DOUBLE * whole AS high, 0::DOUBLE AS a, 0::DOUBLE AS b FROM sib WHERE near = root
  UNION ALL SELECT root, side, id, depth, a + least((b - a) * 0.04, 8), b - least((b - a) * 0.04, 8), a, b FROM (
   SELECT root, side, id, depth, start AS a, start + room * weight / whole AS b FROM (SELECT *, low + room * before / whole + gutter * idx AS start FROM (SELECT *, greatest(span - gutter * (n - 1), 1) AS room FROM (SELECT *, least(span * 0.02, 12) AS gutter FROM (
    SELECT s.*, p.low, greatest(p.high - p.low, 1)::DOUBLE AS span FROM pos p JOIN sib s ON s.root = p.root AND s.side = p.side AND s.near = p.id)))))),
 raw AS (SELECT t.root, t.id, t.depth, t.label, t.place, coalesce(parent, t.id) AS elder, CASE WHEN t.depth = 0 THEN 0 ELSE (p.a + p.b) / 2 END AS breadth FROM t LEFT JOIN pos p ON p.root = t.root AND p.id = t.id AND p.depth = t.depth AND t.depth <> 0),
 spread AS (SELECT root, id, depth, label, CASE WHEN hi - lo >= 1 AND n > 1 AND far - near < (hi - lo) * 0.65 AND kin THEN lo + (hi - lo) * k / (n - 1) ELSE breadth END AS py FROM (
  SELECT *, min(breadth) OVER (PARTITION BY root) AS lo, max(breadth) OVER (PARTITION BY root) AS hi, count(*) OVER l AS n, min(breadth) OVER l AS near, max(breadth) OVER l AS far, row_number() OVER (l ORDER BY breadth, place) - 1 AS k, min(elder) OVER l = max(elder) OVER l AS kin
  FROM raw WINDOW l AS (PARTITION BY root, depth))),
 box AS (SELECT *, 120.0::DOUBLE * depth AS px, least(length(label), 22) * CASE abs(depth) WHEN 0 THEN 28 WHEN 1 THEN 16 ELSE 13 END * 0.55::DOUBLE + 28 AS w, CASE abs(depth) WHEN 0 THEN 72 WHEN 1 THEN 52 ELSE 44 END AS h FROM spread),
 fit AS (SELECT *, least(fy, sx * 1.75) AS sy FROM (SELECT *, least(fx, fy * 1.75) AS sx FROM (SELECT *, 964.0::DOUBLE / wide AS fx, 656.0::DOUBLE / tall AS fy FROM (
  SELECT root, min(px) AS x0, min(py - h * 0.35) AS y0, greatest(max(px + w) - min(px), 1) AS wide, greatest(max(py + h * 0.35) - min(py - h * 0.35), 1) AS tall FROM box GROUP BY root)))),
 placed AS (SELECT b.root, b.id, b.depth, 96 + greatest(0, (964 - wide * sx) / 2) + (px - x0) * sx AS x, 88 + greatest(0, (656 - tall * sy) / 2) + (py - y0) * sy AS y, least(greatest(least(sx, sy) * 0.95, 0.85), 1.5) AS scale FROM box b JOIN fit USING (root))"""
_EVERY_TREE = _trees_sql(ALL_ROOTS)


def _all_trees(spark, sf) -> DataFrame:
    c = Catalog.from_tables(spark, sf)
    return trees.lineage_trees(c).join(c.names.select("id", "label"), "id")


@query("SELECT root, id, weight FROM w", "names", "lineage", steps=_EVERY_TREE + _PLACED)
def tree_weights(spark, sf):
    """What hangs on each node of all trees."""
    return layouts.weights(_all_trees(spark, sf)).select("root", "id", "weight")


@query("SELECT root, id, depth, round(x, 3) AS x, round(y, 3) AS y, round(scale, 3) AS scale FROM placed", "names", "lineage", steps=_EVERY_TREE + _PLACED)
def tree_positions(spark, sf):
    """Where the nodes of all trees go in a viewport."""
    placed = layouts.positions(_all_trees(spark, sf), 1200, 800)
    return placed.select("root", "id", "depth", *(F.round(c, 3).alias(c) for c in ("x", "y", "scale")))


@query("SELECT root, depth, count(*) AS n, round(avg(x), 3) AS lane FROM placed GROUP BY ALL", "names", "lineage", steps=_EVERY_TREE + _PLACED)
def tree_lanes(spark, sf):
    """Nodes and mean position of every level of all trees."""
    found = layouts.lanes(layouts.positions(_all_trees(spark, sf), 1200, 800), F.col("x"))
    return found.withColumn("lane", F.round("lane", 3))


@query()
def tree_collapsed(spark, sf):
    made = tree.tree_rows(spark, tree.lineage_tree(Catalog.from_tables(spark, sf), "N11"))[0]
    return made.select("id", "label", "depth", "parent", "kind", F.size("members").alias("n_members"))


@query()
def tree_expanded(spark, sf):
    made = tree.lineage_tree(Catalog.from_tables(spark, sf), "N11")
    group = next((n.id for n in made.nodes if n.kind == "group"), "") if made else ""
    return tree.tree_rows(spark, tree.expand_group(made, group) if made else None)[1]


@query()
def tree_layout(spark, sf):
    """The collapsed tree of one name."""
    made = tree.lineage_tree(Catalog.from_tables(spark, sf), "N11")
    placed = layout.layout(made, 1200, 800)[0] if made else {}
    return spark.createDataFrame([(i, round(x, 6), round(y, 6)) for i, (x, y) in placed.items()], "id string, x double, y double")


VIEW = "SELECT DISTINCT 300 + 100 * (p_size % 17) AS w, 250 + 50 * (p_size % 23) AS h FROM part"
SLOTS = f" v AS ({VIEW}), s AS (SELECT w, h, CASE WHEN h > w THEN 'vertical' ELSE 'horizontal' END AS orientation, least(7, greatest(2, CAST(floor(greatest(greatest(w, h) - 160, 200) / 130.0) AS INT))) AS depth_slots, least(14, greatest(3, CAST(floor(greatest(least(w, h) - 160, 120) / 78.0) AS INT))) AS breadth_slots FROM v)"


@query("SELECT w, h, orientation, depth_slots, breadth_slots, least(48, greatest(8, depth_slots * least(breadth_slots, 8))) AS max_nodes FROM s", steps=SLOTS)
def capacity(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    v = part.select((300 + 100 * (F.col("p_size") % 17)).alias("w"), (250 + 50 * (F.col("p_size") % 23)).alias("h")).distinct()
    return v.select("w", "h", viewport.capacity_of(F.col("w"), F.col("h")).alias("room")).select("w", "h", "room.*")


LEVELS = SLOTS + """, c AS (SELECT DISTINCT depth_slots, breadth_slots, depth_slots - 1 AS levels, u.up, d.down FROM s, range(0, 8) u(up), range(0, 8) d(down)),
 a AS (SELECT *, CASE WHEN down <= 0 THEN least(levels, up) WHEN down >= 3 THEN least(1, up) WHEN up <= 0 OR levels < 2 THEN 0 ELSE least(least(up, levels - 1), greatest(1, CAST(floor(levels * up / (up + down) + 0.5) AS INT))) END AS above FROM c),
 b AS (SELECT *, CASE WHEN down <= 0 THEN 0 WHEN down >= 3 THEN least(levels - above, down) WHEN up <= 0 THEN least(levels, down) WHEN levels < 2 THEN least(1, down) ELSE least(levels - above, down) END AS below FROM a)"""


@query("""SELECT depth_slots, breadth_slots, up, down, total AS ancestor_depth, below AS descendant_depth, greatest(fan, CASE WHEN total > 0 THEN 1 ELSE 0 END) AS ancestor_fanout, breadth_slots AS root_fanout, greatest(2, CAST(ceil(breadth_slots / 2) AS INT)) AS branch_fanout FROM (
 SELECT *, above + CASE WHEN down BETWEEN 1 AND 2 AND up > 0 AND levels >= 2 THEN least(levels - above - below, up - above) ELSE 0 END AS total,
  CASE WHEN down <= 0 THEN breadth_slots WHEN down >= 3 THEN 1 WHEN up <= 0 THEN breadth_slots WHEN levels < 2 THEN 0 ELSE least(breadth_slots, 3) END AS fan FROM b)""", steps=LEVELS)
def side_allocation(spark, sf):
    hops = F.explode(F.sequence(F.lit(0), F.lit(7)))
    every = capacity(spark, sf).select("depth_slots", "breadth_slots").distinct().withColumn("up", hops).withColumn("down", hops)
    share = viewport.sides_of(*(F.col(c) for c in ("depth_slots", "breadth_slots", "up", "down")))
    return every.select("*", share.alias("share")).select("depth_slots", "breadth_slots", "up", "down", "share.*")


@query("""SELECT id, round(lo + band / 2, 6) AS centre FROM (SELECT id, band, sum(band) OVER (PARTITION BY parent ORDER BY id ROWS UNBOUNDED PRECEDING) - band + 12 * (row_number() OVER (PARTITION BY parent ORDER BY id) - 1) AS lo
 FROM (SELECT id, parent, (1000 - 12 * (count(*) OVER (PARTITION BY parent) - 1)) * w / sum(w) OVER (PARTITION BY parent) AS band FROM (
  SELECT n.child_id AS id, n.parent_id AS parent, 1 + (SELECT count(*) FROM lineage k WHERE k.parent_id = n.child_id) AS w FROM lineage n WHERE n.parent_id LIKE 'R%')))""", "lineage")
def layout_bands(spark, sf):
    """Bands over the regions' nations by weight, for all trees at once: a region's few nations in one group."""
    lineage = Catalog.part(spark, sf, "lineage")
    roots = lineage.where(F.col("parent_id").like("R%")).select(F.col("child_id").alias("id"), F.col("parent_id").alias("parent"))
    weighed = tree.child_counts(roots, lineage).join(roots, "id").withColumn("w", F.col("n") + 1)

    def split(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id")
        return pd.DataFrame({"id": x["id"], "centre": [round((a + b) / 2, 6) for a, b in layout.bands(x["w"].tolist(), 0, 1000)]})

    return weighed.groupBy("parent").applyInPandas(split, "id string, centre double")


_FILLED = ("native_label", "language", "gender", "description")
_SCORE = "(CASE WHEN lower(coalesce({0}.language, '')) = 'english' THEN 4 ELSE 0 END + CASE WHEN {0}.native_label IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN {0}.description IS NOT NULL THEN 1 ELSE 0 END)"
_FOLD = ", ".join(f"'{c}': CASE WHEN {_SCORE.format('r')} >= {_SCORE.format('a')} THEN coalesce(r.{c}, a.{c}) ELSE coalesce(a.{c}, r.{c}) END" for c in _FILLED)


@query(f"""SELECT qid, w.label AS label, {", ".join(f"w.{c} AS {c}" for c in _FILLED)} FROM (
 SELECT qid, list_reduce(list({{'label': label, {", ".join(f"'{c}': {c}" for c in _FILLED)}}} ORDER BY o), lambda a, r: {{'label': CASE WHEN {_SCORE.format('r')} >= {_SCORE.format('a')} THEN r.label ELSE a.label END, {_FOLD}}}) AS w FROM (
  SELECT 'Q' || CAST(p_partkey // 5 AS VARCHAR) AS qid, p_partkey AS o, p_name AS label, CASE WHEN p_size % 3 = 0 THEN p_brand END AS native_label, CASE p_size % 4 WHEN 0 THEN 'English' WHEN 1 THEN 'German' END AS language,
   CASE p_size % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender, CASE WHEN p_size % 2 = 0 THEN p_type END AS description FROM part) GROUP BY qid)""")
def dedupe_qid(spark, sf):
    """Five rows a key, folded in order."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    size = F.col("p_size")
    rows = part.select(F.concat(F.lit("Q"), F.floor(F.col("p_partkey") / 5).cast("string")).alias("qid"), F.col("p_partkey").alias("o"), F.col("p_name").alias("label"), F.when(size % 3 == 0, F.col("p_brand")).alias("native_label"),
                       F.when(size % 4 == 0, "English").when(size % 4 == 1, "German").alias("language"), F.when(size % 5 == 0, "male").when(size % 5 == 1, "female").alias("gender"), F.when(size % 2 == 0, F.col("p_type")).alias("description"))
    return knowledge.dedupe_by_qid(rows, "o").select("qid", "label", *_FILLED)


def _entries(spark, sf) -> DataFrame:
    """Dictionary entries made from parts: the text is theirs, the templates follow their size. A part is a few bytes of a
    file and much work, so that the parts of one row group are dealt out."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    first, last = F.initcap(F.substring_index("p_name", " ", 1)), F.initcap(F.substring_index("p_name", " ", -1))
    size = F.col("p_size")
    gloss = F.when(size % 5 == 0, F.concat(F.lit("a diminutive of the female given name "), last, F.lit(", rare"))).when(size % 5 == 1, F.concat(F.lit("variant of the given name "), last, F.lit("."))).when(size % 5 == 2, "a male given name").otherwise("a thing")
    template = lambda name, **args: F.struct(F.lit(name).alias("name"), F.create_map(*(x for k, v in args.items() for x in (F.lit(k.replace("_", "")), v))).alias("args"), F.lit("").alias("expansion"))
    head = F.when(size % 7 == 0, F.array(template("given name", _1=F.lit("en"), _2=F.lit("male"), **{"from": F.concat(F.lit("fr:"), last, F.lit(" < la:"), last, F.lit("us"))})))
    etymology = F.when(size % 3 == 0, F.array(template("bor", _1=F.lit("en"), _2=F.lit("fr"), _3=last)))
    descendants = F.when(size % 4 == 0, F.array(F.struct(F.lit("Danish").alias("lang"), F.lit("da").alias("lang_code"), last.alias("word"))))
    entry = F.struct(first.alias("word"), F.lit("English").alias("lang"), F.lit("en").alias("lang_code"), head.alias("head_templates"), etymology.alias("etymology_templates"), descendants.alias("descendants"), F.array(F.struct(F.array(gloss).alias("glosses"))).alias("senses"))
    return lexical.parse(part.select(F.to_json(entry).alias("value"), F.struct(F.col("p_partkey").alias("line")).alias("at")))


_E = """e AS (SELECT p_partkey AS o, p_size, upper(a[1]) || a[2:] AS wa, upper(b[1]) || b[2:] AS wb, a, b, p_size % 5 <= 2 OR p_size % 7 = 0 AS given FROM (
  SELECT p_partkey, p_size, lower(split_part(p_name, ' ', 1)) AS a, lower(regexp_extract(p_name, '[^ ]*$')) AS b FROM part))"""
#: The rules' edges: an entry's steps in order, with language codes and labels of child and parent.
_RULES = ["SELECT o, 0 AS place, 'en' AS cc, wa AS cl, 'fr' AS pc, wb AS pl, 'derived_from' AS kind, wa FROM e WHERE p_size % 7 = 0", "SELECT o, 1, 'fr', wb, 'la', wb || 'us', 'derived_from', wa FROM e WHERE p_size % 7 = 0",
          "SELECT o, 2, 'en', wa, 'fr', wb, 'derived_from', wa FROM e WHERE given AND p_size % 3 = 0", "SELECT o, 3, 'en', wa, 'en', wb, CASE p_size % 5 WHEN 0 THEN 'diminutive_of' ELSE 'variant_of' END, wa FROM e WHERE p_size % 5 <= 1",
          "SELECT o, 4, 'da', wb, 'en', wa, 'derived_from', wa FROM e WHERE given AND p_size % 4 = 0"]
_STEPS = _E + ", steps AS (" + " UNION ALL ".join(_RULES) + ")"
_PAGE = "'https://en.wiktionary.org/wiki/' || "


@query(f"SELECT child, parent, kind AS relation_type, {_PAGE} arg_min(wa, o) AS source_url FROM (SELECT *, cc || ':' || lower(cl) AS child, pc || ':' || lower(pl) AS parent FROM steps) WHERE child <> parent GROUP BY ALL", steps=_STEPS)
def lexical_edges(spark, sf):
    return lexical.edges(lexical.transform(_entries(spark, sf)))


@query("SELECT a AS word, count(*) AS n FROM e WHERE given GROUP BY a", steps=_E)
def given_name_filter(spark, sf):
    kept = _entries(spark, sf).where(lexical.is_given_name(F.col("entry")))
    return kept.groupBy(F.lower("entry.word").alias("word")).agg(F.count(F.lit(1)).alias("n"))


_GENDER = "CASE WHEN p_size % 7 = 0 THEN 'male' WHEN p_size % 5 = 0 THEN 'female' WHEN p_size % 5 = 2 THEN 'male' END"


@query(f"""SELECT key, w.lang_code AS lang_code, w.label AS label, language, gender, {_PAGE} w.label AS source_url FROM (
 SELECT lang_code || ':' || lower(label) AS key, arg_min({{'lang_code': lang_code, 'label': label}}, (o, place)) AS w, arg_min(language, (o, place)) FILTER (language IS NOT NULL) AS language, arg_min(gender, (o, place)) FILTER (gender IS NOT NULL) AS gender FROM (
  SELECT o, -1 AS place, 'en' AS lang_code, wa AS label, 'English' AS language, {_GENDER} AS gender FROM e WHERE given
  UNION ALL SELECT o, 2 * place, cc, cl, CASE cc WHEN 'da' THEN 'Danish' END, NULL FROM steps UNION ALL SELECT o, 2 * place + 1, pc, pl, NULL, NULL FROM steps) GROUP BY 1)""", steps=_STEPS)
def lexical_names(spark, sf):
    return lexical.names(lexical.transform(_entries(spark, sf)))


@query(f"SELECT p_partkey, {_GENDER} AS gender FROM part")
def gender_rules(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    size = F.col("p_size")
    gloss = F.when(size % 5 == 0, "the female given name").when(size % 5 == 2, "a male given name").otherwise("a thing")
    head = F.when(size % 7 == 0, F.array(F.struct(F.lit("given name").alias("name"), F.create_map(F.lit("2"), F.lit("Male, x")).alias("args"))))
    rows = part.select("p_partkey", F.to_json(F.struct(head.alias("head_templates"), F.array(F.struct(F.array(gloss).alias("glosses"))).alias("senses"))).alias("j"))
    return rows.select("p_partkey", F.from_json("j", lexical.schema.LEXICAL_ENTRY).alias("entry")).select("p_partkey", lexical.gender(F.col("entry")).alias("gender"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' END AS lang_code, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name END AS label FROM part""")
def term_segments(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    size = F.col("p_size")
    raw = F.when(size % 4 == 0, F.concat(F.lit(" FR: "), F.col("p_name"), F.lit("<tr:x> "))).when(size % 4 == 1, F.col("p_name")).when(size % 4 == 2, "Old Norse").otherwise("-")
    return part.select("p_partkey", lexical.segment(raw, F.lit("de")).alias("t")).select("p_partkey", F.col("t.lang_code").alias("lang_code"), F.col("t.label").alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN 'Q' || CAST(p_partkey AS VARCHAR) END AS qid, CASE WHEN p_size % 5 > 0 THEN p_partkey END AS n FROM part")
def qid_parse(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    uri = F.concat(F.lit("http://host/entity/"), F.when(F.col("p_size") % 5 > 0, "Q").otherwise("L"), F.col("p_partkey").cast("string"))
    q = tx.qid_of_uri(uri)
    return part.select("p_partkey", q.alias("qid"), tx.qid_number(q).alias("n"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")
def json_fields(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'unisex' ELSE lower(p_brand) END AS gender FROM part""")
def gender_norm(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    said = F.when(F.col("p_size") % 4 == 0, "Female given name").when(F.col("p_size") % 4 == 1, "MALE name").when(F.col("p_size") % 4 == 2, "Unisex").otherwise(F.col("p_brand"))
    return part.select("p_partkey", tx.normalized_gender(said).alias("gender"))


TRIPLES = """ t AS (SELECT 'Q' || CAST(p_partkey AS VARCHAR) AS qid, p_partkey AS n, CASE p_size % 4 WHEN 0 THEN 'Q202444' WHEN 1 THEN 'Q11879590' WHEN 2 THEN 'Q12308941' ELSE 'Q3409032' END AS type FROM part
 UNION ALL SELECT 'Q' || CAST(p_partkey AS VARCHAR), p_partkey, 'Q202444' FROM part WHERE p_size % 4 = 1), s AS (SELECT DISTINCT 'Q' || CAST(l_partkey AS VARCHAR) AS a, 'Q' || CAST(l_suppkey AS VARCHAR) AS b FROM lineitem)"""


def _triples(spark, sf) -> DataFrame:
    part, items = spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct()
    uri = lambda c: F.concat(F.lit("http://host/entity/Q"), F.col(c).cast("string"))
    size, null = F.col("p_size"), F.lit(None).cast("string")
    kind = F.when(size % 4 == 0, "Q202444").when(size % 4 == 1, "Q11879590").when(size % 4 == 2, "Q12308941").otherwise("Q3409032")
    row = lambda df, s, p, o, lang=null: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), lang.alias("lang"))
    return (row(part, uri("p_partkey"), "type", kind).union(row(part.where(size % 4 == 1), uri("p_partkey"), "type", F.lit("Q202444")))
            .union(row(part, uri("p_partkey"), "label", F.col("p_name"), F.lit("en"))).union(row(part.where(size % 3 == 0), uri("p_partkey"), "native", F.col("p_brand"), F.lit("fr")))
            .union(row(part.where(size % 2 == 0), uri("p_partkey"), "description", F.col("p_type"), F.lit("en"))).union(row(part.where(size % 2 == 1), uri("p_partkey"), "description", F.col("p_type"), F.lit("fr")))
            .union(row(part.where(size % 7 == 0), uri("p_partkey"), "language", F.col("p_type"))).union(row(part.where(size % 5 == 0), uri("p_partkey"), "gender", F.col("p_brand")))
            .union(row(items, uri("l_partkey"), "same_as", uri("l_suppkey"))))


@query("SELECT qid, n, type FROM t WHERE n >= 100 AND n < 300 AND type IN ('Q202444', 'Q11879590')", steps=TRIPLES)
def sparql_window(spark, sf):
    return knowledge.in_window(_triples(spark, sf), 100, 300, "Q202444", "Q11879590")


@query("SELECT DISTINCT qid, n FROM t WHERE type = 'Q202444' AND n > 50 ORDER BY n LIMIT 40", steps=TRIPLES)
def sparql_page(spark, sf):
    return knowledge.page_after(_triples(spark, sf), "Q202444", 50, 40)


@query("SELECT DISTINCT qid, n FROM t WHERE type = 'Q202444' ORDER BY n LIMIT 30 OFFSET 60", steps=TRIPLES)
def sparql_offset(spark, sf):
    return knowledge.page_at(_triples(spark, sf), "Q202444", 60, 30)


@query("SELECT DISTINCT qid, n FROM t WHERE type = 'Q202444' AND starts_with(qid, 'Q12') AND n > 12 ORDER BY n LIMIT 25", steps=TRIPLES)
def sparql_prefix(spark, sf):
    return knowledge.with_prefix(_triples(spark, sf), "Q202444", "12", after=12, size=25)


@query("SELECT 'Q' || CAST(max(p_partkey) AS VARCHAR) AS qid FROM part")
def max_qid(spark, sf):
    return knowledge.max_qid(knowledge.typed(_triples(spark, sf)))


@query("SELECT DISTINCT s.a, s.b FROM s JOIN t x ON x.qid = s.a JOIN t y ON y.qid = s.b AND y.type = x.type WHERE s.a < s.b", steps=TRIPLES)
def sparql_edges_typed(spark, sf):
    return knowledge.typed_edges(_triples(spark, sf))


@query("SELECT DISTINCT s.a, s.b FROM s JOIN t x ON x.qid = s.a JOIN t y ON y.qid = s.b AND y.type = x.type WHERE s.a < s.b AND x.n >= 100 AND x.n < 900", steps=TRIPLES)
def sparql_edges_window(spark, sf):
    return knowledge.typed_edges(_triples(spark, sf), 100, 900)


@query("SELECT DISTINCT s.a, s.b FROM s JOIN t y ON y.qid = s.b WHERE s.a < s.b AND s.a IN (SELECT qid FROM t WHERE n % 7 = 0) AND y.type = 'Q202444'", steps=TRIPLES)
def sparql_known(spark, sf):
    triples = _triples(spark, sf)
    return knowledge.known_edges(triples, knowledge.typed(triples).where("n % 7 = 0").select("qid").distinct(), "Q202444")


@query("SELECT count(*) AS n FROM t WHERE type IN ('Q202444', 'Q11879590')", steps=TRIPLES)
def sparql_count(spark, sf):
    return knowledge.count_typed(_triples(spark, sf), "Q202444", "Q11879590")


@query("SELECT DISTINCT t.qid, p_name AS label, CASE WHEN p_size % 3 = 0 THEN p_brand END AS native_label, CASE WHEN p_size % 2 = 0 THEN p_type END AS description, CASE WHEN p_size % 7 = 0 THEN p_type END AS language, CASE WHEN p_size % 5 = 0 THEN p_brand END AS gender FROM t JOIN part ON p_partkey = t.n WHERE type = 'Q202444'", steps=TRIPLES)
def sparql_optional(spark, sf):
    return knowledge.with_optionals(_triples(spark, sf), "Q202444")


_NUMBERS = " q AS (SELECT CAST(substr(wikidata_qid, 2) AS BIGINT) AS n FROM names WHERE wikidata_qid IS NOT NULL)"


@query("SELECT low, least(low + 50000, top) AS high, count(n) AS n FROM (SELECT unnest(range(1, top, 50000)) AS low, top FROM (SELECT max(n) + 1 AS top FROM q)) LEFT JOIN q ON n >= low AND n < low + 50000 GROUP BY low, top", "names", steps=_NUMBERS)
def qid_windows(spark, sf):
    """The windows up to the largest item of the catalogue, and how many items each has."""
    items = Catalog.part(spark, sf, "names").select(knowledge.qid_number(F.col("wikidata_qid")).alias("n")).where("n IS NOT NULL")
    top = items.agg(F.max("n")).first()[0] or 0
    held = items.groupBy((F.floor((F.col("n") - 1) / knowledge.WINDOW) * knowledge.WINDOW + 1).alias("low")).agg(F.count(F.lit(1)).alias("n"))
    return knowledge.windows(spark, 1, top + 1).join(held, "low", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT prefix, count(n) AS n FROM (SELECT CAST(i AS VARCHAR) AS prefix FROM range(10, 100) AS r(i)) LEFT JOIN q ON starts_with(CAST(n AS VARCHAR), prefix) GROUP BY prefix", "names", steps=_NUMBERS)
def uri_prefixes(spark, sf):
    """The prefixes that shard the source's items, and how many of the catalogue's items each has."""
    held = Catalog.part(spark, sf, "names").select(F.substring("wikidata_qid", 2, 2).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    return knowledge.prefixes(spark).join(held, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"))


KEYED = " AND ".join(f"e.{k} = b.{k}" for k in ("name_id", "source", "field"))


@query(f"SELECT coalesce(e.name_id, b.name_id) AS name_id, coalesce(e.source, b.source) AS source, coalesce(e.field, b.field) AS field, CASE WHEN b.name_id IS NULL THEN e.content ELSE b.content END AS content FROM enrichments e FULL JOIN batch b ON {KEYED}", "enrichments", "batch")
def upsert_overwrite(spark, sf):
    target = Catalog.part(spark, sf, "enrichments").withColumn("source_url", F.lit(None).cast("string"))
    return merge.upsert_enrichments(target, Catalog.part(spark, sf, "batch")).drop("source_url")


_NEW = "'h' || substr(sha256({0}), 1, 31)"


@query("SELECT coalesce(n.id, " + _NEW.format("b.wk") + """) AS id, coalesce(n.wk, b.wk) AS wiktionary_key, CASE WHEN b.wk IS NULL THEN n.label ELSE b.label END AS label, CASE WHEN b.wk IS NULL THEN n.language ELSE coalesce(b.language, n.language) END AS language
 FROM names n FULL JOIN (SELECT 'p:' || CAST(p_partkey AS VARCHAR) AS wk, upper(p_name) AS label, CASE WHEN p_size % 2 = 0 THEN p_brand END AS language FROM part) b ON b.wk = n.wk""", "names")
def upsert_coalesce(spark, sf):
    target = Catalog.part(spark, sf, "names").select("id", F.col("wk").alias("wiktionary_key"), "label", "language", "gender")
    part = spark.read.parquet(f"{sf}/part.parquet")
    rows = part.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("wiktionary_key"), F.upper("p_name").alias("label"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("language"), F.lit(None).cast("string").alias("gender"))
    return merge.upsert_names_by_key(target, rows).select("id", "wiktionary_key", "label", "language")


FRESH = " fresh AS (SELECT DISTINCT least('P' || CAST(l_partkey AS VARCHAR), 'S' || CAST(l_suppkey AS VARCHAR)) AS name_a, greatest('P' || CAST(l_partkey AS VARCHAR), 'S' || CAST(l_suppkey AS VARCHAR)) AS name_b FROM lineitem), old AS (SELECT * FROM relations WHERE confidence = 'sourced')"


@query("SELECT name_a, name_b, confidence FROM old UNION ALL SELECT f.name_a, f.name_b, 'community' FROM fresh f ANTI JOIN old r ON r.name_a = f.name_a AND r.name_b = f.name_b", "relations", steps=FRESH)
def insert_ignore(spark, sf):
    """The sourced relations, and all that the lines of orders say besides."""
    c = Catalog.from_tables(spark, sf)
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    edges = items.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name_a"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name_b"), F.lit("community").alias("confidence"))
    return merge.insert_relations(c.relations.where("confidence = 'sourced'"), edges, c.names.select("id", F.col("id").alias("key")), "key")


@query("SELECT coalesce(n.id, " + _NEW.format("b.qid") + """) AS id, coalesce(n.wikidata_qid, b.qid) AS wikidata_qid, CASE WHEN b.qid IS NULL THEN n.label ELSE b.label END AS label, CASE WHEN b.qid IS NULL THEN n.native_label ELSE b.native_label END AS native_label,
 CASE WHEN b.qid IS NULL THEN n.gender ELSE b.gender END AS gender FROM names n FULL JOIN (
 SELECT 'Q' || CAST(p_partkey AS VARCHAR) AS qid, upper(p_name) AS label, CASE WHEN p_size % 2 = 0 THEN p_brand END AS native_label, CASE WHEN p_size % 4 = 1 THEN 'male' END AS gender FROM part) b ON b.qid = n.wikidata_qid""", "names")
def upsert_by_qid(spark, sf):
    """Overwrites, nulls too, by item."""
    target = Catalog.part(spark, sf, "names").drop("wk")
    part = spark.read.parquet(f"{sf}/part.parquet")
    rows = part.select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("wikidata_qid"), F.upper("p_name").alias("label"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("native_label"), F.lit(None).cast("string").alias("language"), F.when(F.col("p_size") % 4 == 1, "male").alias("gender"))
    return merge.upsert_names_by_qid(target, rows).select("id", "wikidata_qid", "label", "native_label", "gender")


@query("SELECT child_id, parent_id, relation_type, 'manual' AS source FROM lineage WHERE relation_type = 'variant_of' UNION ALL SELECT child_id, parent_id, relation_type, 'wiktionary' FROM lineage WHERE relation_type = 'derived_from' AND child_id LIKE 'C%'", "lineage")
def replace_by_source(spark, sf):
    rows = Catalog.part(spark, sf, "lineage")
    target = rows.where("relation_type <> 'derived_from'").withColumn("source", F.when(F.col("relation_type") == "variant_of", "manual").otherwise("wiktionary"))
    fresh = rows.where("relation_type = 'derived_from' AND child_id LIKE 'C%'").withColumn("source", F.lit("wiktionary"))
    return merge.replace_by_source(target, fresh, "wiktionary", ["child_id", "parent_id", "relation_type"])


@query("SELECT name_a, name_b, confidence FROM relations WHERE NOT (name_a LIKE 'S1%' OR name_b LIKE 'S1%')", "relations")
def fk_cascade(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return merge.cascade(c.relations, c.names.where("id LIKE 'S1%'").select("id"), "name_a", "name_b")


@query("""SELECT 'check name_a < name_b' AS rule, count(*) AS n FROM relations WHERE confidence = 'sourced' HAVING count(*) > 0
 UNION ALL SELECT 'unique name_a, name_b', sum(k - 1) FROM (SELECT count(*) AS k FROM (SELECT name_a, name_b FROM relations WHERE confidence = 'community' UNION ALL SELECT name_a, name_b FROM relations WHERE confidence = 'community') GROUP BY name_a, name_b HAVING count(*) > 1)""", "relations")
def constraint_violations(spark, sf):
    r = Catalog.part(spark, sf, "relations")
    good = r.where("confidence = 'community'")
    turned = r.where("confidence = 'sourced'").select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), "confidence")
    return merge.violations(good.union(good).union(turned), "name_relations").withColumn("n", F.col("n").cast("bigint"))


@query("SELECT 'names' AS table_name, count(*) AS n FROM names UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'enrichments', count(*) FROM enrichments", "names", "relations", "enrichments")
def table_counts(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return merge.table_counts(c.names, c.relations, c.enrichments)


@query("""SELECT id, degree FROM (SELECT n.id, coalesce(d.degree, 0) AS degree FROM names n LEFT JOIN deg d ON d.id = n.id WHERE n.wikidata_qid IS NOT NULL ORDER BY degree DESC, n.id LIMIT 100) WHERE degree >= 1
 AND id NOT IN (SELECT name_id FROM enrichments WHERE source = 'behindthename') ORDER BY degree DESC, id LIMIT 50""", "names", "relations", "enrichments", steps=BOTH)
def enrichment_pending(spark, sf):
    c = Catalog.from_tables(spark, sf)
    return knowledge.pending(c.names, graph.name_degrees(c.names, both_ends(c)), c.enrichments, "behindthename", 50, 1)


def _jaro_sql(label: str) -> str:
    """near: Jaro-Winkler of every plain label with one; the letters that match are handed from step to step."""
    return f""" met AS (SELECT id, label, regexp_replace(lower(strip_accents(label)), '[^a-z0-9]', '', 'g') AS a, '{label}' AS b FROM names WHERE label IS NOT NULL),
 walk AS (SELECT id, label, a, b, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach, 0 AS i, CAST([] AS BIGINT[]) AS used, '' AS mine FROM met
  UNION ALL SELECT id, label, a, b, reach, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, CASE WHEN j IS NULL THEN mine ELSE mine || substr(a, i + 1, 1) END FROM (
   SELECT *, list_min(list_filter(range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1), lambda j: NOT list_contains(used, j) AND substr(b, CAST(j AS BIGINT), 1) = substr(a, i + 1, 1))) AS j FROM walk WHERE i < length(a))),
 jaro AS (SELECT id, label, a, b, CASE WHEN a = b THEN 1 WHEN m = 0 THEN 0 ELSE (m / length(a) + m / length(b) + (m - odd / 2) / m) / 3 END AS j FROM (
  SELECT *, len(used) AS m, len(list_filter(range(1, len(used) + 1), lambda k: substr(mine, CAST(k AS BIGINT), 1) <> substr(b, list_sort(used)[k], 1))) AS odd FROM walk WHERE i = length(a))),
 near AS (SELECT id, label, a, b, j + 0.1 * same * (1 - j) AS near FROM (SELECT *, coalesce(list_min(list_filter(range(1, least(4, length(a), length(b)) + 1), lambda k: substr(a, CAST(k AS BIGINT), 1) <> substr(b, CAST(k AS BIGINT), 1))) - 1, least(4, length(a), length(b))) AS same FROM jaro))"""


@query("""SELECT id, label, round(near, 6) AS score FROM near WHERE length(a) >= 4 AND abs(length(a) - length(b)) <= 2 AND near >= 0.72 ORDER BY round(near, 6) DESC, label COLLATE NOCASE, id LIMIT 6""", "names", steps=_jaro_sql("largeplaet"))
def lookalikes(spark, sf):
    return lookalike.rank(Catalog.part(spark, sf, "names"), "large plaet")


@query("SELECT id, round(near, 6) AS near FROM near", "names", steps=_jaro_sql("germany"))
def jaro_winkler(spark, sf):
    names = Catalog.part(spark, sf, "names")
    return names.select("id", F.round(jaro_winkler_of(plain_label(F.col("label")), F.lit("germany")), 6).alias("near"))


_SHOWN = "coalesce(nullif(nullif(trim(label), ''), '-'), nullif(nullif(trim(native_label), ''), '-'), '—') AS shown"
_CODED = "url_encode(replace(label, ' ', '_'))"
for _mark, _code in (("!", "%21"), ("''", "%27"), ("(", "%28"), (")", "%29"), ("*", "%2A")):
    _CODED = f"replace({_CODED}, '{_code}', '{_mark}')"


@query(f"SELECT n.id, {_SHOWN}, 'https://en.wiktionary.org/wiki/' || {_CODED} AS url FROM names n", "names")
def shown_names(spark, sf):
    n = Catalog.part(spark, sf, "names")
    return n.select("id", tx.shown_name(F.col("label"), F.col("native_label")).alias("shown"), tx.page_url(F.col("label")).alias("url"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a ranked fuzzy search."""
    return search.search(Catalog.from_tables(spark, sf_dir), TERM).select(SHOWN)
