"""The undirected relation graph: incidence, degrees, bounded neighbourhoods, closure and islands.

Full-graph steps (degrees, components, closure) are joins and aggregations. Neighbourhoods and islands are bounded by their
budgets and grow around any number of starts at once (operators.growth); one neighbourhood alone is cheaper by a join on its
frontier, with the greedy choice over the few rows that come back.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.operators import growth
from stemma.operators.components import connected_components
from stemma.sources.shared import materialize

#: Budgets, as the source has them.
HOP1, HOP2_EACH, FOCUS, HOP2_TOTAL = 28, 6, 30, 50
SUBGRAPH, SUBGRAPH_HOP1, SUBGRAPH_HOP2 = 60, 15, 5
CLOSURE_CAP, ISLANDS, ISLAND = 80, 20, 7


def incident(edges: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    """(id, other, more): every edge from both of its ends."""
    return edges.select(F.col(a).alias("id"), F.col(b).alias("other"), *more).union(edges.select(F.col(b).alias("id"), F.col(a).alias("other"), *more))


def degrees(both: DataFrame) -> DataFrame:
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def name_degrees(names: DataFrame, both: DataFrame) -> DataFrame:
    """(id, degree) of every name, zero without an edge."""
    return names.select("id").join(degrees(both), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def most_connected(names: DataFrame, both: DataFrame) -> DataFrame:
    return name_degrees(names, both).orderBy(F.desc("degree"), "id").limit(1)


def neighbors(names: DataFrame, both: DataFrame, name_id: str) -> DataFrame:
    """Distinct neighbours that have a row, with their degree and the edge's confidence."""
    mine = both.where(F.col("id") == name_id).groupBy(F.col("other").alias("id")).agg(F.min("confidence").alias("confidence"))
    return names.select("id", "label").join(mine, "id").join(degrees(both.join(mine.select("id"), "id", "left_semi")), "id")


def expand(names: DataFrame, both: DataFrame, name_id: str, exclude: Iterable[str] = (), limit: int = HOP1) -> DataFrame:
    """One hop: the neighbours of highest degree that aren't excluded."""
    return neighbors(names, both, name_id).where(~F.col("id").isin(name_id, *exclude)).orderBy(F.desc("degree"), "id").limit(limit)


def neighborhood(names: DataFrame, both: DataFrame, root: str, most: int = FOCUS, hop1: int = HOP1, hop2: int = HOP2_EACH, depth: int = 2) -> DataFrame:
    """(id, depth, parent): the root, its best neighbours, and for each of them in rank order its best ones not yet taken,
    until most nodes are taken. Empty if the root has no row.

    One job: the first hop has at most hop1 rows, so candidates of the second are bounded by what their ranks can reach.
    """
    spark = names.sparkSession
    schema = "id string, depth int, parent string"
    if most < 1 or name_is_missing(names, root):
        return spark.createDataFrame([], schema)
    first = expand(names, both, root, limit=max(0, min(hop1, most - 1))).select("id", "degree")
    taken = [(root, 0, None), *((r["id"], 1, root) for r in first.collect())]
    if depth > 1 and len(taken) < most and len(taken) > 1:
        parents = [i for i, d, _ in taken if d == 1]
        # A parent loses at most most nodes to others: so many of its best candidates suffice.
        out = both.where(F.col("id").isin(parents)).select(F.col("id").alias("parent"), F.col("other").alias("id")).distinct().join(names.select("id"), "id", "left_semi")
        out = out.join(degrees(both.join(out.select("id").distinct(), "id", "left_semi")), "id")
        place = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("degree"), "id"))
        best = out.withColumn("place", place).where(F.col("place") <= hop2 + most).orderBy("parent", "place").collect()
        seen = {i for i, *_ in taken}
        for parent in parents:
            added = 0
            for r in best:
                if r["parent"] == parent and r["id"] not in seen and added < hop2 and len(taken) < most:
                    seen.add(r["id"])
                    taken.append((r["id"], 2, parent))
                    added += 1
    return spark.createDataFrame(taken, schema)


def name_is_missing(names: DataFrame, name_id: str) -> bool:
    return names.where(F.col("id") == name_id).isEmpty()


def subgraph(names: DataFrame, both: DataFrame, root: str, depth: int = 2) -> DataFrame:
    return neighborhood(names, both, root, SUBGRAPH, SUBGRAPH_HOP1, SUBGRAPH_HOP2, depth)


def expand_two(names: DataFrame, both: DataFrame, root: str) -> DataFrame:
    """Two hops without the focus budget: up to HOP1 and, of each, HOP2_EACH, up to HOP2_TOTAL further nodes."""
    return neighborhood(names, both, root, HOP2_TOTAL + 1, HOP1, HOP2_EACH)


def components(edges: DataFrame, a: str = "name_a", b: str = "name_b") -> DataFrame:
    """(id, component, size)"""
    found = connected_components(edges, a, b)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "root").select(F.col("node").alias("id"), F.col("root").alias("component"), "size")


def closure(edges: DataFrame, a: str = "name_a", b: str = "name_b", cap: int = CLOSURE_CAP) -> DataFrame:
    """(a, b) with a < b: all pairs in components of at most cap nodes, the direct edges in larger ones.

    The cap comes before the pair join, so a component makes at most cap * (cap - 1) / 2 rows.
    """
    nodes = components(edges, a, b)
    small = nodes.where(F.col("size") <= cap)
    left, right = small.select("component", F.col("id").alias("a")), small.select("component", F.col("id").alias("b"))
    pairs = left.join(right, "component").where("a < b").select("a", "b")
    direct = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b")
    large = nodes.where(F.col("size") > cap).select(F.col("id").alias("a"))
    return pairs.union(direct.join(large, "a", "left_semi")).distinct()


def closure_skipped(edges: DataFrame, a: str = "name_a", b: str = "name_b", cap: int = CLOSURE_CAP) -> DataFrame:
    """One row: how many components the cap left out."""
    return components(edges, a, b).where(F.col("size") > cap).agg(F.count_distinct("component").alias("skipped"))


def hubs(both: DataFrame, parts: DataFrame, limit: int = ISLANDS) -> DataFrame:
    """(component, hub_id, degree) of the components with the highest degrees; a hub is its component's best node."""
    best = F.struct(-F.col("degree"), F.col("id"))
    per = degrees(both).join(parts, "id").groupBy("component").agg(F.min(best).alias("best"))
    return per.select("component", F.col("best.id").alias("hub_id"), (-F.col("best.col1")).alias("degree")).orderBy(F.desc("degree"), "hub_id").limit(limit)


def pick_island(links: dict[str, list[str]], degree: dict[str, int], start: str, most: int = ISLAND) -> list[str]:
    """Breadth first from start, a node's neighbours by degree, until most nodes are taken."""
    rank = lambda ids: sorted(ids, key=lambda i: (-degree.get(i, 0), i))
    taken, queue = {start: None}, rank(links.get(start, ()))
    for node in queue:  # grows while it is read
        if len(taken) >= most:
            break
        if node not in taken:
            taken[node] = None
            queue.extend(n for n in rank(links.get(node, ())) if n not in taken)
    return list(taken)


def island_depths(links: dict[str, list[str]], members: list[str], hub: str) -> dict[str, int]:
    """Hops from the hub inside the members, two at most and for what isn't reached."""
    depth, queue = {hub: 0}, [hub]
    for node in queue:
        for n in links.get(node, ()):
            if n in members and n not in depth:
                depth[n] = depth[node] + 1
                queue.append(n)
    return {m: min(depth.get(m, 2), 2) for m in members}


def _best(both: DataFrame, degree: DataFrame, most: int, asked: DataFrame | None = None) -> DataFrame:
    """(near, others): each name's best neighbours by degree, of all names or those asked (near). degree: of every name."""
    near = both.select(F.col("id").alias("near"), F.col("other"))
    near = (near.join(asked, "near", "left_semi") if asked is not None else near).distinct()
    return growth.ranked(near.join(degree.withColumnRenamed("id", "other"), "other"), [F.desc("degree"), F.asc("other")], most)


def neighborhoods(names: DataFrame, both: DataFrame, roots: DataFrame, most: int = FOCUS, hop1: int = HOP1, hop2: int = HOP2_EACH) -> DataFrame:
    """(root, id, depth, parent): the neighborhood of every root (id) at once, two joins in all. Roots without a name have
    none; nodes have one."""
    known = names.select("id").distinct()
    both = materialize(both.select("id", "other"), "graph_edges")
    degree = materialize(degrees(both), "graph_degrees")
    named = both.join(known.withColumnRenamed("id", "other"), "other", "left_semi")
    # The first hop takes so many of a name's best; the second passes over what was taken, fewer than most.
    best = materialize(_best(named, degree, max(hop1, hop2 + most)), "graph_best")
    state = growth.begun(roots.select("id").distinct().join(known, "id", "left_semi").select(F.col("id").alias("root")))
    for depth, cap in ((1, hop1), (2, hop2)):
        state = growth.grown(state, best, depth, F.lit(cap), F.lit(True), most)
    return growth.members(state).select("root", "id", "depth", F.col("near").alias("parent"))


def islands(names: DataFrame, both: DataFrame, starts: DataFrame, most: int = ISLAND, few: bool = False) -> DataFrame:
    """(hub_id, id, depth) of the island around every start (id) at once: breadth first, a node's neighbours by degree, until
    most nodes are taken. depth: hops from the start, two at most. few: there are a few starts, so that each level ranks
    the neighbours of its own names only; else those of all names are ranked once."""
    both = materialize(both.select("id", "other"), "graph_edges")
    degree = materialize(degrees(both), "graph_degrees")
    # Of a node's neighbours most are taken at most, and fewer than most are passed over.
    best = None if few else materialize(_best(both, degree, 2 * most), "graph_best")
    state = growth.begun(starts.select(F.col("id").alias("root")).distinct())
    for depth in range(1, most):
        asked = growth.wanted(state, F.lit(True), most)
        if asked.isEmpty():
            break
        state = growth.grown(state, _best(both, degree, 2 * most, asked) if few else best, depth, F.lit(most), F.lit(True), most)
    found = growth.members(state).select(F.col("root").alias("hub_id"), "id", F.least("depth", F.lit(2)).alias("depth"))
    return found.join(names.select("id"), "id", "left_semi").select("hub_id", "id", "depth")


def grow_islands(names: DataFrame, both: DataFrame, starts: list[str], most: int = ISLAND) -> DataFrame:
    return islands(names, both, both.sparkSession.createDataFrame([(s,) for s in starts], "id string"), most, few=True)


def constellation(names: DataFrame, both: DataFrame, parts: DataFrame, limit: int = ISLANDS, most: int = ISLAND) -> DataFrame:
    """(hub_id, id, depth): the islands around the hubs of the best components."""
    return islands(names, both, hubs(both, parts, limit).select(F.col("hub_id").alias("id")), most, few=True)


def island_of(names: DataFrame, both: DataFrame, parts: DataFrame, name_id: str, most: int = ISLAND) -> DataFrame:
    """The island around the hub of the name's component, or around the name if that leaves it out; alone if it has no
    relation; empty if it is unknown. The hub is reported where it is a member, else the name."""
    spark = names.sparkSession
    schema = "hub_id string, id string, depth int"
    if name_is_missing(names, name_id):
        return spark.createDataFrame([], schema)
    mine = parts.where(F.col("id") == name_id).select("component")
    best = degrees(both).join(parts.join(mine, "component", "left_semi"), "id").orderBy(F.desc("degree"), "id").limit(1).collect()
    if not best:
        return spark.createDataFrame([(name_id, name_id, 0)], schema)
    hub = best[0]["id"]
    found = grow_islands(names, both, [hub], most)
    if found.where(F.col("id") == name_id).isEmpty():
        found = grow_islands(names, both, [name_id], most)
        if not found.where(F.col("id") == hub).isEmpty():
            found = found.withColumn("hub_id", F.lit(hub))
    return found


def induced_edges(relations: DataFrame, members: DataFrame, a: str = "name_a", b: str = "name_b", *more: str) -> DataFrame:
    """(hub_id, a, b, more): the relations with both ends among an island's members."""
    left = members.select("hub_id", F.col("id").alias("a"))
    right = members.select(F.col("hub_id").alias("same"), F.col("id").alias("b"))
    return relations.select(F.col(a).alias("a"), F.col(b).alias("b"), *more).join(left, "a").join(right, "b").where("hub_id = same").select("hub_id", "a", "b", *more).distinct()
