"""The trees around many names at once: a frontier keyed by root, one join a level for all of them.

What a name's best children and parents are doesn't depend on the tree, so each level hands the relatives of the frontiers'
names, which are ranked once for all levels, to every tree that asks. Descendants grow first, then ancestors, within the viewport's budget (see
operators.growth).

Same results as operators.tree.lineage_tree without collapsing, for every root. Roots without a name make no tree; repeated
roots make one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.catalog import Catalog
from stemma.operators import growth
from stemma.operators.tree import SHOWN, Node, Tree, readable_kids
from stemma.operators.viewport import Capacity, Sides, capacity, sides
from stemma.sources.shared import materialize


def fanouts(room: Capacity, share: Sides) -> tuple[int, int, int]:
    """How many relatives a node takes: children of the root, parents of the root, and relatives of any other node."""
    readable = readable_kids(room)
    return min(16, max(share.root_fanout, 2 * readable)), share.ancestor_fanout, min(10, max(share.branch_fanout, readable + 2))


def plans(room: Capacity) -> dict[tuple[bool, bool], tuple[int, int, int, int, int]]:
    """By whether a root has parents and children: levels below, levels above, and the three fan-outs."""
    found = {}
    for up in (False, True):
        for down in (False, True):
            share = sides(room, room.depth_slots if up else 0, room.depth_slots if down else 0)
            found[up, down] = (share.descendant_depth, share.ancestor_depth, *fanouts(room, share))
    return found


def relatives(lineage: DataFrame, names: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(near, others) of all names with children, and of all with parents: those that have a name, best first. Rows of lineage
    may repeat, and count as often."""
    named = names.select("id").distinct().withColumn("named", F.lit(True))
    kids = lineage.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    kids = _small(materialize(kids, "tree_kids"))
    above = lineage.join(kids.select(F.col("id").alias("child_id")), "child_id", "left_semi").groupBy(F.col("child_id").alias("id")).agg(F.count(F.lit(1)).alias("above"))
    # Parents are rated by both counts, children by their children.
    parents = _small(materialize(kids.join(above, "id", "left").join(named, "id", "left"), "tree_parents"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    up = lineage.select(F.col("child_id").alias("near"), F.col("parent_id").alias("id")).join(parents, "id", "left")
    up = up.select("near", F.when(F.col("named"), F.col("id")).alias("other"), count("above"), count("kids"))
    down = lineage.select(F.col("parent_id").alias("near"), F.col("child_id").alias("id")).join(named, "id", "left").join(kids, "id", "left")
    down = down.select("near", F.when(F.col("named"), F.col("id")).alias("other"), count("kids"))
    best = [F.desc("kids"), F.asc("other")]
    # A name has no row without an id: null ends are no relatives.
    made = [growth.ranked(rows.where("near IS NOT NULL"), order, most) for rows, order in ((down, best), (up, [F.desc("above"), *best]))]
    return materialize(made[0], "tree_down"), materialize(made[1], "tree_up")


def _small(counts: DataFrame) -> DataFrame:
    """Counts by name, to be broadcast if they are few."""
    size = counts.agg(F.sum(F.octet_length("id") + 64)).first()[0] or 0
    return F.broadcast(counts) if size <= growth.FEW_BYTES else counts


def lineage_trees(catalog: Catalog, roots: DataFrame | None = None, width: float = 1200, height: float = 800) -> DataFrame:
    """(root, id, depth, parent, near, place) for the roots (id; None: all names with lineage): each tree's nodes in the order
    they were taken. near: the node that a node was reached from; parent: the next one towards older names that is shown."""
    room = capacity(width, height)
    most = room.max_nodes
    lineage, names = materialize(catalog.lineage.select("child_id", "parent_id"), "tree_edges"), catalog.names.select("id")
    down, up = relatives(lineage, names, 16 + most)
    table = plans(room)
    fields = ("levels_down", "levels_up", "root_down", "root_up", "branch")

    # A root's own relatives come with it: so many as it takes, and on the way up passes over.
    widest = [max(row[n] for row in table.values()) for n in range(len(fields))]
    met = names.select(F.col("id").alias("root")).distinct()
    met = met if roots is None else met.join(roots.select(F.col("id").alias("root")).distinct(), "root", "left_semi")
    met = met.join(down.select(F.col("near").alias("root"), F.slice("others", 1, widest[2] + 1).alias("below")), "root", "left")
    upward = F.slice("others", 1, widest[3] + most)
    met = met.join(up.select(F.col("near").alias("root"), upward.alias("above")), "root", "left")
    met = met.where("below IS NOT NULL OR above IS NOT NULL") if roots is None else met
    has = {c: F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("below", "above")}

    def planned(n: int) -> Column:
        cases = F.lit(table[False, False][n])
        for (u, d), row in table.items():
            cases = F.when((has["above"] == F.lit(u)) & (has["below"] == F.lit(d)), F.lit(row[n])).otherwise(cases)
        return cases

    need = F.col("root_up") + F.when(has["below"], F.lit(most)).otherwise(F.lit(1))
    state = growth.begun(met.withColumns({f: planned(n) for n, f in enumerate(fields)}), *fields, F.when(has["below"], F.col("below")).alias("below"), F.slice("above", F.lit(1), need).alias("above"))
    state = materialize(state, "tree_state")
    # Most names have no children: these begin with their parents.
    fell = growth.first(state.where("below IS NOT NULL"), F.col("below"), 1, F.col("root_down"), F.col("levels_down") > 0, most).drop("below")
    fell = _levels(materialize(fell, "tree_fell"), down, 1, "levels_down", widest[0], most)
    state = state.where("below IS NULL").drop("below").unionByName(fell)
    rose = growth.first(state, F.col("above"), -1, F.col("root_up"), F.col("levels_up") > 0, most).drop("above")
    state = _levels(materialize(rose, "tree_rose"), up, -1, "levels_up", widest[1], most)

    # Parents of what is above: the last node reached from each. Looked up behind the explode, so that it is done once a tree.
    later = F.reverse(F.filter("nodes", lambda x: x["depth"] < -1))
    rows = state.select("root", F.transform(later, lambda x: x["near"]).alias("from"), F.transform(later, lambda x: x["id"]).alias("to"), F.posexplode("nodes").alias("place", "node")).select("root", "place", "node.*", "from", "to")
    older = F.get("to", (F.array_position("from", F.col("id")) - 1).cast("int"))
    parent = F.when(F.col("depth") > 0, F.col("near")).when(F.col("depth") < 0, older)
    return rows.select("root", "id", "depth", parent.alias("parent"), "near", "place")


def _levels(state: DataFrame, best: DataFrame, sign: int, levels: str, deepest: int, most: int) -> DataFrame:
    """state after the levels beyond the first, as long as a frontier's names have relatives."""
    for hop in range(1, deepest):
        on = F.col(levels) > hop
        asked = growth.few(best, growth.wanted(state, on, most))
        if asked.isEmpty():
            break
        state = growth.grown(state, asked, sign * (hop + 1), F.col("branch"), on, most)
    return state


def shown_trees(catalog: Catalog, roots: list[str], width: float = 1200, height: float = 800) -> list[Tree]:
    """The trees of a few roots, in their order, as plain data: a few dozen nodes each."""
    given = catalog.names.sparkSession.createDataFrame([(r,) for r in roots], "id string")
    rows = lineage_trees(catalog, given, width, height).join(catalog.names.select("id", *SHOWN), "id").orderBy("root", "place").collect()
    made = []
    for root in roots:
        mine = [r for r in rows if r["root"] == root]
        if mine:
            nodes = [Node(r["id"], r["label"], r["language"], r["depth"], r["parent"], native=r["native_label"], gender=r["gender"], qid=r["wikidata_qid"]) for r in mine]
            made.append(Tree(root, nodes, [(r["id"], r["near"]) if r["depth"] < 0 else (r["near"], r["id"]) for r in mine if r["near"]]))
    return made
