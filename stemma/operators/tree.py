"""The derivation graph: parents and children, twins, featured roots, and the bounded tree around a name.

Whole-table steps are joins and aggregations. A tree has a few dozen nodes by its viewport's budget; each level's
candidates come from one join on the frontier, and the greedy choice among them, which depends on order, runs over those
rows on the driver. Ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.catalog import Catalog
from stemma.functions.text import displayable, trimmed
from stemma.functions.unicode import locale_key
from stemma.operators.graph import degrees, incident
from stemma.operators.viewport import Capacity, Sides, capacity, sides
from stemma.sources.shared import materialize

#: Fixed values.
FEATURED, FEATURED_FETCH = 5, 40
#: What a node shows of its name.
SHOWN = ("label", "language", "native_label", "gender", "wikidata_qid")


def children_of(lineage: DataFrame, ids: Iterable[str]) -> DataFrame:
    """(id, child); parallel relation types give a row each."""
    return lineage.where(F.col("parent_id").isin(*ids)).select(F.col("parent_id").alias("id"), F.col("child_id").alias("child"))


def parents_of(lineage: DataFrame, ids: Iterable[str]) -> DataFrame:
    return lineage.where(F.col("child_id").isin(*ids)).select(F.col("child_id").alias("id"), F.col("parent_id").alias("parent"))


def child_counts(ids: DataFrame, lineage: DataFrame) -> DataFrame:
    """(id, n) for every given id: edges to children, zero if there are none."""
    counted = lineage.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def parent_counts(ids: DataFrame, lineage: DataFrame) -> DataFrame:
    counted = lineage.groupBy(F.col("child_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def resolve_twins(catalog: Catalog, focus: DataFrame) -> DataFrame:
    """(id, twin) for the ids of focus: the id itself if it has lineage, else the best name of the same label that has,
    else the id. Best by lineage degree, by the focus's language (null before others), by key, by id."""
    n = catalog.names
    lineage = materialize(degrees(incident(catalog.lineage, "child_id", "parent_id")), "twin_degrees")  # asked twice
    wanted = focus.select("id").distinct().join(n.select("id", "label", "language"), "id").join(lineage, "id", "left")
    alone = wanted.where("degree IS NULL").select("id", F.lower("label").alias("low"), F.coalesce("language", F.lit("english")).alias("near"))
    # Of a label's names in one language only the best can win: one row a label and language meets the focus, however many share it.
    rank = F.struct((-F.col("degree")).alias("less"), F.col("wk").isNull().alias("keyless"), F.col("id").alias("twin"))
    others = n.join(lineage, "id").groupBy(F.lower("label").alias("low"), "language").agg(F.min(rank).alias("best"))
    # Whoever shares label and language looks for the same twin.
    asked = alone.select("low", "near").distinct()
    order = F.struct(F.col("best.less").alias("less"), F.when(F.col("same").isNull(), 0).when(F.col("same"), 1).otherwise(2).alias("far"), F.col("best.keyless").alias("keyless"), F.col("best.twin").alias("twin"))
    met = asked.join(others, "low").withColumn("same", F.ilike("language", F.col("near")))
    found = met.groupBy("low", "near").agg(F.min(order)["twin"].alias("twin"))
    best = alone.join(found, ["low", "near"]).select("id", "twin")
    return focus.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("twin", "id").alias("twin"))


def featured_roots(catalog: Catalog, count: int = FEATURED) -> DataFrame:
    """(id, label, kids): parents of most children with a label or else a native label fit to show; those without parents and
    with a short label if there are enough of them. The best count * 40 parents are taken before labels are looked at."""
    top = catalog.lineage.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("kids")).orderBy(F.desc("kids"), "id").limit(count * FEATURED_FETCH)
    # These few rows are fetched, so that lineage is grouped once, and then only read for them.
    found = top.collect()
    top = catalog.lineage.sparkSession.createDataFrame(found, top.schema)
    shown = F.coalesce(*(F.when(displayable(F.col(c)), trimmed(F.col(c))) for c in ("label", "native_label")))
    named = top.join(catalog.names.select("id", shown.alias("label")), "id").where("label IS NOT NULL")
    mine = catalog.lineage.where(F.col("child_id").isin([r["id"] for r in found]))
    rated = parent_counts(named, mine).withColumnRenamed("n", "parents").join(named, "id")
    good = (F.col("parents") == 0) & ~F.col("label").contains(",") & (F.size(F.split("label", r"\s+")) <= 2)
    pooled = rated.withColumn("good", good).withColumn("n_good", F.sum(F.col("good").cast("int")).over(Window.partitionBy(F.lit(1))))  # count * 40 rows at most
    return pooled.where((F.col("n_good") < count) | F.col("good")).orderBy(F.desc("kids"), "id").limit(count).select("id", "label", F.col("kids").cast("bigint").alias("kids"))


@dataclass(frozen=True)
class Node:
    id: str
    label: str
    language: str | None
    depth: int
    parent: str | None
    kind: str = "name"
    members: tuple[tuple[str, str, str | None], ...] = ()
    native: str | None = None
    gender: str | None = None
    qid: str | None = None


@dataclass(frozen=True)
class Tree:
    root: str
    nodes: list[Node] = field(default_factory=list)
    #: (source, target): from the parent to the child.
    edges: list[tuple[str, str]] = field(default_factory=list)

    def kids(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for a, b in self.edges:
            found.setdefault(a, []).append(b)
        return found


def _level(catalog: Catalog, frontier: list[str], up: bool, most: int) -> list:
    """Rows (id, other, label, language, native_label, gender, wikidata_qid) in rank order, one job: children by their number
    of children; parents by their number of parents, then of children. Of each of the frontier's ids the best most come to
    the driver: what a cap and the nodes already taken can pass over."""
    near = (parents_of if up else children_of)(catalog.lineage, frontier).toDF("id", "other")
    ids = near.select(F.col("other").alias("id")).distinct()
    kids = child_counts(ids, catalog.lineage).toDF("other", "kids")
    rated = near.distinct().join(kids, "other").join(catalog.names.select(F.col("id").alias("other"), *SHOWN), "other")
    order: list[Column] = [F.desc("kids"), F.asc("other")]
    if up:
        rated = rated.join(parent_counts(ids, catalog.lineage).toDF("other", "above"), "other")
        order = [F.desc("above"), *order]
    place = {i: n for n, i in enumerate(frontier)}
    rows = rated.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("place") <= most).collect()
    return sorted(rows, key=lambda r: (place[r["id"]], r["place"]))


def lineage_tree(catalog: Catalog, root: str, width: float = 1200, height: float = 800, resolve: bool = True, share: Sides | None = None, collapse: bool = True) -> Tree | None:
    """The tree around a name: descendants level by level, then ancestors, each node once, within the viewport's budget;
    crowded siblings and levels collapsed. None if the name is unknown."""
    spark = catalog.names.sparkSession
    if resolve:
        root = resolve_twins(catalog, spark.createDataFrame([(root,)], "id string")).first()["twin"]
    row = catalog.names.where(F.col("id") == root).select(*SHOWN).first()
    if row is None:
        return None
    room: Capacity = capacity(width, height)
    # A fan-out is 16 at most, and a tree has max_nodes nodes that may be passed over.
    enough = 16 + room.max_nodes
    first = {False: _level(catalog, [root], False, enough), True: _level(catalog, [root], True, enough)}
    share = share or sides(room, room.depth_slots if first[True] else 0, room.depth_slots if first[False] else 0)
    readable = readable_kids(room)
    at_root, on_branch = min(16, max(share.root_fanout, 2 * readable)), min(10, max(share.branch_fanout, readable + 2))
    made = lambda i, r, depth, parent: Node(i, r["label"], r["language"], depth, parent, native=r["native_label"], gender=r["gender"], qid=r["wikidata_qid"])
    nodes = {root: made(root, row, 0, None)}
    edges: list[tuple[str, str]] = []
    for up, hops in ((False, share.descendant_depth), (True, share.ancestor_depth)):
        frontier = [root]
        for hop in range(hops):
            if not frontier or len(nodes) >= room.max_nodes:
                break
            cap = (share.ancestor_fanout if up else at_root) if hop == 0 else on_branch
            added: dict[str, int] = {}
            reached = []
            for r in first[up] if hop == 0 else _level(catalog, frontier, up, enough):
                near, other = r["id"], r["other"]
                if other in nodes or added.get(near, 0) >= cap or len(nodes) >= room.max_nodes:
                    continue
                added[near] = added.get(near, 0) + 1
                nodes[other] = made(other, r, -(hop + 1) if up else hop + 1, None if up else near)
                edges.append((other, near) if up else (near, other))
                if up and nodes[near].depth < 0:
                    nodes[near] = replace(nodes[near], parent=other)
                reached.append(other)
            frontier = reached
    tree = Tree(root, list(nodes.values()), edges)
    return collapsed(tree, width, height) if collapse else tree


def collapsed(tree: Tree, width: float, height: float) -> Tree:
    """The tree with crowded siblings and levels in groups, as the viewport needs."""
    room = capacity(width, height)
    return collapse_depths(collapse_siblings(tree, readable_kids(room)), max(3, room.breadth_slots))


def readable_kids(room: Capacity) -> int:
    return min(max(3, room.breadth_slots // 2), 6)


def _subtree(tree: Tree, top: str, kids: dict[str, list[str]]) -> list[str]:
    """top and everything that hangs on it away from the focus."""
    depth = {n.id: n.depth for n in tree.nodes}
    found, stack = [], [top]
    while stack:
        i = stack.pop()
        if i in depth and i not in found:
            found.append(i)
            stack.extend(k for k in reversed(kids.get(i, ())) if abs(depth.get(k, 0)) > abs(depth[i]))
    return found


def _more(members: list[tuple[str, str, str | None]]) -> str:
    return f"+{len(members)} more"


def _names_in(tree: Tree, ids: list[str]) -> list[tuple[str, str, str | None]]:
    by_id = {n.id: n for n in tree.nodes}
    return [m for i in ids for m in (by_id[i].members if by_id[i].kind == "group" else ((i, by_id[i].label, by_id[i].language),))]


def collapse_siblings(tree: Tree, most: int) -> Tree:
    """Of more than most siblings, the most - 1 with most children stay; the others and all below go into one group."""
    if most < 2 or not tree.nodes:
        return tree
    by_id, kids = {n.id: n for n in tree.nodes}, tree.kids()
    gone: set[str] = set()
    groups: list[Node] = []
    edges: list[tuple[str, str]] = []
    for parent in sorted(kids, key=lambda i: abs(by_id[i].depth) if i in by_id else 0):
        mine = [k for k in kids[parent] if k in by_id]
        if parent in gone or parent not in by_id:
            continue
        order = sorted(mine, key=lambda k: (-len(kids.get(k, ())), locale_key(by_id[k].label), k)) if len(mine) > most else mine
        kept, rest = (order[: max(1, most - 1)], order[max(1, most - 1) :]) if len(mine) > most else (order, [])
        edges += [(parent, k) for k in kept]
        dropped = [i for k in rest for i in _subtree(tree, k, kids) if i not in gone]
        gone.update(dropped)
        if members := _names_in(tree, list(dict.fromkeys(dropped))):
            depth = by_id[kept[0]].depth
            group = Node(f"group:{parent}:{depth}:{len(members)}", _more(members), None, depth, parent, "group", tuple(members))
            groups.append(group)
            edges.append((parent, group.id))
    nodes = [n for n in tree.nodes if n.id not in gone] + groups
    here = {n.id for n in nodes}
    return Tree(tree.root, nodes, [e for e in edges if here.issuperset(e)])


def collapse_depths(tree: Tree, most: int, rounds: int = 200) -> Tree:
    """No level has more than most nodes: leaves go first into their parent's group at that level.

    What hangs on an absorbed ancestor away from the focus goes with it; the focus itself never goes.
    """
    if most < 2 or not tree.nodes:
        return tree
    for level in sorted({abs(n.depth) for n in tree.nodes} - {0}):
        nodes, kids = {n.id: n for n in tree.nodes}, tree.kids()
        groups = {n.parent: n.id for n in tree.nodes if n.kind == "group" and n.parent and abs(n.depth) == level}
        edges = list(tree.edges)
        for _ in range(rounds):
            here = [n for n in nodes.values() if abs(n.depth) == level]
            free = [n for n in here if n.kind != "group" and n.parent]
            if len(here) <= most or not free:
                break
            pick = min(free, key=lambda n: (len(kids.get(n.id, ())), n.parent not in groups, locale_key(n.label), n.id))
            dropped = [i for i in _subtree(Tree(tree.root, list(nodes.values()), edges), pick.id, kids) if i != tree.root]
            members = _names_in(Tree(tree.root, list(nodes.values()), edges), dropped)
            for i in dropped:
                del nodes[i]
            if pick.parent not in groups:
                groups[pick.parent] = f"group:{pick.parent}:{pick.depth}:d"
                nodes[groups[pick.parent]] = Node(groups[pick.parent], "", None, pick.depth, pick.parent, "group")
                edges.append((pick.parent, groups[pick.parent]))
            group = nodes[groups[pick.parent]]
            everyone = [*group.members, *members]
            nodes[group.id] = replace(group, members=tuple(everyone), label=_more(everyone))
        tree = Tree(tree.root, list(nodes.values()), [e for e in edges if e[0] in nodes and e[1] in nodes])
    return tree


def expand_group(tree: Tree, group_id: str) -> Tree:
    """The tree with a group's members in its place, those that aren't there yet."""
    group = next((n for n in tree.nodes if n.id == group_id and n.kind == "group"), None)
    if group is None or not group.members or not group.parent:
        return tree
    nodes = {n.id: n for n in tree.nodes if n.id != group_id}
    edges = [e for e in tree.edges if group_id not in e]
    for i, label, language in group.members:
        if i not in nodes:
            nodes[i] = Node(i, label, language, group.depth, group.parent)
            edges.append((group.parent, i))
    return Tree(tree.root, list(nodes.values()), edges)


def depth_counts(tree: Tree) -> dict[int, int]:
    """How many nodes lie at each distance from the focus, ancestors and descendants together."""
    found: dict[int, int] = {}
    for n in tree.nodes:
        found[abs(n.depth)] = found.get(abs(n.depth), 0) + 1
    return found


def tree_rows(spark, tree: Tree | None) -> tuple[DataFrame, DataFrame]:
    """A tree's nodes and edges as tables."""
    nodes = [] if tree is None else [(n.id, n.label, n.language, n.depth, n.parent, n.kind, [list(m) for m in n.members]) for n in tree.nodes]
    made = spark.createDataFrame(nodes, "id string, label string, language string, depth int, parent string, kind string, members array<array<string>>")
    return made, spark.createDataFrame([] if tree is None else tree.edges, "source string, target string")
