"""Relations that don't depend on how they were loaded: direct ones are kept apart, the closure follows from them.

A store keeps the direct relations, each node's component, each component's members and its size. New relations touch the
components of their ends only: these are joined (the components of a small graph, whose nodes are the old components), the
largest of those that become one keeps its name, and only the members of the others are named anew, so a node is renamed a
logarithmic number of times. Of the closure

* a component of at most cap members gains the pairs between members that were apart before;
* a component that passes the cap gains its new direct relations, and loses the pairs of its small former components that
  no direct relation made.

So any parts in any order leave what all relations together would: all pairs in components of at most cap, the direct ones
in larger ones. The same holds for relations that were added without closure and are closed by a later load.

Relations that were saved as a whole, without a record of direct ones, count as direct, and are closed with the first load.
Known relations stay as they are (insert or ignore). Null ends and loops are dropped, repeats and directions don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators.components import connected_components
from stemma.operators.graph import CLOSURE_CAP
from stemma.sources.shared import materialize
from stemma.store import Snapshot, Store, gone

PAIR = ["name_a", "name_b"]
#: What the source gives relations that it finds.
FOUND = {"relation_type": "cognate", "confidence": "community"}

#: Tables whose changes have each pair once: new ones are distinct and not known, those of the closure are neither new nor known,
#: and those that go are in components that gain none, and neither direct nor new.
ONCE = ("direct_relations", "open_relations", "name_relations")


def canonical(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.least(a, b).alias("name_a"), F.greatest(a, b).alias("name_b")).where("name_a < name_b").distinct()


def _found(pairs: DataFrame) -> DataFrame:
    return pairs.select(*PAIR, *(F.lit(v).alias(c) for c, v in FOUND.items()))


def _pairs(left: DataFrame, right: DataFrame, apart: bool) -> DataFrame:
    """Pairs of members (group, label, id) of one group: of different labels, or of one."""
    a, b = left.select("group", F.col("label").alias("la"), F.col("id").alias("name_a")), right.select("group", F.col("label").alias("lb"), F.col("id").alias("name_b"))
    return a.join(b, "group").where("name_a < name_b AND " + ("la <> lb" if apart else "la = lb")).select(PAIR)


def merge_relations(store: Store, edges: DataFrame, a: str = "name_a", b: str = "name_b", cap: int = CLOSURE_CAP, close: bool = True) -> Snapshot:
    """Adds direct relations between ids and brings the closure up to date; the new version."""
    fresh = materialize(canonical(edges, a, b), "relations_found")
    return store.transact(lambda base: changes(base, fresh, cap, close), once=ONCE)


def changes(base: Snapshot, fresh: DataFrame, cap: int, close: bool) -> dict[str, DataFrame]:
    known = base.has("direct_relations")
    direct = base.around("direct_relations", fresh) if known else materialize(canonical(base.table("name_relations"), *PAIR), "relations_direct")
    new = materialize(fresh.join(direct, PAIR, "left_anti"), "relations_new")
    out = {"direct_relations": new if known else direct.union(new)}
    added = _found(new.join(base.around("name_relations", new), PAIR, "left_anti"))
    if not close:
        return out | {"open_relations": new if known else direct.union(new), "name_relations": added}
    waiting = base.table("open_relations") if known else direct
    if known:
        out["open_relations"] = gone(waiting)
    todo = new.union(waiting.select(PAIR))  # those that wait are direct, so not new
    if todo.isEmpty():
        return {}

    # The components of the ends, and which of them become one.
    ends = materialize(todo.select(F.col("name_a").alias("id")).union(todo.select(F.col("name_b").alias("id"))).distinct(), "relations_ends")
    of = materialize(ends.join(base.rows("component_of", ends), "id", "left").select("id", F.coalesce("component", "id").alias("label"), F.col("component").isNull().alias("single")), "relations_labels")
    # A component is named by one of its nodes, so the relations and each end's link to that node say which become one.
    links = of.where("id <> label").select(F.col("id").alias("name_a"), F.col("label").alias("name_b"))
    roots = connected_components(todo.union(links), *PAIR)
    labels = of.groupBy("label").agg(F.max("single").alias("single"))
    sizes = base.rows("component_sizes", labels.where("NOT single").select(F.col("label").alias("component")))
    groups = labels.join(roots.withColumnRenamed("node", "label"), "label", "left").join(sizes.withColumnRenamed("component", "label"), "label", "left")
    groups = materialize(groups.select("label", "single", F.coalesce("root", "label").alias("group"), F.coalesce("size", F.lit(1)).alias("was")), "relations_groups")
    whole = groups.groupBy("group").agg(F.sum("was").alias("size"), F.min(F.struct(-F.col("was"), "label")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("single").alias("any_single"))
    whole = whole.select("group", "size", F.col("first.label").alias("stays"), (F.col("n") > 1).alias("joined"))
    groups = materialize(groups.join(whole, "group"), "relations_joined")

    # Members that are named anew, or paired: never those of a component that stays and is beyond the cap.
    moving = F.col("joined") & (F.col("label") != F.col("stays"))
    asked = groups.where((moving | (F.col("joined") & (F.col("was") <= cap))) & ~F.col("single"))
    held = base.rows("component_members", asked.select(F.col("label").alias("component"))).withColumnRenamed("component", "label")
    members = materialize(held.union(groups.where("single").select("label", F.col("label").alias("id"))).join(groups.where("joined"), "label").select("group", "label", "id", "single", "was", "size", "stays"), "relations_members")

    named = members.where("single OR label <> stays").select("id", F.col("stays").alias("component"))
    left = gone(members.where("NOT single AND label <> stays").select(F.col("label").alias("component"), "id"))
    out["component_of"] = named
    out["component_members"] = named.select("component", "id").withColumn("__gone", F.lit(False)).unionByName(left)
    sized = groups.where("joined").select(F.col("stays").alias("component"), "size").distinct()
    out["component_sizes"] = sized.withColumn("__gone", F.lit(False)).unionByName(gone(groups.where("joined AND NOT single AND label <> stays").select(F.col("label").alias("component"), F.col("was").alias("size"))))

    # The closure: what comes, and what goes because a component has passed the cap.
    small = members.where(F.col("size") <= cap)
    pairs = materialize(_pairs(small, small, True), "relations_pairs")
    more = pairs.join(base.rows("name_relations", pairs), PAIR, "left_anti")
    more = _found(more.join(new.join(pairs, PAIR, "left_semi"), PAIR, "left_anti"))
    burst = members.where((F.col("size") > cap) & (F.col("was") <= cap) & (F.col("was") > 1))
    closed = materialize(_pairs(burst, burst, False), "relations_burst")
    kept = base.rows("direct_relations", closed) if known else direct
    over = gone(_found(closed.join(kept.union(new), PAIR, "left_anti")))
    out["name_relations"] = added.unionByName(more).withColumn("__gone", F.lit(False)).unionByName(over)
    return out


def skipped(store: Store, cap: int = CLOSURE_CAP) -> int:
    """How many components are beyond the cap."""
    return store.snapshot().table("component_sizes").where(F.col("size") > cap).count()


def components(base: Snapshot) -> DataFrame:
    """(id, component, size) of every node, the component named by its smallest node."""
    of = base.table("component_of")
    first = of.groupBy("component").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    return of.join(first, "component").select("id", F.col("first").alias("component"), "size")
