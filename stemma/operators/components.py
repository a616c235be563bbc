"""Connected components by hooking to the smallest neighbour, pointer jumping and contraction.

First only each node's edges to its smallest and its largest neighbour are looked at, two a node: they join nearly all that is
connected, and of the other edges only those between what they left apart go on. Each round every node hooks to its smallest
neighbour, two pointer jumps shorten the chains, and the edge list is rewritten onto the roots and deduplicated, so the graph
shrinks geometrically. Only narrow (node, root) tables are kept; each round is cut into a written table, so a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.sources.shared import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the component's smallest node.

    Null endpoints and self-loops are dropped (a node seen only in a self-loop has no row). Direction and repeats
    don't matter. An empty edge list gives an empty table.
    """
    spark = edges.sparkSession
    given = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b")
    given = materialize(given, "cc_given")
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")
    few = given.select(ends).groupBy(F.col("e.v").alias("v")).agg(F.min("e.w").alias("low"), F.max("e.w").alias("high"))
    few = few.select(F.explode(F.array(F.struct(F.least("v", "low").alias("a"), F.greatest("v", "low").alias("b")), F.struct(F.least("v", "high").alias("a"), F.greatest("v", "high").alias("b")))).alias("e"))
    labels = _rounds(materialize(few.select("e.a", "e.b").distinct(), "cc_few"), None)
    if labels is None:
        return spark.createDataFrame([], edges.select(F.col(a).alias("node"), F.col(b).alias("root")).schema)
    rest = materialize(_moved(given, labels.select(F.col("node").alias("v"), F.col("root").alias("p"))), "cc_edges")
    return _rounds(rest, labels)


def _moved(edges: DataFrame, hook: DataFrame) -> DataFrame:
    """The edges between what nodes (v) hang on (p), without those inside of one."""
    left = hook.select(F.col("v").alias("a"), F.col("p").alias("pa"))
    right = hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
    moved = edges.join(left, "a").join(right, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
    return moved.where("a <> b").distinct()


def _rounds(rest: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """labels (node, root) after all edges of rest are contracted; None if there never was one."""
    while not rest.isEmpty():
        both = rest.select("a", "b").union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p"))
                           .select("v", F.least("v", "p").alias("p")), "cc_hook")
        for _ in range(2):
            up = hook.where("p < v").select(F.col("v").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        hook = materialize(hook, "cc_jump")
        rest = materialize(_moved(rest, hook), "cc_edges")
        step = hook.select(F.col("v").alias("root"), F.col("p").alias("next"))
        if labels is None:
            labels = hook.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc_labels")
    return labels
