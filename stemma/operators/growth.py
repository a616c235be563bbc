"""Ordered greedy growth around many starts at once: a row of state for each start, a join for each level.

A start's state is the nodes it has taken, in order, and its frontier. A level hands frontier names their ranked relatives
and folds over the frontier in order: each name takes its best relatives that aren't taken yet, up to a cap, until the start
has most nodes. Ranked relatives are cut to what a cap and the nodes already taken can pass over, so every row is bounded by
the budgets; starts are spread over tasks, and names that many frontiers share are joined, not collected. A start asks so many
of its frontier's names at a time as would fill it if each gave its cap, twice as many each time that it isn't full: most are
full after one. Starts that are full, or whose frontier has ended, aren't moved again. Of a name's relatives a start is sent so
many as it could pass over or take at that place. Where the names that are asked have few relatives in all, these are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.sources.shared import materialize

_GIVEN = "array<struct<place:int,near:string,others:array<string>>>"
#: Bytes of names and relatives that are broadcast at most.
FEW_BYTES = 64_000_000


def ranked(edges: DataFrame, order: list[Column], most: int) -> DataFrame:
    """(near, others): of the edges (near, other, and what order needs) the best most of each name, in order. Edges may repeat:
    order tells others apart, and gives the same place to the same one. A name whose others are all null has an empty list."""
    rank = F.dense_rank().over(Window.partitionBy("near").orderBy(F.col("other").isNull(), *order))
    cut = edges.withColumn("place", rank).where(F.col("place") <= most)
    best = F.array_sort(F.collect_set(F.when(F.col("other").isNotNull(), F.struct("place", "other"))))
    return cut.groupBy("near").agg(F.transform(best, lambda x: x["other"]).alias("others"))


def few(best: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of best for these names (near), to be broadcast if they are small."""
    mine = materialize(best.where(F.size("others") > 0).join(near, "near", "left_semi"), "growth_best")
    size = mine.agg(F.sum(F.octet_length("near") + F.octet_length(F.array_join("others", "")) + 32 * F.size("others") + 64)).first()[0] or 0
    return F.broadcast(mine) if size <= FEW_BYTES else mine


def begun(starts: DataFrame, *more: Column) -> DataFrame:
    """The state of starts (root): each has taken itself."""
    first = F.array(F.struct(F.col("root").alias("id"), F.lit(None).cast("string").alias("near"), F.lit(0).alias("depth")))
    return starts.select("root", *more, F.array("root").alias("taken"), first.alias("nodes"), F.array("root").alias("frontier"))


def wanted(state: DataFrame, on: Column, most: int) -> DataFrame:
    """(near): the frontiers' names, of starts that go on."""
    return materialize(state.where(on & (F.size("taken") < most)).select(F.explode("frontier").alias("near")).distinct(), "growth_frontier")


def grown(state: DataFrame, best: DataFrame, depth: int, cap: Column, on: Column, most: int) -> DataFrame:
    """state after a level at that depth, where on says that the start goes on; the frontier is what the level took."""
    none = F.expr("CAST(array() AS array<string>)")
    open_ = on & (F.size("taken") < most) & (F.size("frontier") > 0) & (cap > 0)
    found = state.where(~open_).withColumn("frontier", none)
    rest = state.where(open_).withColumns({"cap": cap, "fresh": none})
    times = 1
    while times == 1 or not rest.isEmpty():
        made = _asked(rest, best, depth, most, times)
        left = (F.size("taken") < most) & (F.size("frontier") > 0)
        found = found.unionByName(made.where(~left).withColumn("frontier", F.col("fresh")).drop("cap", "fresh"))
        rest, times = made.where(left), 2 * times
    return found


def first(state: DataFrame, others: Column, depth: int, cap: Column, on: Column, most: int) -> DataFrame:
    """state after a level whose frontier is the start itself and whose ranked relatives are at hand, where on says that the
    start goes on."""
    open_ = on & (F.size("taken") < most) & (cap > 0) & others.isNotNull()
    given = F.when(open_, F.array(F.struct(F.lit(0).alias("place"), F.col("root").alias("near"), others.alias("others"))))
    kept = [c for c in state.columns if c not in ("taken", "nodes", "frontier")]
    made = state.withColumn("made", _folded(given, F.expr("CAST(array() AS array<string>)"), cap, depth, most))
    return made.select(*kept, F.col("made.taken").alias("taken"), F.col("made.nodes").alias("nodes"), F.col("made.fresh").alias("frontier"))


def _folded(given: Column, fresh: Column, cap: Column, depth: int, most: int) -> Column:
    """(taken, fresh, nodes) after the names of given have given their best relatives in order."""
    start = F.struct(F.col("taken").alias("taken"), fresh.alias("fresh"), F.col("nodes").alias("nodes"))

    def take(s: Column, c: Column) -> Column:
        room = F.greatest(F.lit(0), F.least(cap, F.lit(most) - F.size(s["taken"])))
        picked = F.slice(F.filter(c["others"], lambda x: ~F.array_contains(s["taken"], x)), F.lit(1), room)
        made = F.transform(picked, lambda x: F.struct(x.alias("id"), c["near"].alias("near"), F.lit(depth).alias("depth")))
        return F.struct(F.concat(s["taken"], picked).alias("taken"), F.concat(s["fresh"], picked).alias("fresh"), F.concat(s["nodes"], made).alias("nodes"))

    return F.aggregate(F.coalesce(given, F.expr(f"CAST(array() AS {_GIVEN})")), start, take)


def _asked(state: DataFrame, best: DataFrame, depth: int, most: int, times: int) -> DataFrame:
    """state after the first names of the frontier have given theirs; fresh: what the level took so far."""
    kept = [c for c in state.columns if c not in ("taken", "fresh", "nodes", "frontier")]
    n = F.least(F.size("frontier"), (F.ceil((F.lit(most) - F.size("taken")) / F.col("cap")) * times).cast("int"))
    asked = state.select("root", "cap", F.size("taken").alias("had"), F.posexplode(F.slice("frontier", F.lit(1), n)).alias("place", "near"))
    # A place passes over what was taken before the level and by the places before, and takes its cap.
    need = F.col("cap") + F.least(F.col("had") + F.col("place") * F.col("cap"), F.lit(most))
    found = asked.join(best, "near").select("root", "place", "near", F.slice("others", F.lit(1), need.cast("int")).alias("others"))
    found = found.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "near", "others"))).alias("given"))
    made = state.join(found, "root", "left").withColumn("made", _folded(F.col("given"), F.col("fresh"), F.col("cap"), depth, most))
    later = F.slice("frontier", n + 1, F.greatest(F.size("frontier") - n, F.lit(0)))
    return materialize(made.select(*kept, *(F.col("made")[c].alias(c) for c in ("taken", "fresh", "nodes")), later.alias("frontier")), "growth_state")


def members(state: DataFrame) -> DataFrame:
    """(root, place, id, near, depth) of all nodes."""
    return state.select("root", F.posexplode("nodes").alias("place", "node")).select("root", "place", "node.*")
