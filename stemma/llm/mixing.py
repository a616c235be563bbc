"""Mixing sources to target weights by entropy balancing.

Among all document rates r with 0 <= r <= 3 whose words add up to each source's target, the mix takes the one of least
relative entropy to rate one. Its convex dual has one multiplier for each source's token constraint, and the primal
optimum is exponentially tilted: r = min(3, exp(multiplier * size)). The multipliers are found by Newton steps inside a
shrinking bracket; every step is one aggregation over the table of (source, size, number of documents), which map-side
sums make small before anything is shuffled, so a source that holds a third of all rows is as cheap as any other. Sums of
rates are sums of decimals, so they don't depend on the order of rows. Not to converge is an error.

Rates become copies within the same table: going from the largest size to the smallest, each size gets the whole number
of copies that brings the words taken so far closest to the words due so far (what a large document's whole copies miss
is made up by the next sizes), so a source ends within about half of a small document of its target. One task has the
distinct sizes of a source, never its documents. A size's extra copies go to its documents with the least hashes of id and
text, up to a bound found by counting hashes in ranges, as many as the largest size has documents in each of them: two
steps of the root of their number. Documents compare their own hash with the bound and never meet. Of documents with the very
hash of the bound (rows that agree in id and text) exactly as many as are left over take one more, the first by their place
in the input. So a rerun gives the same copies, however the input is split.

Null and empty texts have size 0; of very long ones only the size is moved. Null sources are one source, the last in order. Documents of size 0 take no words and stay once.
Rows that agree in id and text are documents of their own. Columns of the input may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import WORD, workers_find_package
from stemma.sources.shared import materialize

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
STEPS, CLOSE = 100, 1e-7
#: Cells (source, size) that are broadcast at most.
BROADCAST_CELLS = 100_000
#: Sums of rates that come out alike in any order.
EXACT = "decimal(38,9)"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _placed(sources: DataFrame) -> DataFrame:
    """sources with place, their number from 0 in order of source, nulls last: ranges are sorted apart, then counted."""
    spread = sources.withColumn("last", F.col("source").isNull())
    ordered = spread.repartitionByRange("last", "source").sortWithinPartitions("last", "source").withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "mixing_ordered")
    seen, rows = 0, []
    for r in ordered.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():  # one row for each partition
        rows.append((r["range"], seen))
        seen += r["n"]
    first = sources.sparkSession.createDataFrame(rows, "range bigint, first bigint")
    return ordered.join(F.broadcast(first), "range").withColumn("place", F.col("first") + F.col("at")).drop("range", "first", "at", "last")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(key, source_size, n_docs, least_size, target) from sizes (key, source, size, n); one row for each source.

    What is left is shared by weight; sources whose share is above their limit are held at it and the rest is shared
    again, until none is above.
    """
    size = F.col("size")
    sources = sizes.groupBy("key", "source").agg(F.sum(size * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"),
                                                F.min(F.when(size > 0, size)).alias("least_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rated = _placed(sources).withColumn("weight", weight).withColumn("limit", (most * F.col("source_size")).cast("double"))
    rated = materialize(rated.withColumn("ratio", F.col("limit") / F.col("weight")), "mixing_rated")
    total = rated.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level != before:
        held = F.col("ratio") <= level if before >= 0 else F.lit(False)
        limits, whole = rated.agg(F.sum(F.when(held, F.col("limit")).cast(EXACT)), F.sum(F.when(~held, F.col("weight")).cast(EXACT))).first()
        if not whole:
            break
        before, level = level, (total - float(limits or 0)) / float(whole)
    target = F.when(F.col("ratio") <= level, F.col("limit")).otherwise(F.col("weight") * level)
    return rated.select("key", "source_size", "n_docs", "least_size", target.alias("target"))


def solve(sizes: DataFrame, sources: DataFrame, most: float = MOST, steps: int = STEPS) -> DataFrame:
    """sources with mean_size and multiplier (of size / mean_size); sizes: (key, size, n)."""
    mean = F.col("source_size") / F.col("n_docs")
    per_least = mean / F.col("least_size")
    share = F.col("target") / F.col("source_size")
    state = sources.where("source_size > 0").withColumn("mean_size", mean).withColumns({
        "lo": F.when(share < 1, F.log(F.greatest(share, F.lit(1e-12))) * per_least).otherwise(0.0),
        "hi": F.when(share > 1, math.log(most) * per_least).otherwise(0.0), "multiplier": F.lit(0.0)})
    state = materialize(state, "mixing_state")
    cells = sizes.where("size > 0").select("key", "size", "n")
    tilt = F.exp(F.col("multiplier") * F.col("size") / F.col("mean_size"))
    words = F.col("n") * F.col("size")
    fixed = ["key", "source_size", "n_docs", "least_size", "target", "mean_size"]
    for _ in range(steps):
        taken = (cells.join(state.select("key", "multiplier", "mean_size"), "key").groupBy("key")
                 .agg(F.sum((words * F.least(tilt, F.lit(float(most)))).cast(EXACT)).cast("double").alias("taken"),
                      F.sum(F.when(tilt < most, words * tilt * F.col("size") / F.col("mean_size")).otherwise(0.0).cast(EXACT)).cast("double").alias("slope")))
        over = F.col("taken") - F.col("target")
        off = F.abs(over) / F.greatest("target", F.lit(1.0))
        stepped = state.join(taken, "key").withColumns({"lo": F.when(over < 0, F.col("multiplier")).otherwise(F.col("lo")), "hi": F.when(over > 0, F.col("multiplier")).otherwise(F.col("hi")), "off": off})
        newton = F.col("multiplier") - over / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        moved = F.when(F.col("off") <= CLOSE, F.col("multiplier")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = materialize(stepped.select(*fixed, "lo", "hi", "off", moved.alias("multiplier")), "mixing_state")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            return state.select(*fixed, F.round("multiplier", 12).alias("multiplier"))
    raise ArithmeticError(f"the multipliers have not converged in {steps} steps")


def _rounded(cells: pd.DataFrame, most: int) -> pd.DataFrame:
    """One source's sizes with base (copies of each document) and extra (documents that get one more)."""
    cells = cells.sort_values("size", ascending=False, ignore_index=True)
    size, n = cells["size"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
    rate = np.minimum(most, np.exp(np.minimum(cells["multiplier"].to_numpy() * size / cells["mean_size"].to_numpy(), 50.0)))
    due = np.cumsum(n * size * rate)
    whole, taken = np.zeros(len(cells), np.int64), 0
    for i in range(len(cells)):
        whole[i] = min(max(round((due[i] - taken) / size[i]), 0), most * n[i])
        taken += int(size[i]) * int(whole[i])
    base = whole // n
    extra = whole - base * n
    return pd.DataFrame({"key": cells["key"], "size": size, "base": base, "extra": extra})


def _bounds(rows: DataFrame, cells: DataFrame, largest: int) -> DataFrame:
    """cells (key, size, base, extra) with bound, the extra-th least hash h of the cell's rows (key, size, h, place), and cut,
    the last place of the rows with that very hash that are among the extra ones (null: all are)."""
    bits = math.ceil(math.log2(max(1, largest)) / 2)
    part = F.shiftrightunsigned("u", 64 - bits) if bits else F.lit(0).cast("bigint")
    wanted = cells.where("extra > 0")
    narrow = rows.select("key", "size", "place", F.col("h").bitwiseXOR(F.lit(-(1 << 63))).alias("u")).withColumn("part", part)
    # u orders as unsigned what h orders as signed.
    counted = narrow.join(wanted, ["key", "size"]).groupBy("key", "size", "part", "extra").agg(F.count(F.lit(1)).alias("n"))
    seen = F.sum("n").over(Window.partitionBy("key", "size").orderBy("part"))
    met = counted.withColumn("seen", seen).where((F.col("seen") >= F.col("extra")) & (F.col("seen") - F.col("n") < F.col("extra")))
    met = materialize(met.select("key", "size", "part", (F.col("extra") - F.col("seen") + F.col("n")).alias("left")), "mixing_ranges")
    per = narrow.join(met, ["key", "size", "part"]).groupBy("key", "size", "left", F.col("u").bitwiseXOR(F.lit(-(1 << 63))).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    seen = F.sum("n").over(Window.partitionBy("key", "size").orderBy("h"))
    at = per.withColumn("seen", seen).where((F.col("seen") >= F.col("left")) & (F.col("seen") - F.col("n") < F.col("left")))
    found = materialize(at.select("key", "size", F.col("h").alias("bound"), (F.col("left") - F.col("seen") + F.col("n")).alias("take"), "n"), "mixing_bounds")
    # Rows equal in id and text share a hash: which of them is all the same, how many is not. Places count by split of the
    # input, so counts of splits say where the last one is, and only that split's rows are numbered.
    tied = rows.join(found.where("take < n"), ["key", "size"]).where("h = bound").select("key", "size", "take", "place", F.shiftright("place", 33).alias("split"))
    per = tied.groupBy("key", "size", "take", "split").agg(F.count(F.lit(1)).alias("n"))
    seen = F.sum("n").over(Window.partitionBy("key", "size").orderBy("split"))
    last = per.withColumn("seen", seen).where((F.col("seen") >= F.col("take")) & (F.col("seen") - F.col("n") < F.col("take"))).select("key", "size", "split", (F.col("take") - F.col("seen") + F.col("n")).alias("nth"))
    numbered = tied.join(last, ["key", "size", "split"]).withColumn("number", F.row_number().over(Window.partitionBy("key", "size").orderBy("place")))
    cuts = numbered.where("number = nth").select("key", "size", F.col("place").alias("cut"))
    return cells.join(found.select("key", "size", "bound"), ["key", "size"], "left").join(cuts, ["key", "size"], "left").select("key", "size", "base", "bound", "cut")


def copies(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, wide: bool = False) -> DataFrame:
    """(id, size, source_size, target, copies) for each row of docs; wide: also row, a struct of docs' columns."""
    workers_find_package(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(doc_id).alias("id"), key.alias("key"), size_of(text).alias("size"), F.xxhash64(doc_id, text).alias("h"), *[F.struct("*").alias("row")] * wide)
    narrow = docs.select(F.monotonically_increasing_id().alias("place"), key.alias("key"), F.col(source).alias("source"), size_of(text).alias("size"), F.xxhash64(doc_id, text).alias("h"))
    narrow = materialize(narrow, "mixing_rows")
    sizes = materialize(narrow.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing_sizes")
    sources = materialize(targets(sizes, weights, most), "mixing_targets")
    tilted = solve(sizes, sources, most)
    cells = sizes.where("size > 0").join(tilted, "key").select("key", "size", "n", "multiplier", "mean_size")
    dealt = materialize(cells.groupBy("key").applyInPandas(lambda x: _rounded(x, most), "key string, size bigint, base bigint, extra bigint"), "mixing_copies")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    bounds = _bounds(narrow, dealt, largest)
    every = sizes.select("key", "size").join(bounds, ["key", "size"], "left").join(sources.select("key", "source_size", "target"), "key")
    every = materialize(every.withColumn("base", F.coalesce("base", F.lit(1))), "mixing_cells")
    # Few cells go everywhere and rows stay where they are; otherwise rows meet their cell by an equi-join.
    met = rows.join(F.broadcast(every) if every.count() <= BROADCAST_CELLS else every, ["key", "size"])
    among = F.col("cut").isNull() | (F.col("place") <= F.col("cut"))
    more = F.coalesce((F.col("h") < F.col("bound")) | (F.col("h") == F.col("bound")) & among, F.lit(False))
    found = met.withColumn("copies", F.col("base") + more.cast("long"))
    return found.select("id", "size", "source_size", "target", "copies", *["row"] * wide)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: docs' rows, each as often as the mix takes it."""
    found = copies(docs, text, source, doc_id, wide=True).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
