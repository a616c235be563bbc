"""How the filters of documents interact: what each removes, at each step of every order in which they may be applied.

Five filters fail a document: A few words, B few distinct words, C many capitals, D symbols, E a text that a smaller id has.
A document's failures are a mask of five bits. Everything that is asked of an order of filters follows from how many
documents of a part have each mask: a filter removes those that fail it and none before it. So counters by part and mask,
which add up over tasks, are all that the steps are made from.

E is found by sorting: rows are put in ranges of (fingerprint, id, place), so that a group of copies of any size spreads over
as many tasks as it fills, and sorted by (fingerprint, full text, id) within them. A row that has its predecessor's text
belongs to the same run; a run's first id is its smallest. Runs of a range's first and last fingerprint may go on in the
next range: these, one or two a range, are handed on with their texts, and of runs with one text the smallest id counts for
all. A row fails E if its id is not the run's first.

Null and empty texts are equal texts without words. Null ids are larger than all others; rows equal in id and text are
no copies of a smaller id. Null parts count as the empty string; the part's type doesn't matter. A document is good or toxic
if any label row of its id says so; label rows without documents don't count. Very long texts are single cells of one
task. Without documents there are no parts and so no rows; without labels nothing is lost. Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stemma.llm.common import pieces, workers_find_package
from stemma.sources.shared import materialize

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_CAPITALS, _CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_SYMBOL = re.compile(rb"[#$%&*|]")
DUPLICATE = 1 << FILTERS.index("E")


def failures(raw: bytes) -> int:
    """The mask of A to D for a whole text in UTF-8."""
    words = raw.split()
    capitals, points = len(raw) - len(raw.translate(None, _CAPITALS)), len(raw.translate(None, _CONTINUED))
    return (len(words) < LEAST_WORDS) + 2 * (100 * len(set(words)) < LEAST_DISTINCT * len(words)) + 4 * (100 * capitals > MOST_CAPITALS * points) + 8 * bool(_SYMBOL.search(raw))


def runs(rows: DataFrame, fingerprint=F.xxhash64) -> DataFrame:
    """(id, part, mask, task, run, first, text) for rows (id, part, text): the mask of A to D and the run's first id within
    its task. Rows with a text are the runs that may go on in another task, no documents."""
    workers_find_package(rows.sparkSession)
    keyed = rows.select("id", "part", "text", fingerprint(F.col("text")).alias("print"), F.monotonically_increasing_id().alias("place"))
    last = F.col("id").asc_nulls_last()
    ranged = keyed.repartitionByRange("print", last, "place").drop("place").sortWithinPartitions("print", "text", last)
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("part string, mask int, task int, run bigint"), T.StructField("first", id_type), *T.StructType.fromDDL("print bigint, text binary")])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, run, first, before, mask = TaskContext.get().partitionId(), -1, None, None, 0
        start, edges = None, []  # the task's first fingerprint, and the runs of the fingerprint that is read

        def out(made: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made), kinds)], names=schema.names)

        for batch in (part for whole in batches for part in pieces(whole)):
            made = []
            for i, part, raw, at in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("print").to_pylist()):
                raw = raw.as_py()
                if before is None or at != before[0] or raw != before[1]:
                    if before is not None and at != before[0]:
                        made += edges if before[0] == start else []
                        edges = []
                    start = at if before is None else start
                    run, first, before, mask = run + 1, i, (at, raw), failures(raw)
                    edges.append((None, None, None, task, run, first, at, raw))
                made.append((i, part, mask, task, run, first, None, None))
            if made:
                yield out(made)
        if edges:
            yield out(edges)

    return ranged.select("id", "part", "text", "print").mapInArrow(follow, schema)


def masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source", fingerprint=F.xxhash64) -> DataFrame:
    """(id, part, mask) for every row of docs."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = materialize(runs(rows, fingerprint), "audit_runs")
    edges = found.where("text IS NOT NULL")
    least = edges.groupBy("print", "text").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    moved = edges.join(least, ["print", "text"]).select("task", "run", "least")
    carried = found.where("text IS NULL").join(moved, ["task", "run"], "left")
    copy = ~F.col("id").eqNullSafe(F.coalesce("least", "first"))
    return carried.select("id", "part", (F.col("mask") + F.when(copy, DUPLICATE).otherwise(0)).alias("mask"))


def counters(masked: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those of them that labels call good or toxic."""
    said = labels.where("quality = 1 OR toxic = 1").groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return masked.join(said, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), whole("good"), whole("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, the filter's bit, the bits of those before it) of all orders."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(p), n + 1, bit[f], sum(bit[x] for x in p[:n])) for p in permutations(FILTERS) for n, f in enumerate(p)]


def report(counted: DataFrame) -> DataFrame:
    """One row for each part, order and step; a part has 32 counters at most, so its row holds them all."""
    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    literal = F.array(*(F.struct(F.lit(o).alias("order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, s, b, p in steps()))
    each = held.select("part", "cells", F.explode(literal).alias("at")).select("part", "cells", "at.*")

    def total(what: str, where) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.aggregate("cells", zero, lambda s, c: s + F.when(where(c["mask"]), c[what]).otherwise(zero))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # A filter is the first of a document's k failing ones in one of k orders.
    orders = F.lit(len(steps()) // len(FILTERS)).cast("bigint")
    share = F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + F.when(fails(c["mask"]), c["n"] * F.floor(orders / F.bit_count(c["mask"]))).otherwise(F.lit(0).cast("bigint")))
    return each.select("part", F.col("order").alias("filter_order"), "step", total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"),
                       total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
                       total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    return report(materialize(counters(masks(docs, text, doc_id, part), labels, doc_id), "audit_counters"))
