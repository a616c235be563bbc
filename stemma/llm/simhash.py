"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distances, components.

A fingerprint has 64 bits. Split into DISTANCE + 2 blocks, two fingerprints that differ in at most DISTANCE bits agree
in two blocks at least, so each pair of blocks with its values is a join key of 32 bits or so and close pairs meet under
one of the keys. Only distinct fingerprints are joined: documents with one fingerprint are one node, whatever their
number. Keys that few fingerprints share are joined pair by pair. A key that more than CROWD fingerprints share would
make many pairs, so its fingerprints are linked through probes instead: each stands for its 64 one-bit neighbours and
itself, and all that share a probe link to the probe's smallest. Two fingerprints share a probe exactly if they differ in
at most two bits, so this finds the same components with work in proportion to the fingerprints.

Null, empty and space-only texts have fingerprint zero and link like any other. Very long texts are hashed whole, PIECE
shingles at a time; a bit that exactly half the shingles set is 0. Fewer words than a shingle make one
shingle of all words. Repeated rows are rows of the same group; null ids lose against all others; groups are
known by fingerprint, so ids that several groups share, or none, keep a row for each group. Other columns may have
any names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.bit_filter import BitFilter
from stemma.llm.common import arrow_map
from stemma.operators.components import connected_components
from stemma.sources.shared import materialize

#: The shortest and longest distance for which the probes of one bit are exact.
DISTANCE = 2
CROWD = 8
#: Bounds of the blocks, by bits.
BLOCKS = [(0, 16), (16, 16), (32, 16), (48, 16)]
#: Shingles hashed at a time: what a text of any length needs beside itself.
PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    hashed, set_in = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        to = min(n, at + PIECE)
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())
        h = np.fromiter((hashed(joined[s:e], seed) for s, e in spans), np.uint64, to - at)
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """docs with the fingerprint as a signed long."""

    def batch(b: pa.RecordBatch) -> list:
        made = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(text)), np.uint64, b.num_rows)
        return [pa.array(made.view(np.int64))]

    return arrow_map(docs, f"`{out}` bigint", batch, keep)


def _keys(fp: Column) -> Column:
    """An array of (pair of blocks, value) for each pair of blocks."""
    def block(i: int) -> Column:
        at, width = BLOCKS[i]
        return F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)

    return F.array(*(F.struct(F.lit(n).cast("tinyint").alias("blocks"), F.shiftleft(block(i), 16).bitwiseOR(block(j)).alias("value"))
                     for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) whose components are those of all pairs within DISTANCE bits."""
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("key")).select("fp", "key.*")
    sizes = keyed.groupBy("blocks", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(keyed.join(sizes, ["blocks", "value"]), "simhash_blocks")
    few = met.where(F.col("n") <= crowd)
    a, b = (few.select("blocks", "value", F.col("fp").alias(x)) for x in "ab")
    near = a.join(b, ["blocks", "value"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(x)) for x in np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)).view(np.int64).tolist()]
    probes = met.where(F.col("n") > crowd).select("fp").distinct().select("fp", F.explode(F.array(*flips)).alias("probe"))
    least = probes.groupBy("probe").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("probe", "a")
    return near.union(probes.join(least, "probe").where("a < fp").select("a", F.col("fp").alias("b"))).distinct()


def _rooted(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """nodes (distinct fingerprints in column fp) with root: the fingerprint that stands for their component."""
    roots = connected_components(links(nodes.select("fp"), crowd))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_groups(prints: DataFrame, doc_id: str = "doc_id", fp: str = "fp", crowd: int = CROWD) -> DataFrame:
    """prints with component_id: the smallest id of the rows whose fingerprints are linked, directly or in steps."""
    nodes = materialize(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")), "simhash_nodes")
    rooted = _rooted(nodes, crowd)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fp").alias("__node"), "component_id")
    return prints.drop("component_id").join(named, F.col(fp) == F.col("__node")).drop("__node")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs' rows that stay, with docs' columns: of each group one row, the first by id (nulls last), fingerprint and hash
    of id and text; of rows that agree in id and text any one."""
    said = (F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))
    keys = [F.xxhash64(*said).alias("__a"), F.xxhash64(F.lit(1), *said).alias("__b")]
    prints = fingerprints(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), *keys), "__text", "__fp", ["__id", "__a", "__b"])
    prints = materialize(prints, "simhash_rows")
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__fp", "__a", "__b"))
    nodes = materialize(prints.groupBy(F.col("__fp").alias("fp")).agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "simhash_nodes")
    rooted = _rooted(nodes)
    groups = materialize(rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1"), "simhash_groups")
    kept = groups.select("first.__a", "first.__b")
    grouped = rooted.select("fp", "root").join(groups.select("root"), "root").select("fp")
    # Only rows of groups of two and more are moved; of the others none can go.
    crowd = materialize(prints.join(grouped, F.col("__fp") == F.col("fp"), "left_semi").select("__a", "__b").distinct(), "simhash_grouped")
    rows = docs.select(F.struct("*").alias("__row"), *keys)
    hits, alone = BitFilter(crowd, "__a").split(rows, "__a")
    missed = hits.join(crowd, ["__a", "__b"], "left_anti")  # what only the filter's crowding has hit
    # Rows that agree in id and text meet in one task only after each task has kept one of them.
    one = Window.partitionBy("__a", "__b").orderBy(F.lit(1))
    stay = hits.join(kept, ["__a", "__b"], "left_semi").withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return stay.select("__row.*").union(missed.select("__row.*")).union(alone.select("__row.*"))
