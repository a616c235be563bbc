"""Exact duplicates by a log-structured merge index over text digests; DataFrame functions only.

* Memtable: a task sorts the digests of its split and flushes them as part of a run, Parquet files with Bloom filters,
  which point lookups probe before they read a page.
* Levels: every batch that is added is one run of level 0; FANOUT runs of a level are compacted into one run of the
  next, sorted by digest, which keeps for each digest the smallest id and the number of rows. A run also has a bit filter
  sized by its digests; whether a batch's digests are in the index is asked of the runs' filters first, so rows that
  are new to all of them never leave their split.
* Hits get byte verification: rows whose digest has copies (found through a bit filter of the digests that have some)
  are reduced to the least and the greatest text of each digest. The two are equal exactly when all the bytes are.
  Should a digest join different texts, its rows are grouped by the text itself.

Nothing ever gathers the rows of a group: minima, maxima and counts combine before the shuffle, and the joins that hand
a group's result back to its rows are plain equi-joins, which adaptive execution splits when one digest is hot.

Null text counts as empty text. Very long texts are normalised whole, in their row; only digests are shuffled, and the texts
of digests that have copies. Null ids lose against all others; a group of null ids only has a null keep_id. Of rows
that agree in text and id, one is kept. Other columns of the input play no part and may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.bit_filter import BitFilter
from stemma.llm.common import SPACES
from stemma.sources.shared import fresh_path, materialize

BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: Runs of a level that make one run of the next.
FANOUT = 4


def normalized(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


@dataclass
class Run:
    """(digest, keep_id, group_size), sorted by digest in each file; of level 0 a row for each row that was added."""

    level: int
    table: DataFrame
    #: Made when it is first asked.
    filter: BitFilter | None = None

    def might_hold(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        self.filter = self.filter or BitFilter(self.table, "digest")
        return self.filter.split(rows, "digest")


class DigestIndex:
    """Runs of digests in levels, below a folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path or fresh_path(spark, "digests"), fanout
        self.runs: list[Run] = []
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> Run:
        path, self.made = f"{self.path}/run-{self.made:06d}-level-{level}", self.made + 1
        rows.sortWithinPartitions("digest", "keep_id").write.options(**BLOOM).parquet(path)
        return Run(level, self.spark.read.schema(rows.schema).parquet(path))

    def flush(self, rows: DataFrame) -> Run:
        """Adds rows (digest, id) as a run of level 0: each task writes its memtable sorted."""
        run = self._write(rows.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")), 0)
        self.runs.append(run)
        return run

    def add(self, rows: DataFrame) -> DigestIndex:
        """Flushes rows and compacts each level that is full."""
        level = self.flush(rows).level
        while len(full := [r for r in self.runs if r.level == level]) >= self.fanout:
            self._merge(full, level + 1)
            level += 1
        return self

    def compact(self) -> DigestIndex:
        """Merges all runs into one of the highest level."""
        self._merge(self.runs, max(r.level for r in self.runs) + 1)
        return self

    def _merge(self, runs: list[Run], level: int) -> None:
        merged = self._write(_merged(runs), level)
        self.runs = [r for r in self.runs if r not in runs] + [merged]

    def table(self) -> DataFrame:
        """(digest, keep_id, group_size) of all that was added, one row for a digest."""
        return self.runs[0].table if len(self.runs) == 1 and self.runs[0].level else _merged(self.runs)

    def lookup(self, digest: bytes) -> DataFrame:
        """The index's row of one digest; files whose Bloom filter or range lacks it aren't read."""
        return _merged([Run(r.level, r.table.where(F.col("digest") == F.lit(bytearray(digest)))) for r in self.runs])

    def known(self, rows: DataFrame) -> DataFrame:
        """The rows (with digest) that the index has, with keep_id and group_size; only digests that a run's filter doesn't
        rule out are looked up in the run. Repeated rows stay as many as they are."""
        asked = rows.select("digest").distinct()
        found = [run.might_hold(asked)[0].join(run.table, "digest") for run in self.runs]
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        held = out.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        return rows.join(held, "digest").select(*rows.columns, "keep_id", "group_size")


def _merged(runs: list[Run]) -> DataFrame:
    rows = runs[0].table
    for r in runs[1:]:
        rows = rows.unionByName(r.table)
    return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _indexed(rows: DataFrame) -> tuple[DataFrame, DataFrame, BitFilter, DataFrame | None]:
    """For rows (id, norm, digest): the log (digest, id), the index's table, the filter of digests that have copies, and
    the digests that join different texts (None: there are none)."""
    index = DigestIndex(rows.sparkSession)
    log = index.flush(rows.select("digest", "id")).table
    table = index.compact().table()
    copied = BitFilter(table.where("group_size > 1"), "digest")
    ends = copied.split(rows, "digest")[0].groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    mixed = materialize(ends.where("least <> greatest").select("digest"), "digest_collisions")
    return log.select("digest", F.col("keep_id").alias("id")), table, copied, None if mixed.isEmpty() else mixed


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=sha256) -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, digest)."""
    rows = docs.select(F.col(doc_id).alias("id"), normalized(text).alias("norm")).withColumn("digest", digest(F.col("norm")))
    log, table, _, mixed = _indexed(rows)
    found = log.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("times")).join(table, "digest")
    if mixed is not None:
        found = found.join(mixed, "digest", "left_anti")
    columns = ["id", "keep_id", "group_size", "times", "digest"]
    found = found.select(columns)
    if mixed is not None:
        clashing = rows.join(mixed, "digest")
        one = clashing.groupBy("digest", "norm", "id").agg(F.count(F.lit(1)).alias("times"))
        sized = clashing.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.union(one.join(sized, ["digest", "norm"]).select(columns))
    copy = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")
    return (found.select("id", "keep_id", "group_size", "digest", copy)
            .select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=sha256) -> DataFrame:
    """docs' rows that stay, with docs' columns: of equal texts the one with the smallest id. Rows without copies are not
    moved."""
    wide = docs.select(F.struct("*").alias("__row"), F.col(doc_id).alias("id"), normalized(text).alias("norm")).withColumn("digest", digest(F.col("norm")))
    _, table, copied, mixed = _indexed(wide.select("id", "norm", "digest"))
    hits, alone = copied.split(wide, "digest")
    if mixed is not None:
        by_text = Window.partitionBy("digest", "norm").orderBy(F.col("id").asc_nulls_last())
        clashing = hits.join(mixed, "digest").withColumn("__n", F.row_number().over(by_text)).where("__n = 1").select("__row.*")
        hits = hits.join(mixed, "digest", "left_anti")
    keep = table.select(F.col("digest").alias("__digest"), "keep_id")
    stay = hits.drop("norm").join(keep, (F.col("digest") == F.col("__digest")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    # Rows that agree in id and text meet in one task only after each task has kept one of them.
    ties = Window.partitionBy("digest", "id").orderBy(F.lit(1))
    stay = stay.withColumn("__n", F.row_number().over(ties)).where("__n = 1").select("__row.*").union(alone.select("__row.*"))
    return stay if mixed is None else stay.union(clashing)
