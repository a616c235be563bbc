"""Keyed tables in files: rows in buckets by key, merges as deltas, commits by compare-and-set.

A table is a list of parts, oldest first. A part holds whole rows, at most one for a key, each with its bucket (a hash of
the key, or of some columns of it) and whether it deletes the key; the newest part that has a key decides. A merge reads
the buckets that its keys are in and writes one part with the rows that are new, changed or gone, whatever the table's size.
Compaction joins the newest parts while an older one is at most RATIO times as large as they are together, so there are few
parts and a row is rewritten a logarithmic number of times; deletions end with the oldest part.

A version is a small file that lists each table's parts, and what buckets its commit wrote. A commit writes its parts first,
then puts the next version in place by an operation that fails if that version exists. If it does, others have committed
since: where what they wrote is apart from what this commit read and wrote, it is put on top of theirs; else it raises
Conflict, and transact computes the change anew. So no update is lost, a reader sees a version or the next, and a writer that
dies leaves files that no version names (vacuum removes them).

Rules are checked by the commit on the rows it writes: checks and required columns, keys (once each within the commit), and
unique columns through index tables that are kept with their table.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stemma import schema
from stemma.functions.text import trigrams
from stemma.sources import shared

BUCKETS, FANOUT, RATIO, TRIES = 64, 4, 2, 8
GONE, BUCKET = "__gone", "__bucket"


class Conflict(RuntimeError):
    """Others have committed what a commit depends on."""


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in schema.DEFAULTS.get(table, {}).items()})


def conform(df: DataFrame, table: str, *more: str) -> DataFrame:
    """df with exactly the table's columns (and more): missing ones become null or the table's default."""
    fields = StructType.fromDDL(schema.STORED[table][0])
    return with_defaults(df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields), *more), table)


def gone(keys: DataFrame) -> DataFrame:
    """Rows that delete their keys."""
    return keys.withColumn(GONE, F.lit(True))


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    at = hadoop_path(spark, path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is no such file."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file, in one step, unless the target exists; whether it did."""
    fs, at = file_system(spark, source)
    to = hadoop_path(spark, target)
    if fs.getUri().getScheme() == "file":  # rename would replace the target there
        try:
            os.link(at.toUri().getPath(), to.toUri().getPath())
        except FileExistsError:
            return False
        fs.delete(at, False)
        return True
    return rename_new(spark, fs.makeQualified(at), fs.makeQualified(to))


def rename_new(spark: SparkSession, at, to) -> bool:
    try:
        _rename(spark, at, to, "NONE")
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def _rename(spark: SparkSession, at, to, how: str) -> None:
    jvm = spark.sparkContext._jvm
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    jvm.java.lang.reflect.Array.set(options, 0, jvm.java.lang.Enum.valueOf(kind, how))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at, to, options)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file in one step."""
    fs, to = file_system(spark, path)
    to = fs.makeQualified(to)
    write_text(spark, f"{path}.part", text)
    _rename(spark, fs.makeQualified(hadoop_path(spark, f"{path}.part")), to, "OVERWRITE")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, False)


@dataclass
class Part:
    path: str
    seq: int
    rows: int
    buckets: list[int]


@dataclass
class Snapshot:
    """One version, and which buckets of which tables were read from it (None: all)."""

    store: Store
    version: int
    tables: dict[str, list[Part]]
    written: dict[str, list[int] | None]
    reads: dict[str, set[int] | None] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        self.reads[name] = None
        return self.store.frame(name, self.tables.get(name, []))

    def rows(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows whose columns are among keys; keys has at least the columns that make the bucket."""
        found, n = self._around(name, keys)
        return found.join(shared.beside(keys.distinct(), n), keys.columns, "left_semi") if self.tables.get(name) else found

    def around(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that keys are in: enough where a join with many keys follows anyway."""
        return self._around(name, keys)[0]

    def _around(self, name: str, keys: DataFrame) -> tuple[DataFrame, int]:
        """The rows of the buckets that keys are in, and how many keys there are, if the table has rows."""
        by = schema.STORED[name][2]
        parts = self.tables.get(name, [])
        if not parts:
            return self.table(name), 0
        mine = dict(keys.groupBy(self.store.bucket(by)).count().collect())  # at most as many as buckets
        seen = self.reads.setdefault(name, set())
        if seen is not None:
            seen.update(mine)
        return self.store.frame(name, parts, sorted(mine)), sum(mine.values())

    def has(self, name: str) -> bool:
        return name in self.tables


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout
        made = read_text(spark, f"{path}/buckets")
        self.buckets = int(made) if made else buckets

    # Reading.

    def bucket(self, by: Iterable[str]) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def versions(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the newest by default; before the first there are no tables."""
        if version is None:
            version = max([0, *self.versions()])
        if not version:
            return Snapshot(self, 0, {}, {})
        text = read_text(self.spark, self._version(version))
        if text is None:
            raise FileNotFoundError(f"{self.path} has no version {version}")
        made = json.loads(text)
        return Snapshot(self, version, {t: [Part(**p) for p in parts] for t, parts in made["tables"].items()}, made["written"])

    def _version(self, number: int) -> str:
        return f"{self.path}/versions/{number:08d}"

    def _part(self, name: str, part: Part, buckets: list[int] | None) -> DataFrame:
        found = self.spark.read.schema(f"{schema.STORED[name][0]}, {GONE} boolean, {BUCKET} int").parquet(f"{self.path}/{part.path}")
        return found if buckets is None or set(part.buckets) <= set(buckets) else found.where(F.col(BUCKET).isin(buckets))

    def frame(self, name: str, parts: list[Part], buckets: list[int] | None = None, whole: bool = False) -> DataFrame:
        """The parts' rows; whole: with the deletions. A bucket that one part alone has is read as it is."""
        columns, key, _ = schema.STORED[name]
        shown = [f.name for f in StructType.fromDDL(columns)] + [GONE] * whole
        held = {b for p in parts for b in p.buckets}
        wanted = held if buckets is None else held & set(buckets)
        holders = {b: [p for p in parts if b in p.buckets] for b in wanted}
        several = sorted(b for b, h in holders.items() if len(h) > 1)
        frames = [self._part(name, p, mine) for p in parts if (mine := sorted(b for b in p.buckets if b in wanted and len(holders[b]) == 1))]
        if several:
            met = None
            for p in parts:
                if set(p.buckets) & set(several):
                    one = self._part(name, p, several).withColumn("__seq", F.lit(p.seq))
                    met = one if met is None else met.unionByName(one)
            newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__seq")))
            frames.append(met.withColumn("__n", newest).where("__n = 1").drop("__n", "__seq"))
        if not frames:
            return self.spark.createDataFrame([], columns + f", {GONE} boolean" * whole)
        out = frames[0]
        for x in frames[1:]:
            out = out.unionByName(x)
        return (out if whole else out.where(~F.col(GONE))).select(shown)

    # Writing.

    def _write(self, name: str, rows: DataFrame, base: bool, once: bool = False) -> Part | None:
        """Rows as a part's files: those of a base in folders by bucket, others in few files, sorted by bucket. once: no key is
        there twice, as the rows were made so; others are counted."""
        _, key, by = schema.STORED[name]
        path = f"{name}/{uuid.uuid4().hex}"
        flag = F.coalesce(F.col(GONE), F.lit(False)) if GONE in rows.columns else F.lit(False)
        dealt = conform(rows.withColumn(GONE, flag), name, GONE).withColumn(BUCKET, self.bucket(by)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *key)
        (dealt.write.partitionBy(BUCKET) if base else dealt.write).parquet(f"{self.path}/{path}")
        rules = {rule: c for rule, c in self._rules(name).items() if not (once and rule.startswith("unique "))}
        found = self._part(name, Part(path, 0, 0, []), None).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("rows"), *(c.alias(f"rule {n}") for n, c in enumerate(rules.values()))).orderBy(BUCKET).collect()
        broken = {rule: n for i, rule in enumerate(rules) if (n := sum(r[f"rule {i}"] for r in found))}
        if broken:
            raise ValueError(f"{name}: " + "; ".join(f"{rule}: {n} rows" for rule, n in broken.items()))
        return Part(path, 0, sum(r["rows"] for r in found), [r[BUCKET] for r in found]) if found else None

    @staticmethod
    def _rules(name: str) -> dict[str, Column]:
        """How many rows of a bucket break each rule; rows of one key are in one bucket."""
        key = schema.STORED[name][1]
        here, some = ~F.col(GONE), lambda condition: F.count(F.when(condition, 1))
        rules = {f"check {schema.CHECKS[name]}": some(here & F.expr(f"NOT ({schema.CHECKS[name]})"))} if name in schema.CHECKS else {}
        rules |= {f"not null {c}": some(here & F.col(c).isNull()) for c in dict.fromkeys([*schema.REQUIRED.get(name, []), *key])}
        return rules | {f"unique {', '.join(key)}": F.count(F.lit(1)) - F.count_distinct(F.struct(*key))}

    def _followers(self, base: Snapshot, name: str, rows: DataFrame, n: int, replaced: bool) -> dict[str, DataFrame]:
        """What the tables that are kept with a table have to change for its n rows: indexes of its unique columns, postings of
        its labels. Each row is put beside the one before it once; the rest follows row by row."""
        key = schema.STORED[name][1]
        followers = schema.FOLLOWERS.get(name, {})
        if not followers:
            return {}
        columns = list(followers.values())
        now = rows.select(*key, *(F.when(~F.col(GONE), F.col(c)).alias(c) for c in columns))
        if replaced:
            met = now.withColumns({f"was {c}": F.lit(None).cast("string") for c in columns})
        else:
            old = (base.rows if n <= shared.FEW else base.around)(name, rows.select(*key))
            old = old.select(*key, *(F.col(c).alias(f"was {c}") for c in columns))
            met = shared.materialize(now.join(shared.beside(old, n), list(key), "left"), "store_changes")
        out = {}
        for follower, c in followers.items():
            if follower == schema.GRAMS:
                out[follower] = self._postings(met, c, f"was {c}")
                continue
            changed = ~F.col(c).eqNullSafe(F.col(f"was {c}"))
            added, left = (met.where(changed & F.col(x).isNotNull()).select(F.col(x).alias("value"), "id") for x in (c, f"was {c}"))
            if replaced:
                out[follower] = added
                continue
            self._once(base, follower, c, added, left, n)
            lost = left.join(shared.beside(added.select("value"), n), "value", "left_anti")
            out[follower] = added.withColumn(GONE, F.lit(False)).unionByName(gone(lost))
        return out

    @staticmethod
    def _postings(rows: DataFrame, column: str, was: str) -> DataFrame:
        """What changes of the postings where a label changes: those of a label with another number of trigrams all do."""
        none = F.array().cast("array<string>")
        grams = lambda c: F.coalesce(trigrams(F.col(c)), none)
        both = rows.where(~F.col(column).eqNullSafe(F.col(was))).select("id", grams(column).alias("now"), grams(was).alias("before"))
        added = F.when(F.size("now") == F.size("before"), F.array_except("now", "before")).otherwise(F.col("now"))
        told = lambda grams, n, lost: F.transform(grams, lambda g: F.struct(g.alias("gram"), F.size(n).alias("n"), F.lit(lost).alias(GONE)))
        return both.select("id", F.inline(F.concat(told(added, "now", False), told(F.array_except("before", "now"), "before", True))))

    def _once(self, base: Snapshot, follower: str, column: str, added: DataFrame, left: DataFrame, n: int) -> None:
        """Entries that are added may not have a value of another row, unless that row leaves it with the same commit."""
        held = base.rows(follower, added.select("value")).join(shared.beside(left, n), ["value", "id"], "left_anti").select("value", F.col("id").alias("other"))
        if twice := held.join(shared.beside(added, n), "value").where("id <> other").count():
            raise ValueError(f"unique {column}: {twice} values")

    def commit(self, base: Snapshot, changes: dict[str, DataFrame], replaced: Iterable[str] = (), once: Iterable[str] = ()) -> Snapshot:
        """Puts changes (rows that are new, changed or gone) on top of base, or, of the tables in replaced, the whole content.
        once: tables whose changes have every key once by their making."""
        replaced = set(replaced)
        wrote: dict[str, Part | None] = {}
        for name, rows in changes.items():
            whole = name in replaced
            part = wrote[name] = self._write(name, rows, whole or name not in base.tables, name in once)
            if whole:
                replaced |= set(schema.FOLLOWERS.get(name, {}))
                wrote |= {f: None for f in schema.FOLLOWERS.get(name, {})}
            if part:
                written = self._part(name, part, None).drop(BUCKET)
                for follower, more in self._followers(base, name, written, part.rows, whole).items():
                    wrote[follower] = self._write(follower, more, whole or follower not in base.tables)
        dropped = {d for t in replaced for d in schema.DERIVED.get(t, ())} - set(changes)
        return self.compact(self._publish(base, wrote, replaced, dropped))

    def _publish(self, base: Snapshot, wrote: dict[str, Part | None], replaced: set[str], dropped: set[str] = frozenset()) -> Snapshot:
        touched = {t: None if t in replaced else p.buckets for t, p in wrote.items() if p or t in replaced} | {t: None for t in dropped}
        if not touched:
            return base
        now = base
        while True:
            number = now.version + 1
            tables = {t: list(parts) for t, parts in now.tables.items() if t not in dropped}
            for t, p in wrote.items():
                tables[t] = ([] if t in replaced else tables.get(t, [])) + ([Part(p.path, number, p.rows, p.buckets)] if p else [])
            if self._put(number, tables, touched):
                return Snapshot(self, number, tables, touched)
            newest = self.snapshot()
            for v in range(now.version + 1, newest.version + 1):
                theirs = self.snapshot(v).written
                for t, buckets in theirs.items():
                    mine = [x for x in (touched.get(t, []), base.reads.get(t, [])) if x is None or x]
                    if any(buckets is None or x is None or set(buckets) & set(x) for x in mine):
                        raise Conflict(f"{self.path}: version {v} has changed {t} since version {base.version}")
            now = newest

    def _put(self, number: int, tables: dict[str, list[Part]], written: dict[str, list[int] | None]) -> bool:
        fs, at = file_system(self.spark, f"{self.path}/versions")
        if not fs.exists(at):
            fs.mkdirs(at)
        if read_text(self.spark, f"{self.path}/buckets") is None:
            write_text(self.spark, f"{self.path}/buckets", str(self.buckets))
        part = f"{self.path}/versions/.{uuid.uuid4().hex}"
        write_text(self.spark, part, json.dumps({"tables": {t: [vars(p) for p in parts] for t, parts in tables.items()}, "written": written}))
        if move_new(self.spark, part, self._version(number)):
            return True
        fs.delete(hadoop_path(self.spark, part), False)
        return False

    def transact(self, change: Callable[[Snapshot], dict[str, DataFrame]], tries: int = TRIES, once: Iterable[str] = ()) -> Snapshot:
        """Commits what change makes of the newest version, and makes it anew if others were faster."""
        for n in range(tries):
            base = self.snapshot()
            try:
                return self.commit(base, change(base), once=once)
            except Conflict:
                if n == tries - 1:
                    raise
        raise AssertionError

    # Upkeep.

    def compact(self, at: Snapshot | None = None) -> Snapshot:
        """Joins the newest parts of tables that have more than fanout; content stays the same."""
        at = at or self.snapshot()
        for name, parts in list(at.tables.items()):
            if len(parts) <= self.fanout:
                continue
            first, rows = len(parts) - 2, parts[-1].rows + parts[-2].rows
            while first and parts[first - 1].rows <= RATIO * rows:
                first -= 1
                rows += parts[first].rows
            merged = self._write(name, self.frame(name, parts[first:], whole=first > 0).withColumn(GONE, F.col(GONE) if first else F.lit(False)), not first, True)
            at = self._swap(at, name, parts[first:], merged)
        return at

    def _swap(self, at: Snapshot, name: str, old: list[Part], merged: Part | None) -> Snapshot:
        paths = {p.path for p in old}
        while True:
            parts = at.tables.get(name, [])
            if not paths <= {p.path for p in parts}:
                return at  # others have joined or replaced them
            new = [Part(merged.path, old[-1].seq, merged.rows, merged.buckets)] if merged else []
            where = next(i for i, p in enumerate(parts) if p.path in paths)
            tables = at.tables | {name: parts[:where] + new + parts[where + len(old) :]}
            if self._put(at.version + 1, tables, {}):
                return Snapshot(self, at.version + 1, tables, {})
            at = self.snapshot()

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the newest versions, and the folders that none of those names; how many folders went. Not while
        others write."""
        kept = self.versions()[-keep:]
        named = {p.path for v in kept for parts in self.snapshot(v).tables.values() for p in parts}
        fs, _ = file_system(self.spark, self.path)
        for v in self.versions()[:-keep]:
            fs.delete(hadoop_path(self.spark, self._version(v)), False)
        n = 0
        for table in schema.STORED:
            at = hadoop_path(self.spark, f"{self.path}/{table}")
            for f in fs.listStatus(at) if fs.exists(at) else []:
                if f"{table}/{f.getPath().getName()}" not in named:
                    fs.delete(f.getPath(), True)
                    n += 1
        return n
