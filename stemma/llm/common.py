"""What the text operators share: reading tables, Arrow maps, names of inner columns."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: ASCII white space as the contracts spell it, and its complement, for Java's regular expressions.
SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Python workers outlive their tasks: with these settings they give the memory of a finished batch back.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1000000"}


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package by name; where the driver found it by sys.path alone, they are told."""
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, os.environ.get(name, value))
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def id_text(doc_id: str | Column) -> Column:
    """The id as text, empty for null, as the fold rules hash it."""
    return F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))


def fold(doc_id: str, mod: int) -> Column:
    return F.crc32(id_text(doc_id)) % mod


def others(df: DataFrame, *replaced: str) -> list[str]:
    """df's columns but those that an operator's output replaces."""
    return [c for c in df.columns if c not in replaced]


def boxed(columns: list[str]) -> Column:
    """The columns as one, so that inner columns may have any names."""
    return F.struct(*(columns or [F.lit(None).cast("int").alias("none")])).alias("__row")


def unboxed(columns: list[str]) -> list[Column]:
    return [F.col("__row")[c].alias(c) for c in columns]


#: Bytes and rows of an Arrow batch that are worked on at a time.
PART_BYTES, PART_ROWS = 4 << 20, 2048


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about PART_BYTES, so that what is made of them stays small; none if it is empty."""
    n = max(1, min(PART_ROWS, batch.num_rows * PART_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def arrow_map(df: DataFrame, outputs: str, fn: Callable[[pa.RecordBatch], list], keep: list[str] | None = None) -> DataFrame:
    """df with further columns: fn gets each Arrow batch and returns one sequence for each column of the DDL outputs.

    keep: the columns of df to hand on (all by default); those that outputs names again are replaced.
    """
    workers_find_package(df.sparkSession)
    added = T.StructType.fromDDL(outputs)
    names = [f.name for f in added]
    kept = [f for f in df.schema if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType(kept + list(added))
    arrow = [to_arrow_type(f.dataType) for f in added]
    handed = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(fn(batch), arrow)]
            made = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in made]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in handed] + made, names=handed + names)

    return df.mapInArrow(run, schema)
