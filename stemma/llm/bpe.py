"""Byte-level BPE of whole texts by overlapping chunks, and decoding by concatenating bytes.

A text longer than a chunk is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from its own
start, so a chunk's first boundaries may be wrong. The pattern looks ahead but never behind, hence once two neighbours
have one boundary in common all later ones agree: that is where they are stitched, at a boundary with no white space
before it, so that a piece alone splits as it does inside the text. Where two neighbours have no such boundary (thousands of
letters without a break) what follows their last right boundary is cut again, into chunks and overlaps twice as long, until
neighbours meet: so only the stretch without a break, and no more than some times its length, is one piece. The pieces are
then encoded in parallel and their ids put together in order. A text of one chunk is one piece. The chunks of a text of more
than SPREAD characters go to different tasks; those of a shorter one stay in its row's task, as moving them costs more than
it saves. Both ways give the same ids.

Null text counts as empty and has no ids. Repeated rows and null ids need no care, as no column serves as a key.
Columns of the input with the name of an output are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.common import arrow_map, others, pieces, workers_find_package
from stemma.sources.shared import materialize

CHUNK, OVERLAP, SPREAD = 1 << 14, 1 << 11, 1 << 18
#: A boundary so near the end of a chunk may depend on what follows: the longest contraction has three characters.
UNSURE = 3


@lru_cache(maxsize=4)
def _tokens(ranks: bytes) -> list[bytes]:
    pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in ranks.splitlines() if line))
    table = [b""] * (pairs[-1][0] + 1)
    for rank, token in pairs:
        table[rank] = token
    return table


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: r for r, t in enumerate(_tokens(ranks)) if t}, special_tokens={})


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; the driver reads it, executors get it by broadcast (a vocabulary has a fixed size)."""
    with open(path, "rb") as f:
        return f.read()


def _list_array(lists: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
    if ends[-1] > 2**31 - 1:
        raise ValueError("a batch has too many ids")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else [], kind))


def _encoder(shared, pattern: str, text: str, cut: Callable[[str], list[str]] = lambda x: [x]):
    def batch(b: pa.RecordBatch) -> list:
        encode = _encoding(shared.value, pattern).encode_to_numpy
        ids = (np.concatenate([encode(piece, disallowed_special=()).astype(np.int32) for piece in cut(x.as_py() or "")]) for x in b.column(text))
        return [_list_array(list(ids), pa.int32())]

    return batch


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens that have no white space as their last character."""
    return [m.end() for m in regex.finditer(pattern, text) if not m.group()[-1].isspace()]


def _edges(part: str, pattern: str, chunk: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's boundaries up to overlap, and its sure ones beyond chunk as its neighbour counts them."""
    ends = np.array(boundaries(part, pattern), np.int32)
    sure = ends[ends <= len(part) - UNSURE]
    return ends[ends <= overlap], sure[sure > chunk] - chunk


def stitched(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pieces of one text."""
    at, scale = [0], 1
    while True:
        size, lap, tail = scale * chunk, scale * overlap, None
        for start in range(at[-1], len(text) if len(text) > chunk else 0, size):
            head, after = _edges(text[start : start + size + lap], pattern, size, lap)
            if tail is not None:
                met = np.intersect1d(tail, head)
                if not len(met):
                    scale *= 2
                    break
                at.append(start + int(met[0]))
                if scale > 1:  # beyond the stretch
                    scale = 1
                    break
            tail = after
        else:
            return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


def _cut(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks (__rid, __row, __text, __k) of long texts; __row with a text's first chunk only."""
    def run(batches):
        for batch in (part for whole in batches for part in pieces(whole)):
            of, first, k, parts = [], [], [], []
            for i, x in enumerate(batch.column("__text").to_pylist()):
                for n, at in enumerate(range(0, len(x), chunk)):
                    of.append(i)
                    first.append(None if n else i)
                    k.append(n)
                    parts.append(x[at : at + chunk + overlap])
            yield pa.RecordBatch.from_arrays([batch.column("__rid").take(pa.array(of, pa.int32())), batch.column("__row").take(pa.array(first, pa.int32())), pa.array(parts, pa.string()), pa.array(k, pa.int32())], names=["__rid", "__row", "__text", "__k"])

    rows = long.select("__rid", "__row", "__text")
    return rows.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema), T.StructField("__k", T.IntegerType())]))


def _stitched(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Pieces (__rid, __piece, __row, __text, __chunks) of long texts; __row with a text's first piece only. From the first pair
    of neighbours that don't meet on, the rest is one piece, of several chunks."""
    cut = _cut(long, chunk, overlap)

    def edges(b: pa.RecordBatch) -> list:
        head, tail = [], []
        for x in b.column("__text"):
            for found, part in zip((head, tail), _edges(x.as_py(), pattern, chunk, overlap)):
                found.append(part)
        return [_list_array(head, pa.int32()), _list_array(tail, pa.int32())]

    marked = arrow_map(cut.repartition("__rid", "__k"), "__head array<int>, __tail array<int>", edges)
    by_text = Window.partitionBy("__rid").orderBy("__k")
    met = marked.withColumn("__start", F.array_min(F.array_intersect(F.lag("__tail").over(by_text), "__head")))
    met = met.withColumn("__met", F.min((F.col("__k") == 0) | F.col("__start").isNotNull()).over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumns({"__piece": F.sum(F.col("__met").cast("int")).over(by_text.rowsBetween(Window.unboundedPreceding, 0)),
                           "__stop": F.lead(F.when(F.col("__met"), F.col("__start"))).over(by_text)})
    start = F.when(F.col("__met"), F.coalesce("__start", F.lit(0))).otherwise(0)
    stop = chunk + F.coalesce("__stop", F.lit(0))
    part = F.substring("__text", start + 1, stop - start)
    return (met.select("__rid", "__piece", "__row", "__k", part.alias("__text"))
            .groupBy("__rid", "__piece").agg(F.first("__row", True).alias("__row"), F.array_sort(F.collect_list(F.struct("__k", "__text"))).alias("__parts"))
            .select("__rid", "__piece", "__row", F.array_join(F.col("__parts.__text"), "").alias("__text"), F.size("__parts").alias("__chunks")))


def _all_pieces(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Pieces (__rid, __piece, __row, __text) of long texts. What is left of a text after neighbours that don't meet is cut
    again with longer chunks; it comes last, so its pieces go on counting."""
    rows = long.select(F.struct("__rid", F.lit(0).cast("bigint").alias("before")).alias("__rid"), "__row", "__text")
    columns, done = ["__rid", "__piece", "__row", "__text"], None
    while True:
        found = _stitched(rows, pattern, chunk, overlap).withColumn("__piece", F.col("__rid.before") + F.col("__piece"))
        found = materialize(found, "bpe_pieces")
        whole = found.where("__chunks = 1").select(columns)
        done = whole if done is None else done.union(whole)
        rest = found.where("__chunks > 1")
        if rest.isEmpty():
            return done.select(F.col("__rid.__rid").alias("__rid"), "__piece", "__row", "__text")
        rows = rest.select(F.struct(F.col("__rid.__rid").alias("__rid"), F.col("__piece").alias("before")).alias("__rid"), "__row", "__text")
        chunk, overlap = 2 * chunk, 2 * overlap


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """df (its columns in keep, all by default) with the token ids of each whole text, as an array of int."""
    spark: SparkSession = df.sparkSession
    workers_find_package(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [c for c in others(df, ids) if keep is None or c in keep]
    # The marker column is there even if nothing else is kept.
    rows = df.select(F.struct(F.lit(True).alias("__here"), *(F.col(f"`{c}`") for c in kept)).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    apart = F.char_length("__text") > max(spread, chunk)
    short = arrow_map(rows.where(~apart), "__ids array<int>", _encoder(shared, pattern, "__text", lambda x: stitched(x, pattern, chunk, overlap)), ["__row"])
    long = rows.where(apart).withColumn("__rid", F.monotonically_increasing_id())
    joined = _all_pieces(long, pattern, chunk, overlap).repartition("__rid", "__piece")
    coded = arrow_map(joined, "__ids array<int>", _encoder(shared, pattern, "__text"), ["__rid", "__piece", "__row"])
    joined = (coded.groupBy("__rid").agg(F.first("__row", True).alias("__row"), F.array_sort(F.collect_list(F.struct("__piece", "__ids"))).alias("__parts"))
              .select("__row", F.flatten("__parts.__ids").alias("__ids")))
    return short.union(joined).select(*(F.col(f"__row.`{c}`") for c in kept), F.col("__ids").alias(ids))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "bytes", packed: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df with the bytes of each row's ids; with packed, also the ids as little-endian unsigned 32-bit integers.

    Null ids count as none. An id outside the vocabulary is an error.
    """
    workers_find_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def batch(b: pa.RecordBatch) -> list:
        token = _tokens(shared.value).__getitem__
        rows = [np.empty(0, np.int32) if x.values is None else x.values.to_numpy(zero_copy_only=False) for x in b.column(ids)]
        made = [pa.array([b"".join(map(token, x.tolist())) for x in rows], pa.binary())]
        return made + [pa.array([x.astype("<u4").tobytes() for x in rows], pa.binary())] * (packed is not None)

    return arrow_map(df, f"`{out}` binary" + f", `{packed}` binary" * (packed is not None), batch, keep)
