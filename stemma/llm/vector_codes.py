"""Product codes of vectors, with codebooks found by rounds of assignment and means, in integers.

A component x becomes floor(SCALE * x). Vectors are cut into PARTS equal consecutive parts; each position has a codebook
of at most ENTRIES parts, and a part's code is the number of its nearest entry (squared distance, ties to the lower number).
The nearest entry is searched by segment-mean lower bounds: for a part cut into blocks, with a block's mean and the norm of
what remains beside the mean,

    distance >= sum over blocks of size * (difference of means)^2 + (difference of residual norms)^2,

so an entry whose bound is above the exact distance to some other entry is out. Bounds are taken with one block for the whole
part first, then with two, four and so on; at each level the entry of the smallest bound is the guess whose exact distance
sets what is out. What survives all levels gets exact distances in integers. The bounds of a level are one product of
matrices: a part's root-weighted means and residual norms are its coordinates, and their squares add up to the part's own.
They are lowered by more than rounding can raise them, so no nearest entry is lost.

Codebooks have PARTS * ENTRIES entries whatever the input, so they go to every task; a task adds up its parts by entry and
hands on one row an entry, so a round's shuffle depends on the number of tasks alone.

Vectors that are null, empty, or hold null or non-finite components are dropped. The length of vectors is that of the row
with the smallest id whose length PARTS divides; rows of another length are dropped as well. Ids may be null (they come
last) or repeated (vectors order those): fewer rows than ENTRIES make shorter codebooks. Integers beyond what exact
distances allow are cut to the limit (for 64 components 2^27). An empty table gives none. Very long vectors work like
others; columns that are named as an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import arrow_map, boxed, others, pieces, unboxed, workers_find_package
from stemma.sources.shared import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Parts compared with a codebook at a time.
ROWS = 4096
#: What rounding may add to a bound, as a share of the two squared norms.
SLACK = 1e-11
#: Labels whose sums are broadcast.
BROADCAST_LABELS = 100_000


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def integers(column: pa.Array, length: int) -> np.ndarray:
    """(rows, length) of a list array whose lists all have that length and no nulls."""
    values = np.asarray(pc.cast(column.flatten(), pa.float64())).reshape(len(column), length)
    limit = 2.0 ** ((62 - (length - 1).bit_length()) // 2 - 1)
    return np.clip(np.floor(values * SCALE), -limit, limit).astype(np.int64)


@dataclass
class Blocks:
    """Of each row, for its blocks: means times the root of the size, and norms beside the mean; and the squared norm."""

    coordinates: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, blocks: int) -> Blocks:
        bounds = np.linspace(0, rows.shape[1], blocks + 1).astype(np.int64)
        sizes = np.diff(bounds).astype(np.float64)
        values = rows.astype(np.float64)
        sums = np.add.reduceat(values, bounds[:-1], axis=1)
        apart = values - np.repeat(sums / sizes, np.diff(bounds), axis=1)
        beside = np.sqrt(np.add.reduceat(apart * apart, bounds[:-1], axis=1))
        return cls(np.hstack((sums / np.sqrt(sizes), beside)), (values * values).sum(1))

    def bound(self, other: Blocks) -> np.ndarray:
        """(rows, rows of other): what their squared distances are at least."""
        return (self.squares[:, None] + other.squares) * (1 - SLACK) - 2 * (self.coordinates @ other.coordinates.T)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


class Codebook:
    """Entries (k, width) of one position, with their blocks, coarse to fine."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width = entries.shape[1]
        self.counts = [n for n in (1 << i for i in range(width.bit_length())) if n == 1 or n < width]
        self.levels = [Blocks.of(entries, n) for n in self.counts]
        self.compared = 0

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each row's nearest entry, and the squared distance."""
        made = [self._nearest(rows[i : i + ROWS]) for i in range(0, len(rows), ROWS)]
        return tuple(np.concatenate(x) for x in zip(*made)) if made else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, left = np.full(len(rows), np.iinfo(np.int64).max), np.ones((len(rows), len(self.entries)), bool)
        for n, level in zip(self.counts, self.levels):
            low = Blocks.of(rows, n).bound(level)
            best = np.minimum(best, distance(rows, self.entries[low.argmin(1)]))
            left &= low <= best[:, None]
        row, entry = np.nonzero(left)
        exact = distance(rows[row], self.entries[entry])
        self.compared += len(row)
        first = np.searchsorted(row, np.arange(len(rows)))  # the nearest is never out, so every row has one left
        least = np.minimum.reduceat(exact, first)
        hits = np.flatnonzero(exact == least[row])
        _, once = np.unique(row[hits], return_index=True)  # entries ascend within a row
        return entry[hits[once]], least


def cut(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    width = rows.shape[1] // parts
    return [rows[:, p * width : (p + 1) * width] for p in range(parts)]


def assigned(rows: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) numbers of entries, and each row's squared distances added up."""
    codes, errors = np.empty((len(rows), len(books)), np.int64), np.zeros(len(rows), np.int64)
    for p, (part, book) in enumerate(zip(cut(rows, len(books)), books)):
        codes[:, p], d = book.nearest(part)
        errors += d
    return codes, errors


def fit(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) over all usable rows; None if there are none."""
    kept = vectors.where(usable(F.col(vector))).select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    head = kept.where(F.size("vector") % parts == 0).orderBy(*order).limit(1).collect()
    if not head:
        return None
    length = len(head[0]["vector"])
    kept = kept.where(F.size("vector") == length)
    seeds = pa.array([r["vector"] for r in kept.orderBy(*order).limit(entries).collect()], pa.list_(pa.float64()))
    books = np.stack(cut(integers(seeds, length), parts))
    for _ in range(rounds):
        for r in _totals(kept.select("vector"), books).collect():  # one row for each entry
            books[r["part"], r["entry"]] = [x // r["n"] for x in r["sums"]]
    return books


def _totals(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): how many parts each entry is nearest to, and their sums by component."""
    workers_find_package(vectors.sparkSession)
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Codebook(b) for b in shared.value]
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in (part for whole in batches for part in pieces(whole)):
            for p, rows in enumerate(cut(integers(batch.column("vector"), parts * width), parts)):
                at, _ = known[p].nearest(rows)
                n[p] += np.bincount(at, minlength=entries)
                np.add.at(sums[p], at, rows)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    added = vectors.mapInArrow(add, "part int, entry int, n bigint, sums array<bigint>")
    each = added.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return each.groupBy("part", "entry").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("sums"))


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding") -> DataFrame:
    """vectors' usable rows of the codebooks' length, with code (two hex digits a part) and error, without the vector."""
    parts, _, width = books.shape
    workers_find_package(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kept = others(vectors, "code", "error", vector)
    rows = vectors.where(usable(F.col(vector)) & (F.size(vector) == parts * width)).select(boxed(kept), F.col(vector).alias("__vector"))

    def batch(b: pa.RecordBatch) -> list:
        codes, errors = assigned(integers(b.column("__vector"), parts * width), [Codebook(x) for x in shared.value])
        digits = codes.astype(np.uint8).tobytes().hex()
        return [[digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], errors]

    return arrow_map(rows, "code string, error bigint", batch, ["__row"]).select(*unboxed(kept), "code", "error")


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", out: str = "decoded") -> DataFrame:
    """codes with the vectors that their entries make."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def batch(b: pa.RecordBatch) -> list:
        return [[None if x is None else np.concatenate([shared.value[p, e] for p, e in enumerate(bytes.fromhex(x))]) / SCALE for x in b.column(code).to_pylist()]]

    return arrow_map(codes, f"`{out}` array<double>", batch)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", **sizes) -> DataFrame:
    """encode's rows with label_error (errors added up over equal labels, nulls together) and codebooks_sha256."""
    books = fit(vectors, vector, vec_id, **sizes)
    kept = others(vectors, "code", "error", "label_error", "codebooks_sha256", vector)
    if books is None:
        return vectors.where("false").select(*kept, F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    found = encode(vectors.select(boxed(kept), F.col(label).alias("__label"), F.col(vector).alias("__given")), books, "__given")
    found = materialize(found, "vector_codes")
    sums = materialize(found.groupBy(F.col("__label").alias("__same")).agg(F.sum("error").alias("label_error")), "vector_labels")
    # Beyond the bound a plain equi-join, which adaptive execution splits where a label is hot.
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return found.join(sums, F.col("__label").eqNullSafe(F.col("__same"))).select(*unboxed(kept), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
