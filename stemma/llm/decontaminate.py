"""Benchmark passages in documents by Wu-Manber multi-pattern search.

Documents and benchmark items become words with one space around each, as bytes. A pattern is a window of WINDOW
consecutive words of an item with its outer spaces (an item of fewer words is one pattern), so a pattern begins and ends
at a word. Of every pattern the first m bytes are searched, m being the shortest pattern's length of its class of lengths:

* A shift table tells for each block of bytes how far the search may move on because no pattern has the block nearer to
  byte m. Where the block is that of a pattern's end (shift zero) there may be an occurrence; all else is skipped.
* Suffix-hash buckets hold the patterns by that last block; the bucket's patterns whose first and last block are those of
  the text are test strings.
* Direct comparison of all the pattern's bytes confirms an occurrence.

The text of an Arrow batch is cut into lanes whose cursors move at the same time, each by its own shifts.

The benchmark goes to tasks in blocks of items of BLOCK_CHARS characters or one larger item, so what is broadcast is
bounded; a benchmark of one block takes one pass over the documents and no shuffle, a larger one a pass for each block,
whose narrow findings meet by the texts' SHA-256. Results are those of one block.

Null, empty and wordless texts have no words and nothing found; an item without words has no windows. A null item id counts as the empty id; rows with one id are one item. Very long texts are searched whole,
lane by lane. Repeated documents each have their row; other columns may have any names, those named as an output are
replaced. Without items nothing is found, without documents no row is made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import arrow_map, boxed, others, unboxed, workers_find_package
from stemma.sources.shared import materialize

WINDOW = 10
#: Characters of benchmark items that make one broadcast.
BLOCK_CHARS = 4 << 20
#: Lengths from which a class of patterns begins, with the bytes of its blocks; every pattern has three bytes.
CLASSES = [(3, 3), (16, 8), (32, 8)]
#: Bytes of a pattern that are searched at most; bytes of a lane; bits of a shift table.
LONGEST, LANE, MOST_BITS = 64, 2048, 22
PAD = b"\n" * 8
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that aren't part of a word become spaces, capital letters small ones.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def patterns_of(text: str | None, window: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    last = max(1, len(words) - window + 1) if words else 0
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(last)}


def _eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


@dataclass
class Search:
    """The tables of one class of patterns."""

    block: int
    length: int
    shift: np.ndarray
    #: By bucket: the suffix blocks' hashes in order, where each pattern lies in data, its length and its number.
    buckets: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    numbers: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, patterns: list[bytes], numbers: list[int], block: int) -> Search:
        lengths = np.fromiter(map(len, patterns), np.int64, len(patterns))
        m = min(LONGEST, int(lengths.min()))
        data = np.frombuffer(b"".join(patterns) + PAD, np.uint8)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        bits = min(MOST_BITS, max(12, int(8 * len(patterns) * (m - block + 1)).bit_length()))
        made = cls(block, m, np.full(1 << bits, m - block + 1, np.uint8), np.empty(0), starts, lengths, np.array(numbers, np.int64), data)
        ends = np.concatenate((np.frombuffer(PAD, np.uint8), data))
        for j in range(m - block + 1):  # nearer to the end means a smaller shift, which replaces a larger one
            made.shift[made._hash(_eights(ends)[starts + j + block])] = m - block - j
        at = made._hash(_eights(ends)[starts + m])
        order = np.argsort(at, kind="stable")
        made.buckets, made.starts, made.lengths, made.numbers = at[order], starts[order], lengths[order], made.numbers[order]
        return made

    def _hash(self, eight: np.ndarray) -> np.ndarray:
        """Of the last bytes of eight, a block of them."""
        bits = len(self.shift).bit_length() - 1
        return ((eight >> np.uint64(64 - 8 * self.block)) * _ODD) >> np.uint64(64 - bits)

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """Places of the last searched byte of what may be an occurrence. text: with PAD on both sides."""
        eights = _eights(text)
        at = np.arange(8, len(text) - 8, LANE)
        stop = np.minimum(at + LANE, len(text) - 8)
        found = []
        while len(at):
            moved = self.shift[self._hash(eights[at - 7])]
            here = moved == 0
            if here.any():
                found.append(at[here])
            at = at + np.maximum(moved, 1)
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)

    def occurrences(self, text: np.ndarray) -> tuple[list[int], list[int]]:
        """(start, number of the pattern) of every occurrence in text."""
        at = self.candidates(text)
        eights, mine, m = _eights(text), _eights(np.concatenate((np.frombuffer(PAD, np.uint8), self.data))), self.length
        at = at[at >= m + 7]
        hashed = self._hash(eights[at - 7])
        low, high = np.searchsorted(self.buckets, hashed), np.searchsorted(self.buckets, hashed, "right")
        n = high - low
        at, entry = np.repeat(at, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cut = np.uint64(64 - 8 * self.block)
        head = self.starts[entry]
        same = (eights[at - 7] >> cut == mine[head + m] >> cut) & (eights[at - m + 1] << cut == mine[head + 8] << cut)
        begin, entry = at[same] - m + 1, entry[same]
        whole, known = memoryview(text), memoryview(self.data)
        starts, numbers = [], []
        for s, o, size, number in zip(begin.tolist(), self.starts[entry].tolist(), self.lengths[entry].tolist(), self.numbers[entry].tolist()):
            if whole[s : s + size] == known[o : o + size]:
                starts.append(s)
                numbers.append(number)
        return starts, numbers


@dataclass
class Patterns:
    """All patterns of a block of items: the searches, each pattern's words and the items that have it."""

    searches: list[Search]
    sizes: np.ndarray
    first: np.ndarray
    items: np.ndarray
    ids: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int = WINDOW) -> Patterns:
        """items: (id, text)."""
        having: dict[bytes, set[int]] = {}
        ids = sorted({i for i, _ in items})
        place = {i: n for n, i in enumerate(ids)}
        for i, text in items:
            for p in patterns_of(text, window):
                having.setdefault(p, set()).add(place[i])
        known = list(having)
        searches = []
        for (least, block), (limit, _) in zip(CLASSES, CLASSES[1:] + [(1 << 62, 0)]):
            if mine := [n for n, p in enumerate(known) if least <= len(p) < limit]:
                searches.append(Search.of([known[n] for n in mine], mine, block))
        held = [sorted(having[p]) for p in known]
        first = np.concatenate(([0], np.cumsum([len(h) for h in held], dtype=np.int64)))
        return cls(searches, np.array([p.count(b" ") - 1 for p in known], np.int64), first, np.array([x for h in held for x in h], np.int64), ids)

    def find(self, texts: list[str | None]) -> list[tuple[int, list, list]]:
        """For each text its number of words, the spans of words (from, to) that are hit, and the ids of items found."""
        split = [words_of(t) for t in texts]
        joined = [b" " + b" ".join(w) + b" " if w else b" " for w in split]
        text = np.frombuffer(PAD + b"\n".join(joined) + PAD, np.uint8)
        begins = np.cumsum([8, *(len(x) + 1 for x in joined)])
        met: dict[int, list[tuple[int, int]]] = {}
        for search in self.searches:
            starts, numbers = search.occurrences(text)
            for doc, start, number in zip((np.searchsorted(begins, starts, "right") - 1).tolist(), starts, numbers):
                met.setdefault(doc, []).append((start, number))
        out = [(len(w), [], []) for w in split]
        for doc, found in met.items():
            spaces = np.flatnonzero(np.frombuffer(joined[doc], np.uint8) == 32)
            low = np.searchsorted(spaces, np.array([s for s, _ in found]) - begins[doc])
            numbers = np.array(sorted({n for _, n in found}))
            items = np.unique(np.concatenate([self.items[self.first[n] : self.first[n + 1]] for n in numbers.tolist()]))
            out[doc] = (len(split[doc]), merged(zip(low.tolist(), (low + self.sizes[[n for _, n in found]]).tolist())), [self.ids[i] for i in items.tolist()])
        return out


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


FOUND = "n_words bigint, spans array<struct<low:bigint,high:bigint>>, items array<string>"


def _searched(docs: DataFrame, items: list[tuple[str, str]], window: int, keep: list[str]) -> DataFrame:
    workers_find_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Patterns.of(items, window))  # BLOCK_CHARS of items

    def batch(b: pa.RecordBatch) -> list:
        return list(map(list, zip(*shared.value.find(b.column("__text").to_pylist()))))

    return arrow_map(docs, FOUND, batch, keep)


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the text, with n_words, spans (words that are hit, as [low, high)) and items (ids, sorted)."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.char_length("text") + 1), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * chars // block_chars)) if chars > block_chars else 1  # half full on average, so that none overflows
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    block = lambda i: [(r["id"], r["text"]) for r in rows.where(part == i).distinct().collect()]
    kept = others(docs, "n_words", "spans", "items", text)
    given = docs.select(boxed(kept), F.col(text).alias("__text"))
    shown = [*unboxed(kept), "n_words", "spans", "items"]
    if n == 1:
        return _searched(given, block(0), window, ["__row"]).select(shown)
    digest = F.sha2(F.coalesce(F.col("__text"), F.lit("")), 256).alias("__digest")
    given = given.select("*", digest)
    base = materialize(_searched(given, block(0), window, ["__row", "__digest"]), "decontaminate_rows")
    more = None
    for i in range(1, n):
        found = _searched(given.select("__text", "__digest"), block(i), window, ["__digest"]).where("size(spans) > 0").dropDuplicates(["__digest"])
        found = materialize(found.select("__digest", "spans", "items"), "decontaminate_block")
        more = found if more is None else more.union(found)
    met = more.groupBy("__digest").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))
    both = base.join(met, "__digest", "left")

    def batch(b: pa.RecordBatch) -> list:
        lists = lambda c: [x or [] for x in b.column(c).to_pylist()]
        spans = [merged((s["low"], s["high"]) for s in x + y) for x, y in zip(lists("spans"), lists("__spans"))]
        return [b.column("n_words"), spans, [sorted({*x, *y}) for x, y in zip(lists("items"), lists("__items"))]]

    return arrow_map(both, FOUND, batch, ["__row"]).select(shown)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs' rows without any benchmark passage, with docs' columns."""
    found = search(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__doc")), benchmark, text="__doc", **options)
    return found.where("size(spans) = 0").select("__row.*")
