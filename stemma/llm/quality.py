"""Quality rules: repetition counts, and distances of a text's histograms to references of the corpus's languages.

Two histograms describe a text: its characters by class, and its words by the common words of a language (all others are
one class). The references are the same histograms over all rows of each language, counted in one aggregation over the
whole table. A text is far off if the Jensen-Shannon distance to the nearest language's reference is above a bound, in
either histogram. A histogram of few items says little: below a minimum length it is not judged.

Null and empty texts have no words and fail by the base rule. Very long texts are counted whole. Repeated rows are judged each
for itself and count each in the references; of common words with equal counts the smaller ones are taken. Rows without a language make no reference; if no row has
one, only the base rule decides. Columns of the input with the name of an output are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import arrow_map, workers_find_package

#: The base rule.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
CLASSES = ("space", "lower", "upper", "letter", "digit", "sentence", "symbol", "other")
SENTENCE = ".,;:!?'\"-()"
COMMON = 50
#: Bounds of the distances, and how many characters or words a histogram needs.
MOST_BY_CLASS, LEAST_CHARS = 0.26, 400
MOST_BY_WORD, LEAST_JUDGED = 0.47, 40
#: Distinct words that a task holds before it hands their counts on.
HELD = 200_000


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    def of(i: int) -> int:
        c = chr(i)
        if c.isspace():
            return 0
        if c.islower():
            return 1
        if c.isupper():
            return 2
        if c.isalpha():
            return 3
        if c.isdecimal():
            return 4
        if c in SENTENCE:
            return 5
        return 6 if i < 128 else 7

    return np.fromiter(map(of, range(0x110000)), np.uint8, 0x110000)


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_class_table()[codes], minlength=len(CLASSES))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    length = 1
    while length < window:  # numbers of sequences of one length, then of twice the length
        step = min(length, window - length)
        m = len(ids) - step
        _, ids = np.unique(ids[:m] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)
        length += step
    often = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(often), 1)
    np.add.at(covered, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(raw.count(x) for x in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    symbols = sum(raw.count(x.encode()) for x in SYMBOLS)
    seen: set[bytes] = set()
    doubled = 0
    for line in raw.split(b"\n"):
        if line in seen:
            doubled += 1
        elif line.strip():
            seen.add(line)
    repeated = repeated_words(words)
    return len(words), chars, symbols, doubled, repeated, len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)


@dataclass
class Reference:
    classes: np.ndarray
    words: dict[bytes, int]
    shares: np.ndarray


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence, base 2: 0 for equal distributions, 1 for disjoint ones."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda x: float(np.where(x > 0, x * np.log2(x / m), 0.0).sum())
        return max(0.0, (kl(p) + kl(q)) / 2) ** 0.5


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, Reference]:
    """The references of all languages of docs: a few numbers and COMMON words for each."""
    workers_find_package(docs.sparkSession)

    def count(batches):
        held: dict[tuple[str, str, bytes], int] = Counter()

        def rows():
            keys = list(held)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.binary()), pa.array([held[k] for k in keys], pa.int64())], names=["lang", "kind", "item", "n"])
            held.clear()
            return out

        for batch in batches:
            for x, y in zip(batch.column("text"), batch.column("lang")):
                label, body = y.as_py(), x.as_py()
                for name, n in zip(CLASSES, class_counts(body)):
                    held[label, "class", name.encode()] += int(n)
                for word, n in Counter(body.encode("utf-8", "surrogatepass").lower().split()).items():
                    held[label, "word", word] += n
                if len(held) > HELD:
                    yield rows()
        if held:
            yield rows()

    found = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = found.mapInArrow(count, "lang string, kind string, item binary, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    # The total of a language's words is asked for together with its most common ones: the classes don't tell it.
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    top = counts.withColumn("place", place).where(F.col("place") <= COMMON).join(totals, ["lang", "kind"]).orderBy("lang", "kind", "place").collect()
    made: dict[str, Reference] = {}
    for label in sorted({r["lang"] for r in top}):
        mine = [r for r in top if r["lang"] == label]
        by_class = {bytes(r["item"]).decode(): r["n"] / max(1, r["total"]) for r in mine if r["kind"] == "class"}
        words = [r for r in mine if r["kind"] == "word"]
        shares = np.array([r["n"] / r["total"] for r in words])
        made[label] = Reference(np.array([by_class.get(c, 0.0) for c in CLASSES]), {bytes(r["item"]): i for i, r in enumerate(words)}, np.append(shares, max(0.0, 1 - shares.sum())))
    return made


def distances(text: str, refs: list[Reference]) -> tuple[float | None, float | None]:
    """By class and by word, to the nearest reference each; None where the text is too short to judge."""
    by_class = by_word = None
    counts = class_counts(text)
    if refs and counts.sum() >= LEAST_CHARS:
        by_class = min(js_distance(counts / counts.sum(), r.classes) for r in refs)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if refs and len(words) >= LEAST_JUDGED:
        tally = Counter(words)
        for r in refs:
            p = np.zeros(len(r.words) + 1)
            for w, i in r.words.items():
                p[i] = tally.get(w, 0)
            p[-1] = len(words) - p.sum()
            d = js_distance(p / len(words), r.shares)
            by_word = d if by_word is None else min(by_word, d)
    return by_class, by_word


def judge(docs: DataFrame, refs: dict[str, Reference], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the base counts, class_distance and word_distance (null: not judged) and kept."""
    workers_find_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(list(refs.values()))  # COMMON words for each language

    def batch(b: pa.RecordBatch) -> list:
        out = []
        for x in b.column(text):
            body = x.as_py()
            base = base_counts(body)
            by_class, by_word = distances(body or "", shared.value)
            far = (by_class or 0.0) > MOST_BY_CLASS or (by_word or 0.0) > MOST_BY_WORD
            out.append((*base, by_class, by_word, not (base[-1] or far)))
        return list(map(list, zip(*out)))

    return arrow_map(docs, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, class_distance double, word_distance double, kept boolean", batch, keep)
