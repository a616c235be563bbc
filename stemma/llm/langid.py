"""Language of whole texts: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lower-cased, everything but letters becomes one space, and its character n-grams (n in NGRAMS, none across a
space) are hashed into BUCKETS rows of an embedding table; their mean goes through a linear softmax. Both tables are
trained by stochastic gradient descent in numpy on the driver, on a bounded sample of labelled rows: every label has up
to SAMPLE rows, fewer if all labels together would have more than ROWS, but one at least. Rows are chosen by a hash of
the id and the text; of a text longer than SAMPLE_CHARS a piece of that length counts, from a place that the hash gives.
The sample's texts are cut at spaces into pieces of several lengths, so that short texts are known too. A part of the
sample that training doesn't see (every fifth text of a label) sets the temperature and the rejection bound: the share
REJECT of known texts falls below it.

Null, empty and letterless texts are `und` with score 0. Repeated rows are predicted each for itself; in the sample they
stay or go together, and count as often as they are there. Prediction reads the text only. With no labelled row at all
every text is `und`. Columns of the input with the name of an output are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import arrow_map, workers_find_package
from stemma.sources.shared import materialize

NGRAMS, BUCKETS, WIDTH = (1, 2, 3, 4), 1 << 16, 12
SAMPLE, ROWS, SAMPLE_CHARS, PIECES = 600, 20_000, 8000, (12, 40, 150, 600, 3000)
EPOCHS, RATE = 4, 0.5
#: Share of known texts of 20 letters and more that may be rejected, and the confidence that is never rejected.
REJECT, SURE = 0.0005, 0.5
#: Characters hashed at a time.
SPAN = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subwords(text: str) -> np.ndarray:
    """Buckets of the text's n-grams; empty if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 32).astype(np.uint32)
    space = codes == 32
    codes = codes[~(space & np.concatenate(([False], space[:-1])))] if len(codes) else codes
    if not (codes != 32).any():
        return np.empty(0, np.int32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    space = codes == 32
    out = []
    for n in NGRAMS:
        if len(codes) < n:
            break
        m = len(codes) - n + 1
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        whole = np.ones(m, bool)
        for i in range(n):
            h = (h ^ codes[i : i + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            if 0 < i < n - 1 or n == 1:
                whole &= ~space[i : i + m]
        out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int32)[whole])
    return np.concatenate(out)


@dataclass
class Model:
    labels: list[str]
    #: The embeddings, BUCKETS x WIDTH; for fewer labels than WIDTH times the output layer, as nothing lies between them.
    table: np.ndarray
    #: WIDTH x labels, or None if table has it.
    out: np.ndarray | None
    bias: np.ndarray
    temperature: float
    bound: float

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(self.table.shape[1]), 0
        for at in range(0, len(text), SPAN):
            found = subwords(text[at : at + SPAN])
            if len(found):
                total += self.table[found].sum(0, dtype=np.float64)
                n += len(found)
        if not n:
            return None
        return (total / n if self.out is None else total / n @ self.out) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text and self.labels else None
        if z is None:
            return "und", 0.0
        p = _softmax(z / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _cut(text: str, length: int) -> str:
    """The first words of the text up to about length characters."""
    end = text.find(" ", length)
    return text if end < 0 else text[:end]


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Trains on texts with their labels; every fifth text of a label only calibrates."""
    names = sorted(set(labels))
    index = {name: i for i, name in enumerate(names)}
    rng = np.random.default_rng(seed)
    train, held = [], []
    nth = dict.fromkeys(names, -1)
    for text, label in zip(texts, labels):
        nth[label] += 1
        for length in PIECES:
            at = int(rng.integers(0, max(1, len(text) - length)))
            piece = _cut(text[at and text.find(" ", at) + 1 :], length)
            if len(found := subwords(piece)):
                (held if nth[label] % 5 == 4 else train).append((*np.unique(found, return_counts=True), len(found), index[label]))
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, max(1, len(names)))).astype(np.float32), np.zeros(max(1, len(names)), np.float32)
    steps = EPOCHS * max(1, len(train))
    for step in range(EPOCHS * len(train)):
        if step % len(train) == 0:
            order = rng.permutation(len(train))
        buckets, counts, n, label = train[order[step % len(train)]]
        share = (counts / n).astype(np.float32)
        mean = share @ embed[buckets]
        error = _softmax(mean @ out + bias).astype(np.float32)
        error[label] -= 1
        rate = np.float32(RATE * (1 - step / steps))
        back = out @ error
        out -= rate * np.outer(mean, error)
        bias -= rate * error
        # Each n-gram of the text moves the table by its share; the scale makes up for the shares' smallness.
        embed[buckets] -= rate * np.minimum(share * 50, 1)[:, None] * back
    z = [(c / n) @ embed[b] @ out + bias for b, c, n, _ in held]
    right = [label for *_, label in held]
    losses = {t: -sum(np.log(max(_softmax(x / t)[y], 1e-12)) for x, y in zip(z, right)) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    temperature = min(losses, key=losses.get) if held else 1.0
    sure = sorted(float(_softmax(x / temperature).max()) for x, (_, _, n, _) in zip(z, held) if n >= 60)
    bound = min(SURE, sure[int(REJECT * len(sure))]) if sure else 0.0
    few = len(names) < WIDTH
    return Model(names, embed @ out if few else embed, None if few else out, bias, temperature, bound)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on rows of every label, sample of each at most. docs: the rows that may be learned from."""
    spare = F.char_length(text) - SAMPLE_CHARS
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("h"), spare.alias("spare"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("place", F.col("h").bitwiseAND(2**63 - 1))
    # Rows that agree in id and text count once; the first place is taken anyhow, as a label's number of rows is estimated.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("place").alias("least"))
    counts = materialize(counts, "langid_counts")
    n = counts.count()
    if not n:
        return fit([], [])
    sample = max(1, min(sample, ROWS // n))
    # A label's share of the hash range holds twice the sample; so a scan sends the driver no more than that, however many
    # tasks it has. One row a label is broadcast, as the model is.
    share = F.least(F.lit(float(2**63 - 1024)), F.lit(2.0**64 * sample) / F.col("n")).cast("long")
    bounds = counts.select("lang", F.when(F.col("n") <= sample, 2**63 - 1).otherwise(F.greatest(share, F.col("least"))).alias("bound"))
    piece = F.when(F.col("spare") > 0, F.col("text").substr((1 + F.pmod("h", F.col("spare") + 1)).cast("int"), F.lit(SAMPLE_CHARS))).otherwise(F.col("text"))
    chosen = rows.join(F.broadcast(bounds), "lang").where("place <= bound").select("h", "lang", piece.alias("text"))
    mine = defaultdict(list)
    for r in chosen.dropDuplicates(["h", "lang"]).collect():
        mine[r["lang"]].append((r["h"], r["text"]))
    texts, labels = [], []
    for name in sorted(mine):
        found = sorted(mine[name])[:sample]
        texts += [t for _, t in found]
        labels += [name] * len(found)
    return fit(texts, labels)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the columns out: the language, the calibrated probability, and whether the text is rejected (no letters,
    or a probability below the bound)."""
    workers_find_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + labels rows of WIDTH numbers at most, whatever the input

    def batch(b: pa.RecordBatch) -> list:
        m = shared.value
        found = [m.predict(x.as_py()) for x in b.column(text)]
        return [[x for x, _ in found], [min(1.0, p) for _, p in found], [x == "und" or p < m.bound for x, p in found]]

    return arrow_map(docs, f"`{out[0]}` string, `{out[1]}` double, `{out[2]}` boolean", batch, keep)
