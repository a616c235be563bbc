"""Language-model scores by a weighted backoff automaton of smoothed word n-grams (order three).

The automaton has the root, which knows no history; a state for each word seen in training and for the start of a text;
and a state for each pair of words seen LEAST times or more. A state h with count c(h) has an arc for each word w that
followed it, of weight (c(hw) + mu p(w|h')) / (c(h) + mu), and a failure arc of weight mu / (c(h) + mu) to h', the state
without h's first word; mu is the order's of MU. The root's arcs have p(w) = (c(w) - d) / N, and what the discount d
takes off is p of the unknown word, so that every state's weights add up to one. d comes from the numbers of words seen
once and twice. A text is read once from left to right: from the state that its last words lead to, a token follows its
arc, or else failure arcs, until a state has one; the logarithms of the weights on the way add up.

Nothing of the model is held in one place, as it grows with the corpus:
1. Texts are packed into blocks of about BLOCK_BYTES: the block's distinct words as hashes, and its tokens as numbers.
2. Each block sends its distinct words, pairs and triples as hashes, with their training counts, to shards of the hash
   range. A block has a key once however frequent it is, so shards are even; their number grows with the corpus.
3. Each shard adds up its keys' counts over all blocks and sends every block the totals in the order it sent the keys.
4. Each block thereby has the part of the automaton that its texts can reach, and scores them.
A block sends to 2**FAN ranges at most. Where the corpus needs more shards, what some 2**FAN blocks sent to one range is
merged into one block of the next level, which sends to the next bits' ranges and hands its totals down again: messages
stay as many as the blocks times a constant and each level, whatever the corpus. A level writes all keys and totals once
more, so there is one as long as its messages are of some hundred words, up to 2**FAN * SHARD_BYTES of text.

Words are keyed by 64 bits of hash: two words of a corpus share one with a chance of about V * V / 2**65. Pairs and
triples are keyed by KEY_BITS more bits than it takes to number the tokens, 64 at most: a key shares its place with
another one with a chance of 2**-KEY_BITS.
Null and empty texts are the end token alone. Null ids are in the fold of the empty id. Repeated rows are scored and
counted each. Without any training row both scores are zero. Columns other than id and text play no part. A very long
text is a block of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stemma.llm.common import pieces, workers_find_package
from stemma.sources.shared import materialize

BLOCK_BYTES, SHARD_BYTES, FAN = 8 << 20, 12 << 20, 12
#: Smoothing of the states of one word and of two; how often a pair was seen to be a state.
MU, LEAST = (500.0, 8.0), 2
KEY_BITS = 20
END, START = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
ORDERS = ("words", "pairs", "triples")


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte of their significance, so that the high zeros compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _packed(x: np.ndarray) -> bytes:
    """The integers, 64 bits each, compressed; their number first."""
    return len(x).to_bytes(8, "little") + (pa.compress(_planes(x), codec="zstd", asbytes=True) if len(x) else b"")


def _unpacked(raw: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return _from_planes(pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), kind) if n else np.empty(0, kind)


def pack(docs: DataFrame, text: str, doc_id: str, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (block, bytes, n_tokens, ids, held, words: hashes, tokens: places among words; 0 ends a text)."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([*T.StructType.fromDDL("block bigint, bytes bigint, n_tokens bigint"), T.StructField("ids", T.ArrayType(id_type)), *T.StructType.fromDDL("held array<boolean>, words binary, tokens binary")])
    id_arrow = to_arrow_type(id_type)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), held_out.alias("held"))

    def run(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, held, said, size = [], [], [], 0
        places = defaultdict(count(1).__next__)
        ends = np.zeros(1, np.uint32)

        def block():
            nonlocal made, size
            words = np.fromiter((END, *map(xxhash.xxh64_intdigest, places)), np.uint64, len(places) + 1)
            tokens = np.concatenate(said).astype(np.uint64)
            cells = [pa.array([x]) for x in (first + made, size, len(tokens))]
            out = pa.RecordBatch.from_arrays([*cells, pa.array([ids], pa.list_(id_arrow)), pa.array([held], pa.list_(pa.bool_())), pa.array([_packed(words)], pa.binary()), pa.array([_packed(tokens)], pa.binary())], names=schema.names)
            made, size = made + 1, 0
            for x in (ids, held, said, places):
                x.clear()
            places.default_factory = count(1).__next__
            return out

        for batch in (part for whole in batches for part in pieces(whole)):
            for i, body, fold in zip(*(batch.column(n).to_pylist() for n in ("id", "text", "held"))):
                words = (body or "").encode("utf-8", "surrogatepass").lower().split()
                ids.append(i)
                held.append(fold)
                said.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                said.append(ends)
                size += len(body or "") + 1
                if size >= block_bytes:
                    yield block()
        if ids:
            yield block()

    return rows.mapInArrow(run, schema)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a * np.uint64(0x9E3779B185EBCA87) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


class Block:
    """One block's tokens and their n-grams as hashes. A text's first token has no triple; its key is that of the pair."""

    def __init__(self, row: dict, width: int):
        self.hashes = _unpacked(row["words"], np.uint64)
        self.numbers = _unpacked(row["tokens"], np.uint64).astype(np.uint32)
        self.width = width
        stops = np.flatnonzero(self.numbers == 0)
        self.lengths = np.diff(stops, prepend=-1)
        self.starts = stops - self.lengths + 1
        self.held = np.array(row["held"], bool)

    def keys(self, order: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of an order, ascending, and each token's place among them."""
        if order == "words":  # two words with one hash are one key
            words, place = np.unique(self.hashes, return_inverse=True)
            return words, place.astype(np.uint32)[self.numbers]
        tokens = self.hashes[self.numbers]
        found = _mix(np.concatenate((np.zeros(1, np.uint64), tokens[:-1])), tokens)
        found[self.starts] = _mix(np.full(len(self.starts), START, np.uint64), tokens[self.starts])
        if order == "triples":
            first = found[self.starts]
            found = _mix(np.concatenate((np.zeros(1, np.uint64), found[:-1])) ^ np.uint64(0x27D4EB2F165667C5), tokens)
            found[self.starts] = first
        found >>= np.uint64(64 - self.width)
        distinct, place = np.unique(found, return_inverse=True)
        return distinct, place.astype(np.uint32)

    def counted(self, order: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys and their training counts."""
        keys, place = self.keys(order)
        return keys, np.bincount(place[np.repeat(~self.held, self.lengths)], minlength=len(keys)).astype(np.int64)


#: A message: the keys of each order in steps, and their counts.
MESSAGE = "shard bigint, block bigint, " + ", ".join(f"{o} binary, n_{o} binary" for o in ORDERS)
#: Its answer: the total counts in the order of the keys; or, without block, a shard's sums over words.
ANSWER = "shard bigint, block bigint, " + ", ".join(f"n_{o} binary" for o in ORDERS) + ", total bigint, distinct bigint, once bigint, twice bigint"
SUMS = ("total", "distinct", "once", "twice")


ARROW = {"bigint": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _split(block: int, found: dict[str, tuple[np.ndarray, np.ndarray]], widths: dict[str, int], bits: int):
    """The messages of a block's (keys, counts) of each order, by the keys' first bits."""
    shards, cuts = set(), {}
    for o, (keys, _) in found.items():
        shard = (keys >> np.uint64(widths[o] - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        named, at = np.unique(shard, return_index=True)
        cuts[o] = dict(zip(named.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(keys)])))
        shards.update(cuts[o])
    for shard in sorted(shards):
        cells = []
        for o, (keys, n) in found.items():
            at, to = cuts[o].get(shard, (0, 0))
            cells += [_packed(np.diff(keys[at:to], prepend=np.uint64(0))), _packed(n[at:to])]
        yield _batch(MESSAGE, [(shard, block, *cells)])


def _heard(table: pa.Table) -> tuple[list[int], dict[str, tuple[np.ndarray, np.ndarray, list[np.ndarray]]]]:
    """The blocks of some messages, in order, and by order: the distinct keys, their total counts, each block's places."""
    made = {}
    for o in ORDERS:
        keys = [np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column(o)]
        n = [_unpacked(x.as_py()) for x in table.column(f"n_{o}")]
        lengths = [len(k) for k in keys]
        keys = np.concatenate(keys)
        distinct, place = np.unique(keys, return_inverse=True)
        place = place.astype(np.uint32)
        total = np.bincount(place, np.concatenate(n), len(distinct)).astype(np.int64)
        made[o] = distinct, total, np.split(place, np.cumsum(lengths)[:-1])
    return table.column("block").to_pylist(), made


def _answers(shard: int, blocks: list[int], totals: dict[str, np.ndarray], places: dict[str, list[np.ndarray]]) -> list[tuple]:
    return [(shard, block, *(_packed(totals[o][places[o][i]]) for o in ORDERS), None, None, None, None) for i, block in enumerate(blocks)]


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(schema, rows)])


def _leaf(sent: DataFrame) -> DataFrame:
    def run(key, table):
        blocks, made = _heard(table)
        words = made["words"][1]
        sums = [int(x) for x in (words.sum(), (words > 0).sum(), (words == 1).sum(), (words == 2).sum())]
        rows = _answers(key[0].as_py(), blocks, {o: made[o][1] for o in ORDERS}, {o: made[o][2] for o in ORDERS})
        return _table(ANSWER, [*rows, (key[0].as_py(), None, None, None, None, *sums)])

    return sent.groupBy("shard").applyInArrow(run, ANSWER)


def add_up(sent: DataFrame, steps: list[int], widths: dict[str, int], blocks: int) -> DataFrame:
    """The answers to messages sent by steps[0] bits; steps: the bits of each level. blocks: how many sent to each shard."""
    if len(steps) == 1:
        return _leaf(sent)
    groups = -(-blocks // (1 << FAN))
    sent = materialize(sent.withColumn("merged", F.col("shard") * groups + F.pmod(F.xxhash64("block"), F.lit(groups))), "lm_messages")

    def merge(key, table):
        _, made = _heard(table)
        return pa.Table.from_batches(list(_split(key[0].as_py(), {o: made[o][:2] for o in ORDERS}, widths, steps[1])) or [_batch(MESSAGE, [])])

    below = add_up(sent.groupBy("merged").applyInArrow(merge, MESSAGE), steps[1:], widths, groups)
    below = materialize(below, "lm_answers")

    def hand_down(key, left, right):
        if not left.num_rows:
            return _table(ANSWER, [])
        names, made = _heard(left)
        totals = {o: _joined(right, o) for o in ORDERS}
        # A group has messages of one shard only.
        return _table(ANSWER, _answers(left.column("shard")[0].as_py(), names, totals, {o: made[o][2] for o in ORDERS}))

    answers = sent.groupBy("merged").cogroup(below.where("block IS NOT NULL").withColumnRenamed("block", "merged").groupBy("merged")).applyInArrow(hand_down, ANSWER)
    return answers.union(below.where("block IS NULL").select(below.columns))


def _joined(answers: pa.Table, order: str) -> np.ndarray:
    """One block's total counts, from its answers of all shards."""
    mine = sorted(zip(answers.column("shard").to_pylist(), answers.column(f"n_{order}").to_pylist()))
    return np.concatenate([np.empty(0, np.int64), *(_unpacked(n) for _, n in mine)])


def levels(size: int, shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> list[int]:
    """The bits of each level for a corpus of that size."""
    bits = max(0, int(np.ceil(np.log2(max(1, size / shard_bytes)))))
    n = max(1, -(-bits // fan))
    return [bits * (i + 1) // n - bits * i // n for i in range(n)]


def send_keys(blocks: DataFrame, bits: int, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                made = Block(row, width)
                yield from _split(row["block"], {o: made.counted(o) for o in ORDERS}, {"words": 64, "pairs": width, "triples": width}, bits)

    return blocks.drop("ids", "bytes").mapInArrow(run, MESSAGE)


def traverse(block: Block, totals: Callable[[str], np.ndarray], total: int, distinct: int, discount: float, mu: tuple[float, float] = MU, least: int = LEAST) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each of the block's documents; totals: its keys' total counts by order."""
    counts = []
    for o in ORDERS:
        keys, place = block.keys(o)
        mine = totals(o)
        counts.append(mine[place])
        if o == "words":
            at_end = mine[np.searchsorted(keys, np.uint64(END))]
    c, pair, triple = counts
    starts = block.starts
    base = np.log10((c + 1) / (total + distinct + 1))
    score = base
    if total:
        one = np.concatenate(([0], c[:-1]))  # the last word's count; a text's first token follows the start, seen once in each text
        one[starts] = at_end
        two = np.concatenate(([0], pair[:-1]))
        two[starts] = 0
        weight = np.where(c > 0, c - discount, discount * distinct) / total
        arcs, fails = [weight], [None]
        for followed, came, m in ((pair, one, mu[0]), (triple, two, mu[1])):
            weight = (followed + m * weight) / (came + m)
            arcs.append(np.where(followed > 0, weight, 0.0))
            fails.append(m / (came + m))
        # Where each token is read from, and down the failure arcs until a state has an arc for it.
        state = np.where(two >= least, 2, np.where(one > 0, 1, 0))
        score = np.zeros(len(c))
        for order in (2, 1, 0):
            here = state == order
            found = here & (arcs[order] > 0) if order else here
            score[found] += np.log10(arcs[order][found])
            lost = here & ~found
            if order:
                score[lost] += np.log10(fails[order][lost])
            state[found], state[lost] = -1, order - 1
    return [block.lengths, np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(score, starts)]


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", mu: tuple[float, float] = MU, least: int = LEAST, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; the model learns from
    the rows that aren't held out."""
    workers_find_package(docs.sparkSession)
    blocks = materialize(pack(docs, text, doc_id, held_out, block_bytes), "lm_blocks")
    size, tokens, n = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "n_tokens")), F.count(F.lit(1))).first()
    steps = levels(size, shard_bytes, fan)
    width = min(64, int(np.ceil(np.log2(tokens + 1))) + KEY_BITS)
    totals = materialize(add_up(send_keys(blocks, steps[0], width), steps, {"words": 64, "pairs": width, "triples": width}, n), "lm_totals")
    total, distinct, once, twice = totals.where("block IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in SUMS)).first()
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")])

    def run(key, left, right):
        out = []
        for i in range(left.num_rows):
            block = Block(left.drop_columns(["ids"]).slice(i, 1).to_pylist()[0], width)
            made = traverse(block, lambda o: _joined(right, o), total, distinct, discount, mu, least)
            out.append(pa.table([left.column("ids")[i].values, left.column("held")[i].values, *map(pa.array, made)], names=schema.names))
        return pa.concat_tables(out) if out else pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema]).empty_table()

    back = totals.where("block IS NOT NULL").drop(*SUMS)
    scored = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
