"""A bit filter sized by its keys, to split rows into those that may have a key and those that surely have none."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most bits of a filter that is broadcast: 2**18 words of 16 bytes with their hash table.
SPARSE, MOST_BITS = 16, 24


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    at = F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    return F.shiftright(at, 6), at.bitwiseAND(63).cast("int")


class BitFilter:
    """The filter of a table's keys. Where MOST_BITS would be too crowded, split joins with the keys themselves instead."""

    def __init__(self, keys: DataFrame, key: str, most_bits: int = MOST_BITS):
        self.keys, self.key = keys.select(key), key
        self.n = self.keys.count()
        self.bits = max(10, ceil(log2(SPARSE * max(1, self.n))))
        self.exact = self.bits > most_bits

    def words(self) -> DataFrame:
        """(word, bits), one row for 64 places at most."""
        word, bit = _place(F.col(self.key), self.bits)
        return self.keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))

    def split(self, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """rows that may have one of the keys, and those that have none. A row with null as key has none."""
        if self.n == 0:
            return rows.where("false"), rows
        if self.exact:
            known = self.keys.select(F.col(self.key).alias("__known")).distinct()
            met = F.col(key) == F.col("__known")
            return rows.join(known, met, "left_semi"), rows.join(known, met, "left_anti")
        word, bit = _place(F.col(key), self.bits)
        marked = rows.withColumns({"__at": word, "__bit": bit}).join(F.broadcast(self.words()), F.col("__at") == F.col("__word"), "left")
        hit = F.coalesce(F.expr("shiftright(__bits, __bit) & 1 = 1"), F.lit(False)) & F.col(key).isNotNull()
        return marked.where(hit).select(rows.columns), marked.where(~hit).select(rows.columns)
