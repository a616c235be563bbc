"""The functions that need Python: Unicode normal forms and Jaro-Winkler similarity, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

PREFIX, SCALE = 4, 0.1


def plain(label: str | None) -> str | None:
    """Decomposed, without marks, lower-case, Latin letters and digits only."""
    if label is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.category(c).startswith("M"))
    return re.sub("[^a-z0-9]", "", bare.lower())


def locale_key(label: str) -> tuple[str, str, str]:
    """Sorts labels as a reader's locale does, as far as letters, then marks, then case (small first) go."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.category(c).startswith("M"))
    return bare.casefold(), unicodedata.normalize("NFKD", label).casefold(), label.swapcase()


def jaro(a: str, b: str) -> float:
    """Share of characters that match within a window, less half the transpositions (which may be half of an odd number)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    mine = []
    for i, c in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if at is not None:
            free[at] = False
            mine.append(c)
    if not mine:
        return 0.0
    theirs = [c for c, f in zip(b, free) if not f]
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(mine, theirs)) / 2) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    near = jaro(a, b)
    same = next((i for i, (x, y) in enumerate(zip(a[:PREFIX], b[:PREFIX])) if x != y), min(PREFIX, len(a), len(b)))
    return near + same * SCALE * (1 - near)


@F.pandas_udf(StringType())
def _plain(c: pd.Series) -> pd.Series:
    return c.map(plain, na_action="ignore")


@F.pandas_udf(StringType())
def _composed(c: pd.Series) -> pd.Series:
    return c.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def plain_label(c: Column) -> Column:
    return _plain(c)


def composed(c: Column) -> Column:
    """NFC."""
    return _composed(c)


def jaro_winkler_of(a: Column, b: Column) -> Column:
    return _jaro_winkler(a, b)
