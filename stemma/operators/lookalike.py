"""Labels spelled much like a given one, by Jaro-Winkler similarity of their plain forms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.unicode import jaro_winkler_of, plain, plain_label

#: Fixed values.
SHORTEST, LENGTHS_APART, LEAST, LIMIT = 4, 2, 0.72, 6


def score(a: Column, b: Column) -> Column:
    """Similarity of two plain labels; null for short ones, for lengths too far apart, and below the least."""
    la, lb = F.char_length(a), F.char_length(b)
    fit = (la >= SHORTEST) & (lb >= SHORTEST) & (F.abs(la - lb) <= LENGTHS_APART)
    near = F.when(a == b, 1.0).otherwise(jaro_winkler_of(a, b))
    return F.when(fit & (near >= LEAST), near)


def rank(names: DataFrame, label: str, exclude: Iterable[str] = (), limit: int = LIMIT) -> DataFrame:
    """(id, label, score), best first, then by label in locale order. Rows of unfit length go before any pair is compared."""
    target = plain(label) or ""
    rows = names.where(~F.col("id").isin(*exclude)) if (exclude := list(exclude)) else names
    rows = rows.withColumn("plain", plain_label(F.col("label"))).where(F.char_length("plain").between(max(SHORTEST, len(target) - LENGTHS_APART), len(target) + LENGTHS_APART))
    scored = rows.withColumn("score", F.round(score(F.col("plain"), F.lit(target)), 6)).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), F.collate("label", "UNICODE"), "id").limit(limit).select("id", "label", "score")
