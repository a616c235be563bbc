"""From documents to token digests: five stages, each over all that the one before kept.

Documents whose language is rejected go; of equal texts one stays; of near duplicates one stays; the rest is mixed to
target weights (rows repeat as often as the mix takes them); what the mix holds is encoded. Null texts and texts without
letters are rejected by the first stage. Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import langid
from stemma.llm.common import fold, table
from stemma.llm.exact_dedup import deduplicate
from stemma.llm.mixing import mix
from stemma.llm.queries import bpe_digests
from stemma.llm.simhash import drop_near_duplicates
from stemma.sources.shared import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    kept = langid.identify(docs, model, out=("__lang_pred", "__score", "__rejected")).where("NOT __rejected")
    return kept.select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mixing), ("bpe_encoding", encoding)]

#: SQL has no byte-level BPE, no trained language model and no fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
