"""Dictionary lines as a stream: each micro-batch is transformed and merged into the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemma.functions.text import LANGUAGE_OF_CODE, lookup
from stemma.operators.merge import fresh_rows, upsert_names_by_key
from stemma.sources import lexical
from stemma.sources.shared import materialize
from stemma.store import Snapshot, Store, conform


def merge_batch(spark: SparkSession, path: str, lines: DataFrame) -> None:
    """Merges lines into the catalogue below path; a replayed batch changes nothing. Only what the lines' keys are in is read,
    and only rows that are new or changed are written."""
    t = materialize(lexical.transform(lexical.parse(lines)), "ingest_entries")
    code = lookup(LANGUAGE_OF_CODE, F.lower("lang_code"))
    rows = materialize(lexical.names(t).select(F.col("key").alias("wiktionary_key"), "label", F.coalesce("language", code).alias("language"), "gender"), "ingest_rows")
    edges = materialize(lexical.edges(t), "ingest_edges")

    def change(base: Snapshot) -> dict[str, DataFrame]:
        known = base.rows("names_by_key", rows.select(F.col("wiktionary_key").alias("value")))
        names = materialize(upsert_names_by_key(base.rows("names", known.select("id")), rows), "ingest_names")
        ends = edges.select(F.col("child").alias("value")).union(edges.select(F.col("parent").alias("value"))).distinct()
        ids = names.select(F.col("wiktionary_key").alias("key"), "id").union(base.rows("names_by_key", ends).select("value", "id")).distinct()
        found = edges.join(ids.toDF("child", "child_id"), "child").join(ids.toDF("parent", "parent_id"), "parent")
        lineage = conform(found.where("child_id <> parent_id"), "name_lineage")
        keys = ["child_id", "parent_id", "relation_type"]
        return {"names": names, "name_lineage": fresh_rows(base.rows("name_lineage", lineage.select(keys)), lineage, keys)}

    Store(spark, path).transact(change)


def ingest(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Reads all files of a folder that weren't read before, then stops; progress is in the checkpoint folder."""
    lines = spark.readStream.text(folder).select("value", *(F.col(path).alias(n) for n, path in lexical.ORIGIN.items()))
    return lines.writeStream.foreachBatch(lambda batch, _: merge_batch(spark, path, lexical.placed(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
