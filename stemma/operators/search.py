"""Ranked fuzzy search over labels, paging, suggestions, facets and detail.

A stored catalogue keeps postings (gram, id, number of the label's grams) up to date with its names. A query reads the
postings of its own few trigrams: those give the similarity of every label that shares one, and the labels that have all
trigrams which any text containing the query must have; only these are looked at. A query without a whole trigram (one or two
letters in the middle of a word) can't be asked of postings and reads all labels, as does a catalogue without an index.
Degrees are counted for hits alone. Ranks are total orders: the last key is always the id.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma import schema
from stemma.catalog import Catalog
from stemma.functions.text import similarity, trigrams, trimmed
from stemma.operators.graph import degrees, incident
from stemma.sources.shared import beside, materialize

THRESHOLD, PAGE, LARGEST_PAGE, FACETS = 0.3, 20, 50, 80


def trigram_index(names: DataFrame) -> DataFrame:
    """(gram, id, n): the postings, with the number of grams of the id's label."""
    grams = trigrams(F.col("label"))
    return names.select("id", F.size(grams).alias("n"), F.explode(grams).alias("gram"))


def _of(spark: SparkSession, made: Column):
    """What an expression without columns gives; the optimizer folds it, so no job runs."""
    return spark.sql("SELECT 1").select(made).first()[0]


def query_grams(spark: SparkSession, query: str) -> list[str]:
    return _of(spark, trigrams(F.lit(query)))


def contained_grams(spark: SparkSession, query: str) -> list[str]:
    """The trigrams of every label that contains the query, where % and _ stand for any text: those within its words, and
    those at the edges of words that the query itself shows. None are known of a query with an escape."""
    found: dict[str, None] = {}
    for literal in _of(spark, F.lower(F.lit(f"%{query}%"))).replace("_", "%").split("%") if "\\" not in query else ():
        for padded in _padded(literal):
            found |= dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2))
    return list(found)


def _padded(literal: str) -> Iterator[str]:
    """The words of a text, with the spaces of trigrams where the text goes on beyond the word."""
    marks = [unicodedata.category(c)[0] in "LN" for c in literal] + [False]
    start = 0
    for i, inside in enumerate(marks):
        if not inside:
            if i > start:
                yield "  " * (start > 0) + literal[start:i] + " " * (i < len(literal))
            start = i + 1


class LabelIndex:
    """Postings as trigram_index makes them, and the names they are of."""

    def __init__(self, postings: DataFrame, names: DataFrame):
        self.table, self.all = postings, names

    def postings(self, grams: list[str]) -> DataFrame:
        return self.table.where(F.col("gram").isin(grams))  # a query's grams are few

    def names(self, ids: DataFrame) -> DataFrame:
        """The names that ids may be of: a join with ids follows."""
        return self.all


class StoredIndex(LabelIndex):
    """The postings of a stored version, and its names: only the buckets of what is asked for are read."""

    def __init__(self, catalog: Catalog):
        super().__init__(catalog.base.table(schema.GRAMS), catalog.names)
        self.base = catalog.base

    def postings(self, grams: list[str]) -> DataFrame:
        return self.base.rows(schema.GRAMS, self.base.store.spark.createDataFrame([(g,) for g in grams], "gram string"))

    def names(self, ids: DataFrame) -> DataFrame:
        return self.base.around("names", ids.select("id")).withColumnRenamed("wiktionary_key", "wk")


def _counted(index: LabelIndex, asked: list[str], inside: list[str]) -> DataFrame:
    """(id, sim, alike) of the labels that share a gram: their similarity, and how many of the grams inside they have."""
    gram = F.col("gram")
    shared, alike = (F.count(F.when(gram.isin(g), 1)) for g in (asked, inside))
    counted = index.postings(sorted({*asked, *inside})).groupBy("id", "n").agg(shared.alias("shared"), alike.alias("alike"))
    return counted.select("id", (F.col("shared") / (F.col("n") + len(asked) - F.col("shared"))).alias("sim"), "alike")


def indexed_similarity(postings: DataFrame, query: str) -> DataFrame:
    """(id, sim) of the ids that share a trigram with the query."""
    return _counted(LabelIndex(postings, postings), query_grams(postings.sparkSession, query), []).select("id", "sim")


def candidates(index: LabelIndex, query: str, inside: list[str]) -> DataFrame:
    """(id, sim) of the labels that are similar to the query or have all the grams inside it."""
    found = _counted(index, query_grams(index.table.sparkSession, query), inside)
    return found.where((F.col("sim") >= THRESHOLD) | (F.col("alike") == len(inside))).select("id", "sim")


def matching(names: DataFrame, query: str, language: str | None = None, index: LabelIndex | None = None) -> DataFrame:
    """names that are similar to the query or contain it (its % and _ are wildcards), with sim."""
    query = query.strip()
    inside = contained_grams(names.sparkSession, query) if index else []
    if inside:
        close = materialize(candidates(index, query, inside), "search_candidates")
        found = index.names(close).join(beside(close, close.count()), "id")
    else:
        found = names.withColumn("sim", similarity(F.col("label"), F.lit(query)))
    found = found.where((F.col("sim") >= THRESHOLD) | F.col("label").ilike(f"%{query}%"))
    return found.where(F.col("language").ilike(language.strip())) if language and language.strip() else found


def hits(catalog: Catalog, query: str, language: str | None = None, index: LabelIndex | None = None) -> DataFrame:
    """What matches, written once, so that counting and ranking don't search again. A blank query matches nothing."""
    names = catalog.names if query.strip() else catalog.names.where("false")
    return materialize(matching(names, query, language, index if query.strip() else None), "search_hits")


def ranked(found: DataFrame, catalog: Catalog) -> tuple[DataFrame, list[Column]]:
    """found with the keys of the rank, and the rank's order: null languages come before all others, as in the source. Degrees
    are those of found alone."""
    ids, n = found.select("id"), found.count()
    of = lambda edges, name: beside(degrees(edges.join(beside(ids, n), "id", "left_semi")).withColumnRenamed("degree", name), n)
    lineage, cognates = of(incident(catalog.lineage, "child_id", "parent_id"), "lineage_degree"), of(incident(catalog.relations, "name_a", "name_b"), "cognate_degree")
    keyed = (found.join(lineage, "id", "left").join(cognates, "id", "left")
             .withColumns({"lineage_degree": F.coalesce("lineage_degree", F.lit(0)), "cognate_degree": F.coalesce("cognate_degree", F.lit(0)),
                           "has_key": F.col("wk").isNotNull(), "english": F.col("language").ilike("english")}))
    return keyed, [F.desc("sim"), F.desc("lineage_degree"), F.desc("has_key"), F.desc_nulls_first("english"), F.desc("cognate_degree"), F.asc("id")]


def page_of(found: DataFrame, catalog: Catalog, page: int = 1, page_size: int = PAGE) -> DataFrame:
    size, page = min(max(page_size, 1), LARGEST_PAGE), max(page, 1)
    keyed, order = ranked(found, catalog)
    return keyed.orderBy(*order).offset((page - 1) * size).limit(size)


def search(catalog: Catalog, query: str, page: int = 1, page_size: int = PAGE, language: str | None = None, index: LabelIndex | None = None) -> DataFrame:
    """One page of results."""
    return page_of(hits(catalog, query, language, index), catalog, page, page_size)


def suggest(catalog: Catalog, query: str, page_size: int = PAGE, index: LabelIndex | None = None) -> DataFrame:
    """The first results with different labels, out of a bounded number of the best ones."""
    size = min(max(page_size, 1), LARGEST_PAGE)
    keyed, order = ranked(hits(catalog, query, index=index), catalog)
    best = keyed.orderBy(*order).limit(min(size * 5, 60))
    once = Window.partitionBy(F.lower(trimmed(F.col("label")))).orderBy(*order)
    return best.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n").orderBy(*order).limit(size)


def total(catalog: Catalog, query: str, language: str | None = None, index: LabelIndex | None = None) -> DataFrame:
    names = catalog.names if query.strip() else catalog.names.where("false")
    return matching(names, query, language, index if query.strip() else None).agg(F.count(F.lit(1)).alias("total"))


def language_facets(names: DataFrame, limit: int = FACETS) -> DataFrame:
    """The most frequent languages; blank ones count towards the limit but aren't shown."""
    counted = names.where(F.col("language").isNotNull()).groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "language").limit(limit).where(trimmed(F.col("language")) != "")


def name_row(names: DataFrame, name_id: str) -> DataFrame:
    return names.where(F.col("id") == name_id).limit(1)


def detail_cognates(catalog: Catalog, name_id: str, limit: int = 50) -> DataFrame:
    """The names at the other end of the id's relations, the first by id."""
    ends = incident(catalog.relations, "name_a", "name_b").where(F.col("id") == name_id).select(F.col("other").alias("id")).distinct()
    return catalog.names.join(ends, "id").orderBy("id").limit(limit)


def detail(catalog: Catalog, name_id: str) -> DataFrame:
    """One row: the name, its enrichments and its cognates as arrays; none if the id is unknown."""
    notes = catalog.enrichments.where(F.col("name_id") == name_id)
    notes = notes if "source_url" in notes.columns else notes.withColumn("source_url", F.lit(None).cast("string"))
    told = notes.agg(F.array_sort(F.collect_list(F.struct("source", "field", "content", "source_url"))).alias("enrichments")).withColumn("id", F.lit(name_id))
    kin = detail_cognates(catalog, name_id).agg(F.array_sort(F.collect_list(F.struct("id", "label", "native_label", "language", "gender"))).alias("cognates")).withColumn("id", F.lit(name_id))
    row = name_row(catalog.names, name_id)
    shown = ["id", "label", "native_label", "language", "gender", "wk", "wikidata_qid"]
    return row.select(shown).join(kin, "id", "left").join(told, "id", "left").select(*shown, "enrichments", "cognates")


def meaning(enrichments: DataFrame) -> DataFrame:
    """(name_id, content): of each name the description, else the meaning, else the usage, else the first of the rest."""
    rank = F.when(F.col("field") == "description", 0).when(F.col("field") == "meaning", 1).when(F.col("field") == "usage", 2).otherwise(3)
    return enrichments.groupBy("name_id").agg(F.min_by("content", F.struct(rank, "source", "field")).alias("content"))
