"""Knowledge-base extracts: query results in JSON, a triples table with the source's query shapes, wiki API replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma import schema
from stemma.functions.text import GENDER_OF_TYPE, lookup, normalized_gender, qid_number, qid_of_uri, trimmed

#: The types of the items that are names, sizes of windows, pages and batches.
NAME_TYPES = ("Q202444", "Q11879590", "Q12308941", "Q3409032")
WINDOW, BATCH, OFFSET_LIMIT = 50_000, 100, 10_000


def parse_json(lines: DataFrame, ddl: str) -> DataFrame:
    return lines.select(F.from_json("value", ddl).alias("r")).where("r IS NOT NULL").select("r.*")


def bindings(lines: DataFrame) -> DataFrame:
    """(at, b): one row for each binding of each result document; at is its place, by the document's page where lines say it."""
    page = F.col("page") if "page" in lines.columns else F.monotonically_increasing_id()
    read = lines.select(page.alias("page"), F.from_json("value", schema.SPARQL_RESULT).alias("r")).where("r IS NOT NULL")
    return read.select("page", F.posexplode("r.results.bindings").alias("binding", "b")).select(F.struct("page", "binding").alias("at"), "b")


def bound(name: str) -> Column:
    return F.try_element_at(F.col("b"), F.lit(name))["value"]


def parse_names(lines: DataFrame) -> DataFrame:
    """(qid, label, native_label, language, gender, description), one row for a qid: items that aren't Q-items or lack a label go."""
    rows = bindings(lines).select("at", qid_of_uri(bound("item")).alias("qid"), trimmed(bound("itemLabel")).alias("label"), trimmed(bound("nativeLabel")).alias("native_label"),
                                  trimmed(bound("langLabel")).alias("language"), normalized_gender(bound("genderLabel")).alias("gender"), trimmed(bound("description")).alias("description"))
    return dedupe_by_qid(rows.where("qid IS NOT NULL AND label IS NOT NULL"), "at")


def parse_edges(lines: DataFrame) -> DataFrame:
    return bindings(lines).select(qid_of_uri(bound("a")).alias("a"), qid_of_uri(bound("b")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def parse_count(lines: DataFrame) -> DataFrame:
    """(n): the first binding's count, zero if there is none."""
    first = parse_json(lines, schema.SPARQL_RESULT).select(F.try_element_at(F.get("results.bindings", F.lit(0)), F.lit("count"))["value"].alias("c"))
    return first.select(F.coalesce(F.col("c").try_cast("bigint"), F.lit(0)).alias("n"))


def dedupe_by_qid(rows: DataFrame, ordinal: str) -> DataFrame:
    """One row for a qid, folding its rows in order: the better of two wins (English language four points, native label
    two, description one; a tie goes to the later) and the loser fills in what the winner lacks.

    The fold runs over an array of a qid's rows; a qid has a handful of rows, one for each of its types.
    """
    filled = ("native_label", "language", "gender", "description")
    one = F.struct("label", *filled)
    score = lambda r: (4 * (F.lower(F.coalesce(r["language"], F.lit(""))) == "english").cast("int") + 2 * r["native_label"].isNotNull().cast("int") + r["description"].isNotNull().cast("int"))

    def fold(acc: Column, r: Column) -> Column:
        later = score(r) >= score(acc)
        win = F.struct(F.when(later, r["label"]).otherwise(acc["label"]).alias("label"), *(F.when(later, F.coalesce(r[c], acc[c])).otherwise(F.coalesce(acc[c], r[c])).alias(c) for c in filled))
        return F.when(acc["label"].isNull(), r).otherwise(win)

    kind = "struct<label:string,native_label:string,language:string,gender:string,description:string>"
    listed = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), one.alias("r")))).alias("rows"))
    start = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("label", *filled))).cast(kind)
    return listed.select("qid", F.aggregate(F.transform("rows", lambda x: x["r"].cast(kind)), start, fold).alias("w")).select("qid", "w.*")


# Query shapes over triples (s, p, o, lang): types are rows with p = 'type', equivalence p = 'same_as', labels p = 'label'.


def typed(triples: DataFrame, *types: str) -> DataFrame:
    """(qid, n, type) of the items of these types (any if none is given)."""
    rows = triples.where(F.col("p") == "type").select(qid_of_uri(F.col("s")).alias("qid"), F.col("o").alias("type")).where("qid IS NOT NULL")
    return (rows.where(F.col("type").isin(*types)) if types else rows).withColumn("n", qid_number(F.col("qid")))


def page_after(triples: DataFrame, type_: str, after: int, size: int) -> DataFrame:
    """The next page of a type's items by number: order and cursor are both numeric, so no item is passed over."""
    return typed(triples, type_).where(F.col("n") > after).select("qid", "n").distinct().orderBy("n").limit(size)


def page_at(triples: DataFrame, type_: str, offset: int, size: int) -> DataFrame:
    return typed(triples, type_).select("qid", "n").distinct().orderBy("n").offset(offset).limit(size)


def with_prefix(triples: DataFrame, type_: str, digits: str, after: int | None = None, size: int | None = None) -> DataFrame:
    """A type's items whose number starts with digits; with a size the next page of them after a number, in order."""
    found = typed(triples, type_).where(F.col("qid").startswith("Q" + digits)).select("qid", "n").distinct()
    found = found if after is None else found.where(F.col("n") > after)
    return found if size is None else found.orderBy("n").limit(size)


def max_qid(rows: DataFrame, column: str = "qid") -> DataFrame:
    """(qid): the item with the largest number."""
    return rows.agg(F.max_by(column, qid_number(F.col(column))).alias("qid"))


def in_window(triples: DataFrame, low: int, high: int, *types: str) -> DataFrame:
    """Items numbered from low up to, not including, high."""
    return typed(triples, *types).where((F.col("n") >= low) & (F.col("n") < high))


def windows(spark: SparkSession, low: int, high: int, size: int = WINDOW) -> DataFrame:
    """(low, high): adjacent half-open windows, the last one clipped."""
    starts = spark.range(low, max(low, high), size).select(F.col("id").alias("low"))
    return starts.select("low", F.least(F.col("low") + size, F.lit(high)).alias("high"))


def prefixes(spark: SparkSession) -> DataFrame:
    """The ninety two-digit prefixes; items of one digit match none of them."""
    return spark.range(10, 100).select(F.col("id").cast("string").alias("prefix"))


def split_prefix(prefix: str, longest: int = 4) -> list[str]:
    return [prefix + str(d) for d in range(10)] if len(prefix) < longest else []


def same_as(triples: DataFrame) -> DataFrame:
    rows = triples.where(F.col("p") == "same_as").select(qid_of_uri(F.col("s")).alias("a"), qid_of_uri(F.col("o")).alias("b"))
    return rows.where("a IS NOT NULL AND b IS NOT NULL")


def typed_edges(triples: DataFrame, low: int | None = None, high: int | None = None, *types: str) -> DataFrame:
    """Edges stated from the smaller id whose ends share a type; with a window, on the first end's number."""
    t = typed(triples, *types)
    left, right = t.select(F.col("qid").alias("a"), F.col("n").alias("na"), "type"), t.select(F.col("qid").alias("b"), F.col("type").alias("same"))
    found = same_as(triples).where("a < b").join(left, "a").join(right, "b").where("type = same")
    if low is not None:
        found = found.where((F.col("na") >= low) & (F.col("na") < high))
    return found.select("a", "b").distinct()


def known_edges(triples: DataFrame, known: DataFrame, *types: str) -> DataFrame:
    """Edges from known items (qid) to typed ones, stated from the smaller id."""
    ends = typed(triples, *types).select(F.col("qid").alias("b"))
    return same_as(triples).where("a < b").join(known.select(F.col("qid").alias("a")), "a", "left_semi").join(ends, "b", "left_semi").select("a", "b").distinct()


def count_typed(triples: DataFrame, *types: str) -> DataFrame:
    """An item counts once for each of its types."""
    return typed(triples, *types).agg(F.count(F.lit(1)).alias("n"))


def with_optionals(triples: DataFrame, type_: str, language: str = "en") -> DataFrame:
    """A type's items with what else is known of each, null where nothing is: label, native label, description, language, gender."""
    def value(p: str, name: str, lang: str | None) -> DataFrame:
        rows = triples.where(F.col("p") == p)
        rows = rows.where(F.col("lang") == lang) if lang else rows
        return rows.select(qid_of_uri(F.col("s")).alias("qid"), F.col("o").alias(name)).groupBy("qid").agg(F.min(name).alias(name))

    found = typed(triples, type_).select("qid").distinct()
    for part in (value("label", "label", language), value("native", "native_label", None), value("description", "description", language), value("language", "language", None), value("gender", "gender", None)):
        found = found.join(part, "qid", "left")
    return found


# Wiki API replies.


def search_page(lines: DataFrame, offset: int = 0) -> DataFrame:
    """(titles, total, next_offset) of a search reply: only Q-items; without a total the page's size counts."""
    if offset >= OFFSET_LIMIT:
        raise ValueError(f"the search API gives no page from offset {OFFSET_LIMIT} on")
    titles = F.filter(F.transform("query.search", lambda x: x["title"]), lambda t: t.rlike(r"^Q\d+$"))
    return parse_json(lines, schema.SEARCH_PAGE).select(titles.alias("titles"), F.coalesce("query.searchinfo.totalhits", F.size(titles).cast("bigint")).alias("total"), F.col("continue.sroffset").alias("next_offset"))


def entities(lines: DataFrame, type_qid: str) -> DataFrame:
    """(qid, label, language, gender, description): the English label, else the first; missing ones go."""
    rows = parse_json(lines, schema.ENTITIES).select(F.explode("entities").alias("qid", "e")).where("e IS NOT NULL AND e.missing IS NULL")
    label = F.coalesce(F.try_element_at("e.labels", F.lit("en"))["value"], F.get(F.map_values("e.labels"), F.lit(0))["value"])
    gender = lookup(GENDER_OF_TYPE, F.lit(type_qid))
    return rows.select("qid", trimmed(label).alias("label"), F.lit("English").alias("language"), gender.alias("gender"), trimmed(F.try_element_at("e.descriptions", F.lit("en"))["value"]).alias("description")).where("label IS NOT NULL AND label <> ''")


# Replies of a name-usage service.


def usage_rows(replies: DataFrame, url: str = "https://www.behindthename.com/name/") -> DataFrame:
    """(name_id, source, field, content, source_url) from (name_id, value): the first match's usages; and related names,
    thirty at most. Replies with an error, without a match or without values give nothing."""
    r = replies.select("name_id", F.from_json("value", schema.USAGE_REPLY).alias("r")).where("r IS NOT NULL AND r.error IS NULL AND coalesce(r.error_code, 0) = 0").select("name_id", F.get("r.names", F.lit(0)).alias("m")).where("m IS NOT NULL")
    some = lambda c, f: F.filter(F.transform(c, f), lambda x: x.isNotNull() & (x != ""))
    usages, related = some(F.col("m.usages"), lambda u: u["usage_full"]), some(F.col("m.related_names"), lambda u: u["name"])
    link = F.concat(F.lit(url), F.url_encode(F.lower("m.name")))
    used = r.where(F.size(usages) > 0).select("name_id", F.lit("usage").alias("field"), F.concat(F.lit("Usages: "), F.array_join(usages, ", ")).alias("content"), link.alias("source_url"))
    kin = r.where(F.size(related) > 0).select("name_id", F.lit("related").alias("field"), F.array_join(F.slice(related, 1, 30), ", ").alias("content"), link.alias("source_url"))
    return used.union(kin).select("name_id", F.lit("behindthename").alias("source"), "field", "content", "source_url")


def pending(names: DataFrame, degree: DataFrame, enrichments: DataFrame, source: str, limit: int, least: int) -> DataFrame:
    """(id, degree) of names yet to be enriched: the best 2 * limit by degree are taken first, then those below the least
    degree or done already go."""
    ranked = names.where("wikidata_qid IS NOT NULL").join(degree, "id").select("id", "degree").orderBy(F.desc("degree"), "id").limit(2 * limit)
    done = enrichments.where(F.col("source") == source).select(F.col("name_id").alias("id")).distinct()
    return ranked.where(F.col("degree") >= least).join(done, "id", "left_anti").orderBy(F.desc("degree"), "id").limit(limit)
