"""Write semantics on tables of files: upserts by policy, insert-or-ignore, replacement by source, cascades, constraints.

Each gives the table's new content as a plan; the caller writes it. Keys join with keys, so both sides shuffle once, by
key; rows of the source with a null key can't match and are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma import schema

OVERWRITE, COALESCE, KEEP = "overwrite", "coalesce", "keep"


def stable_id(*keys: str | Column) -> Column:
    """A row's id made from its key: reruns give the same."""
    return F.concat(F.lit("h"), F.substring(F.sha2(F.concat_ws("\u0001", *keys), 256), 1, 31))


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], policy: dict[str, str], new_id: Column | None = None, stamps: tuple[str, ...] = (), born: tuple[str, ...] = ()) -> DataFrame:
    """target's columns after the merge of source; of source rows with one key the first by all columns counts.

    policy: of columns that source has: overwrite (nulls too), coalesce (a null keeps the old value) or keep. Rows
    without a match are added whole; their id is new_id or stable_id of the key. stamps: columns of target that say when a
    row was written; born: when it was added.
    """
    source = last_per_key(source.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), keys, [F.col(c).asc_nulls_last() for c in source.columns])
    new = source.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(F.col(c).alias(f"__s_{c}") for c in source.columns if c not in keys), F.lit(True).alias("__new"))
    old = target.withColumn("__old", F.lit(True))
    met = old.join(new, [F.col(k) == F.col(f"__k_{k}") for k in keys], "full_outer")

    def merged(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(c), F.col(f"__k_{c}"))
        if c == "id" and "id" not in source.columns:
            return F.coalesce(F.col("id"), new_id if new_id is not None else stable_id(*(F.col(f"__k_{k}") for k in keys)))
        if c not in source.columns:
            return F.col(c)
        incoming = F.col(f"__s_{c}")
        how = policy.get(c, OVERWRITE)
        kept = {OVERWRITE: incoming, COALESCE: F.coalesce(incoming, F.col(c)), KEEP: F.col(c)}[how]
        return F.when(F.col("__old").isNull(), incoming).when(F.col("__new").isNull(), F.col(c)).otherwise(kept)

    stamped = lambda c: F.when(F.col("__new").isNotNull(), F.current_timestamp()).otherwise(F.col(c))
    added = lambda c: F.when(F.col("__old").isNull(), F.current_timestamp()).otherwise(F.col(c))
    own = lambda c: c not in source.columns
    return met.select(*((stamped(c) if c in stamps and own(c) else added(c) if c in born and own(c) else merged(c)).alias(c) for c in target.columns))


def upsert_names_by_qid(target: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(target, rows, ["wikidata_qid"], {c: OVERWRITE for c in ("label", "native_label", "language", "gender")}, stamps=("updated_at",), born=("created_at",))


def upsert_names_by_key(target: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(target, rows, ["wiktionary_key"], {"label": OVERWRITE, "language": COALESCE, "gender": COALESCE}, stamps=("updated_at",), born=("created_at",))


def upsert_enrichments(target: DataFrame, rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Rows for unknown names go, where names (id) is given."""
    rows = rows.where("content IS NOT NULL")
    if names is not None:
        rows = rows.join(names.select(F.col("id").alias("name_id")).distinct(), "name_id", "left_semi")
    return upsert(target, rows, ["name_id", "source", "field"], {"content": OVERWRITE, "source_url": OVERWRITE}, stamps=("fetched_at",))


def descriptions(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(name_id, source, field, content, source_url) from (qid, description) of names that are known by their item."""
    ids = names.where("wikidata_qid IS NOT NULL").select(F.col("wikidata_qid").alias("qid"), F.col("id").alias("name_id"))
    link = F.concat(F.lit("https://www.wikidata.org/wiki/"), "qid")
    said = rows.where("description IS NOT NULL AND description <> ''").join(ids, "qid")
    return said.select("name_id", F.lit("wikidata").alias("source"), F.lit("description").alias("field"), F.col("description").alias("content"), link.alias("source_url"))


def fresh_rows(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Those of rows whose key target doesn't have, one for a key: the least by all columns."""
    fresh = rows.join(target.select(keys), keys, "left_anti")
    return last_per_key(fresh, keys, [F.col(c).asc_nulls_last() for c in rows.columns]).select(target.columns)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target and those of rows whose key it doesn't have."""
    return target.unionByName(fresh_rows(target, rows, keys))


def resolved(edges: DataFrame, ids: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """edges whose ends a and b are keys, with ids instead; edges with an unknown end go. ids: (key, id)."""
    left = ids.select(F.col(key).alias(a), F.col("id").alias("__a"))
    right = ids.select(F.col(key).alias(b), F.col("id").alias("__b"))
    return edges.join(left, a).join(right, b).withColumn(a, F.col("__a")).withColumn(b, F.col("__b")).drop("__a", "__b")


def insert_relations(target: DataFrame, edges: DataFrame, ids: DataFrame, key: str = "wikidata_qid") -> DataFrame:
    """Adds edges (name_a, name_b, confidence) given by key, in canonical order of the ids; known pairs stay as they are."""
    rows = resolved(edges, ids, key, "name_a", "name_b").where("name_a <> name_b")
    canonical = rows.withColumns({"name_a": F.least("name_a", "name_b"), "name_b": F.greatest("name_a", "name_b")})
    return insert_ignore(target, canonical.select(target.columns), ["name_a", "name_b"])


def replace_by_source(target: DataFrame, rows: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """target without the source's rows, and rows instead; keys that other sources have stay theirs."""
    return insert_ignore(target.where(F.col("source") != source), rows.where("child_id <> parent_id"), keys)


def cascade(dependent: DataFrame, deleted: DataFrame, *columns: str) -> DataFrame:
    """dependent without rows that refer to a deleted id in one of the columns."""
    for c in columns:
        dependent = dependent.join(deleted.select(F.col("id").alias(c)).distinct(), c, "left_anti").select(dependent.columns)
    return dependent


def violations(df: DataFrame, table: str) -> DataFrame:
    """(rule, n): the table's rules that rows break, and how many."""
    rules = {f"check {check}": F.expr(f"NOT ({check})") for check in [schema.CHECKS.get(table)] if check}
    rules |= {f"not null {c}": F.col(c).isNull() for c in schema.REQUIRED[table] if c in df.columns}
    # What concerns one row is counted in one pass.
    counted = df.agg(*(F.count(F.when(broken, 1)).alias(f"n{i}") for i, broken in enumerate(rules.values())))
    found = [counted.select(F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"n{i}").alias("n")) for i, rule in enumerate(rules)))))]
    for keys in schema.KEYS[table]:
        if set(keys) <= set(df.columns):
            per = df.dropna(subset=keys).groupBy(*keys).count().where("count > 1")
            found.append(per.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit(f"unique {', '.join(keys)}").alias("rule"), "n"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.where("n > 0")


def enforce(df: DataFrame, table: str) -> DataFrame:
    """df, if it keeps all the table's rules."""
    broken = violations(df, table).collect()
    if broken:
        raise ValueError(f"{table}: " + "; ".join(f"{r['rule']}: {r['n']} rows" for r in broken))
    return df


def table_counts(names: DataFrame, relations: DataFrame, enrichments: DataFrame) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in (("names", names), ("relations", relations), ("enrichments", enrichments))]
    return parts[0].union(parts[1]).union(parts[2])
