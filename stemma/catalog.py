"""The catalogue: four tables, where they come from, and a view of the driver's tables as a catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stemma import schema
from stemma.store import BUCKETS, Conflict, Snapshot, Store, with_defaults

#: The driver's tables as a catalogue, in SQL that Spark and the oracle share; S stands for the string type.
ADAPTERS = {
    "names": """
SELECT 'R' || CAST(r_regionkey AS S) AS id, r_name AS label, CAST(NULL AS S) AS language, CAST(NULL AS S) AS gender, CAST(NULL AS S) AS wk, CAST(NULL AS S) AS native_label, CAST(NULL AS S) AS wikidata_qid FROM region
UNION ALL SELECT 'N' || CAST(n_nationkey AS S), n_name, 'English', NULL, 'n:' || lower(n_name), NULL, NULL FROM nation
UNION ALL SELECT 'C' || CAST(c_custkey AS S), c_name, c_mktsegment, NULL, NULL, NULL, NULL FROM customer
UNION ALL SELECT 'S' || CAST(s_suppkey AS S), CASE WHEN s_suppkey % 50 = 3 THEN '-' ELSE s_name END, 'English', NULL, 's:' || lower(s_name), CASE WHEN s_suppkey % 50 = 3 THEN 'Native ' || CAST(s_suppkey AS S) END, 'Q' || CAST(1000000 + s_suppkey AS S) FROM supplier
UNION ALL SELECT 'P' || CAST(p_partkey AS S), p_name, nullif(p_type, 'PROMO'),
  CASE p_partkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'unisex' END, CASE WHEN p_partkey % 3 = 0 THEN 'p:' || CAST(p_partkey AS S) END,
  CASE WHEN p_size % 3 = 0 THEN p_brand END, CASE WHEN p_size % 5 > 0 THEN 'Q' || CAST(p_partkey AS S) END FROM part
UNION ALL SELECT 'D' || CAST(doc_id AS S), split_part(text, ' ', 1), CASE WHEN lang = 'en' THEN 'English' ELSE lang END, NULL, NULL, NULL, NULL FROM documents""",
    "relations": """
SELECT name_a, name_b, min(confidence) AS confidence FROM (
  SELECT least(a, b) AS name_a, greatest(a, b) AS name_b, confidence FROM (
    SELECT 'C' || CAST(x.c_custkey AS S) AS a, 'C' || CAST(y.c_custkey AS S) AS b, 'community' AS confidence
    FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 AND y.c_mktsegment = x.c_mktsegment
    UNION ALL SELECT 'P' || CAST(l_partkey AS S), 'S' || CAST(l_suppkey AS S), CASE WHEN l_returnflag = 'A' THEN 'sourced' ELSE 'community' END
    FROM lineitem )) GROUP BY name_a, name_b""",
    "lineage": """
SELECT 'N' || CAST(n_nationkey AS S) AS child_id, 'R' || CAST(n_regionkey AS S) AS parent_id, 'derived_from' AS relation_type FROM nation
UNION ALL SELECT 'C' || CAST(c_custkey AS S), 'N' || CAST(c_nationkey AS S), 'derived_from' FROM customer
UNION ALL SELECT 'S' || CAST(s_suppkey AS S), 'N' || CAST(s_nationkey AS S), 'variant_of' FROM supplier
UNION ALL SELECT DISTINCT 'P' || CAST(l_partkey AS S), 'S' || CAST(l_suppkey AS S), 'diminutive_of' FROM lineitem
UNION ALL SELECT DISTINCT 'P' || CAST(l_partkey AS S), 'S' || CAST(l_suppkey AS S), 'derived_from' FROM lineitem WHERE l_returnflag = 'A'""",
    "enrichments": """
SELECT 'D' || CAST(doc_id AS S) AS name_id, 'wikidata' AS source, 'description' AS field, text AS content FROM documents
UNION ALL SELECT 'D' || CAST(doc_id AS S), 'behindthename', 'usage', 'quality ' || CAST(quality AS S) FROM labels""",
    "batch": """
SELECT 'D' || CAST(item_id AS S) AS name_id, 'wikidata' AS source, 'description' AS field, 'changed ' || text AS content FROM benchmark
UNION ALL SELECT 'D' || CAST(doc_id AS S), 'behindthename', 'related', 'toxic ' || CAST(toxic AS S) FROM labels""",
}
#: The same rows as Spark gets them cheaper: lines of orders are grouped by numbers before keys are spelled out, once for both
#: kinds of lineage. Distinct numbers are distinct ids. Customers grow with the input, so none of the two sides is sent to all tasks.
CHEAPER = {
    "relations": """
SELECT least(a, b) AS name_a, greatest(a, b) AS name_b, confidence FROM (
  SELECT 'C' || CAST(a AS S) AS a, 'C' || CAST(b AS S) AS b, 'community' AS confidence FROM (
    SELECT /*+ MERGE(x, y) */ DISTINCT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 AND y.c_mktsegment = x.c_mktsegment )
  UNION ALL SELECT 'P' || CAST(l_partkey AS S), 'S' || CAST(l_suppkey AS S), CASE WHEN sourced = 1 THEN 'sourced' ELSE 'community' END FROM (
    SELECT l_partkey, l_suppkey, min(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS sourced FROM lineitem GROUP BY l_partkey, l_suppkey ))""",
    "lineage": ADAPTERS["lineage"].split("UNION ALL SELECT DISTINCT")[0] + """UNION ALL SELECT 'P' || CAST(l_partkey AS S), 'S' || CAST(l_suppkey AS S), explode(CASE WHEN sourced = 1 THEN array('diminutive_of', 'derived_from') ELSE array('diminutive_of') END) FROM (
  SELECT l_partkey, l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS sourced FROM lineitem GROUP BY l_partkey, l_suppkey )""",
}
SOURCES = ("region", "nation", "customer", "supplier", "part", "lineitem", "documents", "labels", "benchmark")


def oracle_with(*names: str) -> str:
    """WITH clause for the oracle that defines these parts of the catalogue."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({ADAPTERS[n].replace('AS S)', 'AS VARCHAR)')})" for n in names)


#: The catalogue's parts, and the tables that keep them.
PARTS = {"names": "names", "relations": "name_relations", "lineage": "name_lineage", "enrichments": "name_enrichments"}


@dataclass
class Catalog:
    names: DataFrame
    relations: DataFrame
    lineage: DataFrame
    enrichments: DataFrame
    #: The version that was loaded, if any.
    base: Snapshot | None = None

    @staticmethod
    def part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        """One part of the catalogue over the driver's tables."""
        text = CHEAPER.get(name, ADAPTERS[name]).replace("AS S)", "AS STRING)")
        tables = {}
        for t in SOURCES:
            for lead in (f"FROM {t}", f"JOIN {t}"):
                if lead in text:
                    text = text.replace(lead + " ", lead.replace(t, "{" + t + "}") + " ").replace(lead + "\n", lead.replace(t, "{" + t + "}") + "\n")
                    text = text[: -len(lead)] + lead.replace(t, "{" + t + "}") if text.endswith(lead) else text
                    tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        return spark.sql(text, **tables)

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> Catalog:
        return cls(*(cls.part(spark, sf_dir, n) for n in ("names", "relations", "lineage", "enrichments")))

    @classmethod
    def load(cls, spark: SparkSession, path: str | None, version: int | None = None) -> Catalog:
        """The catalogue's newest version below path; without a path an empty one, so that queries give no rows rather than fail."""
        if not path:
            return cls(*(spark.createDataFrame([], schema.TABLES[t]) for t in PARTS.values())).renamed()
        base = Store(spark, path).snapshot(version)
        if not base.version:
            raise FileNotFoundError(f"no catalogue below {path}")
        return cls(*(with_defaults(base.table(t), t) for t in PARTS.values()), base).renamed()

    def renamed(self) -> Catalog:
        self.names = self.names.withColumnRenamed("wiktionary_key", "wk")
        return self

    def save(self, path: str, only: tuple[str, ...] = tuple(PARTS.values()), buckets: int = BUCKETS) -> None:
        """Writes the whole content of the tables in only, filling in what they lack; the others stay as they are.

        The save goes on top of the version that the catalogue was loaded from: if another writer has changed one of these
        tables since, it raises Conflict. A catalogue that was loaded from nowhere can't replace a saved one. Merges of a few
        rows don't save whole tables: see Store.transact.
        """
        store = Store(self.names.sparkSession, path, buckets)
        base = self.base if self.base and self.base.store.path == path else store.snapshot(0)
        if not base.version and store.versions():
            raise Conflict(f"{path} holds a catalogue that this one was not loaded from")
        parts = {t: getattr(self, a) for a, t in PARTS.items()}
        parts["names"] = self.names.withColumnRenamed("wk", "wiktionary_key")
        base.reads = {t: None for t in only}
        self.base = store.commit(base, {t: parts[t] for t in only}, only)
