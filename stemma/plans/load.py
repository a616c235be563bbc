"""Loads from the knowledge base and the usage service into a saved catalogue, resumable.

Pages are fetched one after the other, as the services ask, and merged GATHERED at a time; the progress record is
written after the merge it tells of, so a load that is killed repeats pages but never misses one. Merges are upserts:
a repeated page changes nothing. They read the buckets that their keys are in and write what is new or changed, in
transactions that others may share the catalogue with.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.catalog import Catalog
from stemma.operators import graph, merge
from stemma.plans.relations import merge_relations
from stemma.sources import knowledge, remote
from stemma.sources.knowledge import BATCH, NAME_TYPES, OFFSET_LIMIT, WINDOW
from stemma.sources.progress import Progress
from stemma.sources.shared import materialize
from stemma.store import Snapshot, Store

#: Pages merged at a time; the narrowest window that is split; items asked for at a time.
GATHERED, NARROWEST, ENTITIES = 20, 2000, 50
#: Names that are asked about between two merges, and a day's share of the usage service (fixed value).
ASKED, DAILY = 50, 4000


@dataclass
class Options:
    mode: str = "search"
    page_size: int = 400
    max_pages: int | None = None
    first: int = 1
    last: int = 100_000_000
    window: int = WINDOW
    type: str | None = None
    resume: bool = False
    skip_closure: bool = False


class KnowledgeLoad:
    """progress: where the record is kept, beside the catalogue by default."""

    def __init__(self, spark: SparkSession, path: str, progress: str | None = None, options: Options = Options(), source: remote.Remote | None = None):
        self.spark, self.path, self.progress, self.options, self.source = spark, path, progress or f"{path}/progress.json", options, source or remote.Remote()
        self.store = Store(spark, path)

    def _lines(self, replies: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(replies)), "page bigint, value string")

    def _saved(self, phase: str) -> Progress:
        saved = Progress.load(self.progress, self.spark) if self.options.resume else None
        return saved if saved and saved.phase == phase else Progress(phase=phase)

    def _each(self, pages: Iterator[tuple[list, Progress]], merge_all: Callable[[list], None]) -> int:
        """Merges what pages hold, GATHERED at a time, and writes how far that went. Stops after max_pages."""
        held, n, at = [], 0, None
        for found, at in pages:
            held += found
            n += 1
            stop = self.options.max_pages is not None and n >= self.options.max_pages
            if stop or n % GATHERED == 0:
                merge_all(held)
                at.save(self.progress, self.spark)
                held = []
            if stop:
                return n
        merge_all(held)
        if at:
            at.save(self.progress, self.spark)
        return n

    # Names.

    def merge_names(self, rows: DataFrame) -> None:
        """Rows (qid, label, native_label, language, gender, description) into names and descriptions."""
        rows = materialize(rows, "load_rows")
        given = rows.select(F.col("qid").alias("wikidata_qid"), "label", "native_label", "language", "gender")

        def change(base: Snapshot) -> dict[str, DataFrame]:
            known = base.rows("names_by_qid", given.select(F.col("wikidata_qid").alias("value")).dropna())
            names = materialize(merge.upsert_names_by_qid(base.rows("names", known.select("id")), given), "load_names")
            return {"names": names, "name_enrichments": _told(base, merge.descriptions(rows, names))}

        self.store.transact(change)

    def names(self) -> int:
        """Loads names by the mode: search (then prefixes beyond the search's reach), scroll, window or type-window."""
        o, saved = self.options, self._saved("names")
        if o.mode == "search":
            done = 0
            for type_qid in [o.type] if o.type else NAME_TYPES:
                if type_qid not in saved.completedTypes:
                    done += self._each(self._searched(type_qid, saved), lambda held: self._merge_searched(type_qid, held))
                    if o.max_pages is not None and done >= o.max_pages:
                        return done
                    saved.completedTypes.append(type_qid)
                    saved.searchOffset, saved.pendingPrefixes, saved.uriPrefix, saved.after, saved.type = None, [], None, None, None
                    saved.save(self.progress, self.spark)
            if not o.type:
                Progress.clear(self.progress, self.spark)
            return done
        types = (o.type,) if o.type else ()
        pages = self._scrolled(lambda at, size: remote.names_page(at, size, *types), "names", saved) if o.mode == "scroll" else self._windowed(lambda low, high: remote.names_window(low, high, *types), "names", saved)
        return self._each(pages, lambda replies: replies and self.merge_names(knowledge.parse_names(self._lines(replies))))

    def _searched(self, type_qid: str, saved: Progress) -> Iterator[tuple[list, Progress]]:
        """("search", reply of items) pages up to the search's limit, then ("query", reply) pages by prefixes of numbers."""
        o = self.options
        mine = saved if saved.type == type_qid else Progress(completedTypes=list(saved.completedTypes))
        at = mine.searchOffset or 0
        while not mine.pendingPrefixes and mine.uriPrefix is None:
            page = json.loads(self.source.search(type_qid, at, min(o.page_size, 500)))
            total = page.get("query", {}).get("searchinfo", {}).get("totalhits", 0)
            qids = [x["title"] for x in page.get("query", {}).get("search", []) if x["title"][:1] == "Q" and x["title"][1:].isdigit()]
            found = [("search", self.source.entities(qids[i : i + ENTITIES])) for i in range(0, len(qids), ENTITIES)]
            at = page.get("continue", {}).get("sroffset")
            if at is None and total <= OFFSET_LIMIT:
                yield found, Progress(type=type_qid, completedTypes=list(saved.completedTypes))
                return
            if at is None or at >= OFFSET_LIMIT:
                mine = Progress(type=type_qid, pendingPrefixes=[str(i) for i in range(10, 100)] + [str(i) for i in range(1, 10)], completedTypes=list(saved.completedTypes))
                yield found, mine
                break
            yield found, Progress(type=type_qid, searchOffset=at, completedTypes=list(saved.completedTypes))
        pending, prefix, after = list(mine.pendingPrefixes), mine.uriPrefix, int(mine.after or 0)
        while prefix or pending:
            prefix = prefix or pending.pop(0)
            try:
                reply = self.source.sparql(remote.names_prefix(type_qid, prefix, after, o.page_size) if len(prefix) > 1 else remote.names_window(int(prefix), int(prefix) + 1, type_qid), 4)
            except remote.SourceTimeout:
                if not (split := knowledge.split_prefix(prefix)):
                    raise
                # The number that is the prefix itself has none of the longer ones.
                pending, prefix, after = [*split, *pending], None, 0
                yield [("query", self.source.sparql(remote.names_window(int(split[0][:-1]), int(split[0][:-1]) + 1, type_qid)))], Progress(type=type_qid, pendingPrefixes=list(pending), completedTypes=list(saved.completedTypes))
                continue
            items = [b["item"]["value"].rpartition("/Q")[2] for b in json.loads(reply)["results"]["bindings"] if "item" in b]
            numbers = [int(x) for x in items if x.isdigit()]
            if len(items) < o.page_size or not numbers or len(prefix) == 1:
                prefix, after = None, 0
            else:
                after = max(numbers)
            yield [("query", reply)], Progress(type=type_qid, after=str(after) if prefix else None, uriPrefix=prefix, pendingPrefixes=list(pending), completedTypes=list(saved.completedTypes))

    def _merge_searched(self, type_qid: str, held: list) -> None:
        searched, queried = ([r for kind, r in held if kind == k] for k in ("search", "query"))
        if searched:
            rows = knowledge.entities(self._lines(searched), type_qid)
            self.merge_names(rows.withColumn("native_label", F.lit(None).cast("string")).dropDuplicates(["qid"]))
        if queried:
            self.merge_names(knowledge.parse_names(self._lines(queried)))

    # Edges.

    def edges(self) -> int:
        """Loads direct edges by the mode (scroll, window, or else by known items), closes them and adds what is new."""
        o, saved = self.options, self._saved("edges")
        pages = (self._scrolled(remote.edges_page, "edges", saved) if o.mode == "scroll" else self._windowed(remote.edges_window, "edges", saved) if o.mode in ("window", "type-window") else self._known(saved))
        return self._each(pages, lambda replies: replies and self.merge_edges(knowledge.parse_edges(self._lines(replies))))

    def merge_edges(self, found: DataFrame) -> None:
        """Adds the direct edges between known items; the closure follows, however the load is cut into parts."""
        found = materialize(found, "load_found")
        items = found.select(F.col("a").alias("value")).union(found.select(F.col("b").alias("value"))).distinct()
        known = self.store.snapshot().rows("names_by_qid", items).withColumnRenamed("value", "wikidata_qid")
        merge_relations(self.store, merge.resolved(found, known, "wikidata_qid", "a", "b"), "a", "b", close=not self.options.skip_closure)

    def _known(self, saved: Progress) -> Iterator[tuple[list, Progress]]:
        """Batches of known items in order of their numbers, from the last that was asked for on, so that names that are added
        meanwhile shift nothing; the ids alone pass through the driver, a partition at a time."""
        number = knowledge.qid_number(F.col("value"))
        items = self.store.snapshot().table("names_by_qid").select("value", number.alias("n")).where(F.col("n") > int(saved.after or 0)).orderBy("n")
        size, held = min(self.options.page_size, BATCH), []
        reply = lambda: [self.source.sparql(remote.edges_of([q for q, _ in held]), 4)]
        for r in items.toLocalIterator():
            held.append((r["value"], r["n"]))
            if len(held) == size:
                yield reply(), Progress(phase="edges", after=str(held[-1][1]), completedTypes=saved.completedTypes)
                held.clear()
        if held:
            yield reply(), Progress(phase="edges", after=str(held[-1][1]), completedTypes=saved.completedTypes)

    # Pages of both.

    def _scrolled(self, query: Callable[[int, int], str], phase: str, saved: Progress) -> Iterator[tuple[list, Progress]]:
        at, size = saved.searchOffset or 0, self.options.page_size
        while True:
            reply = self.source.sparql(query(at, size))
            n = len(json.loads(reply)["results"]["bindings"])
            at += size
            if n:
                yield [reply], Progress(phase=phase, searchOffset=at, completedTypes=saved.completedTypes)
            if n < size:
                return

    def _windowed(self, query: Callable[[int, int], str], phase: str, saved: Progress) -> Iterator[tuple[list, Progress]]:
        """Windows of item numbers; one that times out is halved, down to NARROWEST."""
        low, o = saved.windowStart or self.options.first, self.options
        queue = [(low, min(low + o.window, o.last))] if low < o.last else []
        while queue:
            low, high = queue.pop()
            try:
                reply = self.source.sparql(query(low, high), 4)
            except remote.SourceTimeout:
                if high - low <= NARROWEST:
                    raise
                middle = (low + high) // 2
                queue += [(middle, high), (low, middle)]
                continue
            if not queue and high < o.last:
                queue.append((high, min(high + o.window, o.last)))
            yield [reply], Progress(phase=phase, windowStart=high, completedTypes=saved.completedTypes)


def _told(base: Snapshot, rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """What rows of enrichments change."""
    return merge.upsert_enrichments(base.rows("name_enrichments", rows.select("name_id", "source", "field")), rows, names)


def enrich(spark: SparkSession, path: str, key: str, limit: int = DAILY, least: int = 0, source: remote.Remote | None = None, pause: float = 0.55) -> int:
    """Asks the usage service about the most connected names that it wasn't asked about, and merges what it says, ASKED names
    at a time: what was merged stays if the service fails later. The service allows a few thousand names a day, so limit
    bounds what comes to the driver."""
    source = source or remote.Remote()
    catalog = Catalog.load(spark, path)
    both = graph.incident(catalog.relations, "name_a", "name_b")
    todo = knowledge.pending(catalog.names, graph.name_degrees(catalog.names, both), catalog.enrichments, "behindthename", limit, least)
    asked = todo.join(catalog.names.select("id", "label"), "id").orderBy(F.desc("degree"), "id").collect()
    store, replies = Store(spark, path), []

    def merge_replies() -> None:
        if replies:
            rows = materialize(knowledge.usage_rows(spark.createDataFrame(replies, "name_id string, value string")), "enrich_rows")
            store.transact(lambda base: {"name_enrichments": _told(base, rows, base.rows("names", rows.select(F.col("name_id").alias("id"))))})
            replies.clear()

    try:
        for n, r in enumerate(asked, 1):
            for what in ("lookup", "related"):
                reply = source.usage(what, r["label"], key)
                source.sleep(pause)
                if reply:
                    replies.append((r["id"], reply))
            if n % ASKED == 0:
                merge_replies()
    finally:
        merge_replies()
    return len(asked)
