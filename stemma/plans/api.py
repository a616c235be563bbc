"""The service's routes as functions of a catalogue: parameters are checked and clamped, results are plain data.

A missing required parameter raises BadRequest, an unknown name NotFound. Results are bounded by the routes' limits, so
they come to the driver; the tables behind them never do.
"""

from __future__ import annotations

from dataclasses import asdict
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.catalog import Catalog
from stemma.operators import graph, layout, search, tree, trees


#: What a search result shows.
RESULT = ("id", "label", "native_label", "language", "gender")


class BadRequest(ValueError):
    pass


class NotFound(LookupError):
    pass


def _number(value, default: int, low: int | None = None, high: int | None = None) -> int:
    try:
        n = int(value)
    except (TypeError, ValueError):
        n = default
    n = n if low is None else max(low, n)
    return n if high is None else min(high, n)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Service:
    def __init__(self, catalog: Catalog, postings: DataFrame | None = None):
        """postings: of a catalogue that wasn't stored; a stored one has its own."""
        self.catalog = catalog
        self.index = search.StoredIndex(catalog) if catalog.base else search.LabelIndex(postings, catalog.names) if postings is not None else None
        self.both = graph.incident(catalog.relations, "name_a", "name_b", "confidence")
        self._parts: DataFrame | None = None

    @property
    def parts(self) -> DataFrame:
        if self._parts is None:
            self._parts = graph.components(self.catalog.relations).select("id", "component")
        return self._parts

    def names_search(self, q: str = "", lang: str | None = None, page=1, limit=None, page_size=None, suggestions=False, meta: str | None = None):
        if meta == "languages":
            return _rows(search.language_facets(self.catalog.names))
        size = _number(limit if limit is not None else page_size, search.PAGE, 1, search.LARGEST_PAGE)
        at = _number(page, 1, 1)
        if suggestions:
            return _rows(search.suggest(self.catalog, q, size, self.index).select(*RESULT)) if q.strip() else []
        if not q.strip():
            return {"results": [], "total": 0, "page": at, "page_size": size}
        found = search.hits(self.catalog, q, lang, self.index)
        return {"results": _rows(search.page_of(found, self.catalog, at, size).select(*RESULT)), "total": found.count(), "page": at, "page_size": size}

    def name(self, name_id: str) -> dict:
        found = _rows(search.detail(self.catalog, name_id))
        if not found:
            raise NotFound(name_id)
        return found[0]

    def _graph(self, nodes: DataFrame) -> dict:
        """Nodes (id, depth, parent) with labels, and the edges to their parents with the relation's confidence."""
        said = self.both.select(F.col("id").alias("parent"), F.col("other").alias("id"), "confidence")
        sure = nodes.select("id", "parent").join(said, ["id", "parent"]).groupBy("id").agg(F.min("confidence").alias("confidence"))
        labelled = nodes.join(self.catalog.names.select("id", *tree.SHOWN), "id").join(sure, "id", "left").withColumn("role", F.lit("cognate")).orderBy("depth", "id")
        rows = _rows(labelled)
        edges = [{"source": r["parent"], "target": r["id"], "confidence": r["confidence"], "kind": "cognate"} for r in rows if r["parent"]]
        return {"nodes": [{k: v for k, v in r.items() if k not in ("parent", "confidence")} for r in rows], "edges": edges}

    def graph_expand(self, node_id: str | None, hop=None, most=None) -> dict:
        """One hop cuts the nodes only, so its edges may lead to none of them."""
        if not node_id:
            raise BadRequest("a node is required")
        size = _number(most, graph.FOCUS, 1, 60)
        if str(hop) != "1":
            return self._graph(graph.neighborhood(self.catalog.names, self.both, node_id, size))
        near = graph.expand(self.catalog.names, self.both, node_id).select("id", F.lit(1).alias("depth"), F.lit(node_id).alias("parent"))
        root = self.catalog.names.where(F.col("id") == node_id).select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
        found = self._graph(root.union(near)) if not root.isEmpty() else {"nodes": [], "edges": []}
        return found | {"nodes": found["nodes"][:size]}

    def graph_subgraph(self, root_id: str | None, depth=2) -> dict:
        if not root_id:
            raise BadRequest("a root is required")
        return self._graph(graph.subgraph(self.catalog.names, self.both, root_id, 1 if str(depth) == "1" else 2))

    def graph_constellation(self, name: str | None = None) -> dict:
        found = graph.island_of(self.catalog.names, self.both, self.parts, name) if name else graph.constellation(self.catalog.names, self.both, self.parts)
        rows = _rows(found.join(self.catalog.names.select("id", *tree.SHOWN), "id").orderBy("hub_id", "depth", "id"))
        if name and not rows:
            raise NotFound(name)
        edges = _rows(graph.induced_edges(self.catalog.relations, found, "name_a", "name_b", "confidence")) if rows else []
        order = [r["hub_id"] for r in graph.hubs(self.both, self.parts).collect()] if not name else [rows[0]["hub_id"]]
        per = {h: {"id": h, "hub_id": h, "nodes": [], "edges": []} for h in order}
        for r in rows:
            per[r["hub_id"]]["nodes"].append({k: v for k, v in r.items() if k != "hub_id"})
        for e in edges:
            per[e["hub_id"]]["edges"].append({"source": e["a"], "target": e["b"], "confidence": e["confidence"], "kind": "cognate"})
        return {"islands": [i for i in per.values() if i["nodes"]]}

    def graph_home(self) -> dict:
        found = self.graph_constellation()
        return found | {"hub_id": found["islands"][0]["hub_id"] if found["islands"] else None}

    def graph_tree(self, root: str | None = None, featured: bool = False, rest: bool = False, width=None, height=None) -> dict:
        w, h = _number(width, 1200, 1), _number(height, 800, 1)
        if featured:
            roots = [r["id"] for r in tree.featured_roots(self.catalog).collect()]
            chosen = roots[1:] if rest else roots[:1]
            made = [tree.collapsed(t, w, h) for t in trees.shown_trees(self.catalog, chosen, w, h)] if chosen else []
            return {"trees": [self._tree(t, w, h) for t in made], "roots": roots}
        if not root:
            raise BadRequest("a root is required")
        made = tree.lineage_tree(self.catalog, root, w, h)
        if made is None:
            raise NotFound(root)
        return {"trees": [self._tree(made, w, h)], "roots": [made.root]}

    @staticmethod
    def _tree(made: tree.Tree, width: int, height: int) -> dict:
        placed, scale = layout.layout(made, width, height)
        return {"root": made.root, "nodes": [asdict(n) | dict(zip("xy", placed.get(n.id, (None, None)))) for n in made.nodes], "edges": [{"source": a, "target": b} for a, b in made.edges], "scale": scale}

    def home(self, name: str | None = None, q: str | None = None) -> str | None:
        """The id that the front page shows: the given name, else the first suggestion for a query."""
        if name and not graph.name_is_missing(self.catalog.names, name):
            return name
        found = self.names_search(q, page_size=12, suggestions=True) if q and q.strip() else []
        return found[0]["id"] if found else None

    def name_page(self, name_id: str) -> str:
        """Where a name's own page leads: the front page with that name in focus."""
        return f"/?name={quote(name_id, safe='')}"

    def search_page(self, q: str, lang: str | None = None, page=1) -> dict:
        """Facets and a page of results; a page beyond the last shows the last."""
        first = self.names_search(q, lang, page)
        last = max(1, -(-first["total"] // first["page_size"]))
        shown = self.names_search(q, lang, last) if first["page"] > last else first
        return shown | {"pages": last, "languages": self.names_search(meta="languages")}
