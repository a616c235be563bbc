"""Loads through a transport that plays the services."""

import json
import re
import urllib.parse
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stemma.catalog import Catalog
from stemma.plans import cli
from stemma.plans.load import KnowledgeLoad, Options, enrich
from stemma.sources import remote
from stemma.sources.progress import Progress

TYPE = "Q202444"


class Service:
    """Items Q1 to Q{n}, all of one type, each equal to the next three; some queries time out, some fail at first."""

    def __init__(self, n=60, reach=10_000, slow=(), broken=0, names=(1, 12, 13, 14)):
        self.n, self.reach, self.slow, self.broken, self.calls = n, reach, slow, broken, []

    def item(self, i):
        return {"item": {"value": f"http://host/entity/Q{i}"}, "itemLabel": {"value": f"name {i}"}, "langLabel": {"value": "English"}, "description": {"value": f"said {i}"}}

    def edges(self, low, high):
        return [{"a": {"value": f"http://host/entity/Q{i}"}, "b": {"value": f"http://host/entity/Q{i + 1}"}} for i in range(max(1, low), min(high, self.n)) if i % 4]

    def __call__(self, method, url, headers, body):
        self.calls.append(body.decode() if body else url)
        if self.broken:
            self.broken -= 1
            return 503, {}, b"busy"
        return 200, {}, json.dumps(self.sparql(body.decode()) if body else self.api(dict(urllib.parse.parse_qsl(url.partition("?")[2])), url)).encode()

    def sparql(self, q):
        if any(s in q for s in self.slow):
            raise TimeoutError
        number = lambda r, default: int(m[1]) if (m := re.search(r, q)) else default
        low, high = number(r"\?n >= (\d+)", 1), number(r"\?n < (\d+)", 10**9)
        size, at, after = number(r"LIMIT (\d+)", 10**9), number(r"OFFSET (\d+)", 0), number(r"\?n > (\d+)", 0)
        if "?a ?b" in q:
            known = re.findall(r"wd:(Q\d+)", q.partition("?a {")[2].partition("}")[0])
            rows = self.edges(low, high)
            rows = [r for r in rows if not known or r["a"]["value"].rpartition("/")[2] in known]
        else:
            digits = m[1] if (m := re.search(r'/entity/Q"\), "(\d+)"', q)) else ""
            rows = [self.item(i) for i in range(1, self.n + 1) if low <= i < high and i > after and str(i).startswith(digits)]
        return {"results": {"bindings": rows[at : at + size]}}

    def api(self, p, url):
        if "behindthename" in url:
            return {"names": [{"name": p["name"], "usages": [{"usage_full": "English"}], "related_names": [{"name": "kin"}]}]}
        if p["action"] == "query":
            at, size = int(p["sroffset"]), int(p["srlimit"])
            mine = self.n if "Q202444" in p["srsearch"] else 0
            page = {"query": {"searchinfo": {"totalhits": mine}, "search": [{"title": f"Q{i}"} for i in range(at + 1, min(at + size, mine) + 1)]}}
            return page | ({"continue": {"sroffset": at + size}} if at + size < mine else {})
        return {"entities": {q: {"labels": {"en": {"value": f"name {q[1:]}"}}, "descriptions": {"en": {"value": f"said {q[1:]}"}}} for q in p["ids"].split("|")}}


class Slow(Service):
    """Answers 504 to queries over more than so many numbers."""

    def __init__(self, most, **kw):
        super().__init__(**kw)
        self.most = most

    def __call__(self, method, url, headers, body):
        q = body.decode() if body else ""
        if (m := re.search(r"\?n >= (\d+) && \?n < (\d+)", q)) and int(m[2]) - int(m[1]) > self.most:
            return 504, {}, b"too long"
        if re.search(r'/entity/Q"\), "(\d+)"', q) and len(re.search(r'/entity/Q"\), "(\d+)"', q)[1]) < 2:
            return 504, {}, b"too long"
        return super().__call__(method, url, headers, body)


@pytest.fixture
def saved(spark, tmp_path):
    path = str(tmp_path / "catalog")
    Catalog.load(spark, None).save(path)
    return path


def load(spark, path, tmp_path, service, **options):
    return KnowledgeLoad(spark, path, str(tmp_path / "progress.json"), Options(**options), remote.Remote(service, lambda s: None))


def test_retries():
    service, slept = Service(broken=3), []
    source = remote.Remote(service, slept.append)
    assert json.loads(source.sparql(remote.names_window(1, 3)))["results"]["bindings"] and slept == [5, 10, 20]
    with pytest.raises(remote.SourceTimeout):
        remote.Remote(lambda *a: (500, {}, b""), slept.append).sparql("x")
    assert slept[-10:] == [5, 10, 20, 40, 60, 60, 60, 60, 60, 60]
    with pytest.raises(RuntimeError, match="400"):
        remote.Remote(lambda *a: (400, {}, b"bad"), slept.append).sparql("x")
    replies = iter([(429, {"retry-after": "7"}, b""), (200, {}, b'{"error": {"code": "x", "info": "y"}}'), (200, {}, b'{"ok": 1}')])
    slept.clear()
    assert remote.Remote(lambda *a: next(replies), slept.append).api(action="query") == '{"ok": 1}' and slept == [7, 6]
    with pytest.raises(RuntimeError, match="x: y"):
        remote.Remote(lambda *a: (200, {}, b'{"error": {"code": "x", "info": "y"}}'), slept.append).api()
    with pytest.raises(ValueError):
        remote.Remote(service).search(TYPE, 10_000, 5)


@pytest.mark.parametrize("mode", ["search", "scroll", "window"])
def test_names_by_each_mode(spark, saved, tmp_path, mode):
    made = load(spark, saved, tmp_path, Service(n=30), mode=mode, page_size=25, last=100, window=40, type=TYPE)
    made.names()
    got = Catalog.load(spark, saved)
    assert {r["wikidata_qid"] for r in got.names.collect()} == {f"Q{i}" for i in range(1, 31)}
    assert {r["content"] for r in got.enrichments.collect()} == {f"said {i}" for i in range(1, 31)}
    assert got.names.where("updated_at IS NULL").count() == 0 and got.enrichments.where("fetched_at IS NULL").count() == 0


def test_windows_split_and_loads_resume(spark, saved, tmp_path):
    slow = Slow(3000, n=9000)
    first = load(spark, saved, tmp_path, slow, mode="window", last=9001, window=9000, max_pages=2, skip_closure=True)
    assert first.names() == 2
    at = Progress.load(str(tmp_path / "progress.json"))
    assert at.windowStart and 1 < at.windowStart < 9001
    load(spark, saved, tmp_path, slow, mode="window", last=9001, window=9000, resume=True).names()
    assert Catalog.load(spark, saved).names.count() == 9000


def test_edges_are_closed_over_what_is_stored(spark, saved, tmp_path):
    service = Service(n=12)
    load(spark, saved, tmp_path, service, mode="window", last=100, window=100).names()
    for options in ({"max_pages": 1}, {"resume": True}):  # in two parts
        load(spark, saved, tmp_path, service, mode="search", page_size=6, **options).edges()
    got = Catalog.load(spark, saved)
    names = {r["id"]: int(r["wikidata_qid"][1:]) for r in got.names.collect()}
    pairs = {tuple(sorted((names[r["name_a"]], names[r["name_b"]]))) for r in got.relations.collect()}
    assert pairs == {(a, b) for low in (1, 5, 9) for a in range(low, low + 4) for b in range(a + 1, low + 4)}
    assert got.relations.where("name_a >= name_b").count() == 0


def test_search_goes_on_by_prefixes(spark, saved, tmp_path, monkeypatch):
    monkeypatch.setattr("stemma.plans.load.OFFSET_LIMIT", 20)
    load(spark, saved, tmp_path, Service(n=130), mode="search", page_size=10, type=TYPE).names()
    assert {r["wikidata_qid"] for r in Catalog.load(spark, saved).names.collect()} == {f"Q{i}" for i in range(1, 131)}


def test_enrichment(spark, saved, tmp_path):
    service = Service(n=9)
    load(spark, saved, tmp_path, service, mode="window", last=100, window=100).names()
    load(spark, saved, tmp_path, service, mode="window", last=100, window=100).edges()
    source = remote.Remote(service, lambda s: None)
    assert enrich(spark, saved, "key", limit=3, source=source) == 3
    got = Catalog.load(spark, saved).enrichments.where("source = 'behindthename'")
    assert {(r["field"], r["content"]) for r in got.collect()} == {("usage", "Usages: English"), ("related", "kin")} and got.count() == 6
    assert cli.main(["enrich", "--catalog", saved, "--key", "k", "--limit", "3"], source) == {"asked": 3}
    assert Catalog.load(spark, saved).enrichments.where("source = 'behindthename'").select("name_id").distinct().count() == 6


def test_saves_are_whole(spark, saved):
    before = Catalog.load(spark, saved)
    broken = replace(before, names=spark.createDataFrame([("1", "a")], "id string, label string"))
    filled = spark.createDataFrame([("1", "2", "x", "y", "z", "u")], before.lineage.schema)
    broken.lineage = filled.withColumn("source", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        broken.save(saved)
    assert Catalog.load(spark, saved).names.count() == 0
    with pytest.raises(FileNotFoundError):
        Catalog.load(spark, saved + "x")


def test_dictionary_command(spark, saved, tmp_path):
    import gzip

    entry = lambda word, native: json.dumps({"word": word, "lang": None, "lang_code": "de", "senses": [{"glosses": ["a male given name"]}], "pos": native})
    with gzip.open(tmp_path / "lines.jsonl.gz", "wt") as f:
        f.write("\n".join(entry(w, "name") for w in ("Otto", "OTTO", "Hugo")))
    assert cli.main(["dictionary", "--dump", str(tmp_path / "lines.jsonl.gz"), "--catalog", saved]) == {"lines": 3, "given_names": 3}
    got = {r["wk"]: (r["label"], r["language"]) for r in Catalog.load(spark, saved).names.collect()}
    assert got == {"de:otto": ("Otto", "German"), "de:hugo": ("Hugo", "German")}  # the first line of a key wins; the code says the language


def test_depths_and_order():
    from stemma.functions.unicode import locale_key
    from stemma.operators.tree import Node, Tree, depth_counts

    t = Tree("r", [Node("r", "r", None, 0, None), Node("a", "a", None, 1, "r"), Node("b", "b", None, -1, None), Node("c", "c", None, 2, "a")])
    assert depth_counts(t) == {0: 1, 1: 2, 2: 1}
    assert sorted(["Zoe", "zoe", "Éric", "eric", "Eric", "émile"], key=locale_key) == ["émile", "eric", "Eric", "Éric", "zoe", "Zoe"]
