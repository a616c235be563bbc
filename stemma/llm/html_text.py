"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its elements, told apart by their path of tags with class and id, and its text blocks, told apart by
their element's path and their text. A token's occurrence vector says how often it occurs in each page of a host. Tokens
of one host that occur once in each page that has them, and in the same pages, form a class; vectors are compared by two
sums of hashes over pages, which combine before the shuffle, so a host of any size is cheap and nothing gathers its pages.

* A class is large and frequent enough if SUPPORT of the host's distinct pages have it, or if it holds an element, has
  LEAST_SIZE tokens or more and is on LEAST_PAGES pages and LAYOUT of all (a layout that only some pages share). Texts
  alone are no template if they make up half of a page: those are copies of an article.
* Classes nest from the root down: one is kept whole if a member of it hangs on an element of a kept class, and dropped
  whole otherwise. A class whose tokens come in another order on another page of the host is no template either.
* The kept classes' elements, opened and closed, cut a page into slots. What a slot holds over all pages of its host
  decides about it. A page votes for the innermost template element that holds REGION of its running text (text outside
  links that is no template); elements that win half of the pages that have them are the host's main regions. Text comes
  from slots in a main region, unless a slot's texts repeat far more than those of the region's largest slot; blocks of
  links go where a slot is mostly links. A page without any block in a main region gives all its slots.
* Text of the template that stands between a page's first and last text from the slots of a main region belongs to the article
  (a byline that many articles have, a heading that all have), unless the region is the whole page; before and after
  them it is the template's.
* Tags, roles, class names and ids are features on top of that (features=False leaves them out): text in article or main
  elements weighs more in the vote, text in menus, asides, footers, forms and the like weighs nothing and is left out.

Hosts with fewer than LEAST_PAGES distinct pages have no text in their template, as everything on a single page occurs once in
each page. Null html is an empty page with empty text, a null url belongs to the host ''. Broken markup is read as far
as tags can be told. A very long page is read whole, in one task, like any other. Repeated rows each have their result;
rows of a host with the same html count as one page for the template. Columns of the input with the
name of an output are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.common import others, pieces, workers_find_package
from stemma.sources.shared import materialize

SUPPORT, LEAST_PAGES, LEAST_SIZE, LAYOUT = 0.5, 5, 3, 0.02
#: Share of a page's running text that its region holds; what text inside article or main weighs.
REGION, MAIN_WEIGHT = 0.8, 8
#: A slot of JUDGED texts or more whose share of distinct ones is below RARE times that of the region's largest is no text.
RARE, JUDGED = 0.25, 20
#: Hosts with this part of all pages or more are hot; their templates are broadcast if they have so many tokens at most.
HOT, BROADCAST_TOKENS = 200, 1_000_000
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"<]*"|'[^'<]*'|["'])*+)>|<[!?/][^<>]*>""", re.S)
RAW = re.compile(r"</(script|style|textarea|title|xmp|noframes|noscript|template|iframe)[\s/>]", re.I)
RAW_TAGS = {"script", "style", "textarea", "title", "xmp", "noframes", "noscript", "template", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: An opening tag ends these elements if they are open inside the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
IN_P = {"td", "th", "li", "div", "section", "article", "main", "body", "html", "button", "blockquote", "figure", "aside", "nav", "footer", "header", "form"}
AROUND = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
NAMES = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar"}
MAIN = {"article", "main"}
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][^\s=<>"'/]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)""")


def _hash(kind: str, what: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}{what}".encode("utf-8", "surrogatepass")) - (1 << 63)


ROOT = _hash("root", "")


class Element:
    #: path: a hash of the tags, classes and ids down to the element; above: its parent's.
    __slots__ = ("tag", "path", "above", "around", "main", "marks", "heading", "link")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        values = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        names = f"{values.get('class', '')} {values.get('id', '')}".strip().lower()
        self.tag = tag
        self.above = parent.path if parent else ROOT
        self.path = _hash(str(self.above), f"/{tag}.{names}")
        self.marks = tag in MAIN or values.get("role") == "main"
        self.main = self.marks or bool(parent and parent.main)
        self.link = tag == "a" or bool(parent and parent.link)
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        # A header inside the article may hold its headings.
        own = tag in AROUND or values.get("role") in ROLES or "hidden" in values
        own = own or (tag not in HEADINGS and tag not in MAIN and tag not in ("body", "html") and not NAMES.isdisjoint(re.split(r"[^a-z]+", names)))
        self.around = "out" if own or (parent and parent.around == "out") else "header" if tag == "header" or (parent and parent.around == "header") else ""


def tokens(page: str) -> Iterator[tuple[str, Element | None, str, bool]]:
    """("open" or "single" or "close", element, "", False) and ("text", element, block, mostly links) in page order; blocks
    are decoded, with single spaces."""
    stack: list[Element] = []
    held: list[str] = []
    owner: Element | None = None
    linked = 0

    def flush():
        nonlocal owner, linked
        block = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        found, links, owner, linked = owner, linked, None, 0
        if block:
            yield "text", found, block, 2 * links > len(block)

    def text(part: str):
        nonlocal owner, linked
        if part:
            held.append(part)
            if not part.isspace():
                owner = owner or (stack[-1] if stack else None)
                linked += len(part) if stack and stack[-1].link else 0

    def close(i: int):
        for x in reversed(stack[i:]):
            yield "close", x, "", False
        del stack[i:]

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if i is not None:
                if tag in BLOCKS:
                    yield from flush()
                yield from close(i)
            continue
        if tag in BLOCKS:
            yield from flush()
            if tag != "body" and tag != "html":
                closed, within = ENDS.get(tag, ({"p"}, IN_P))
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in closed:
                        yield from close(i)
                        break
                    if stack[i].tag in within:
                        break
        element = Element(tag, m[3], stack[-1] if stack else None)
        alone = tag in VOID or tag in RAW_TAGS or m[3].endswith("/")
        yield "single" if alone else "open", element, "", False
        if tag == "br":
            held.append(" ")
        elif tag in RAW_TAGS:
            end = RAW.search(page, at)
            while end and end[1].lower() != tag:
                end = RAW.search(page, end.end())
            at = len(page) if not end else page.find(">", end.end() - 1) + 1 or len(page)
        elif not alone:
            stack.append(element)
    yield from flush()


def _text_token(element: Element | None, block: str) -> int:
    return _hash("text", f"{element.path if element else ROOT} {block}")


def occurrences(page: str) -> dict[int, list]:
    """token: [parent (None for the root and for texts), times, characters (0 for elements)]; the root occurs once in any
    page and has all its characters."""
    found: dict[int, list] = {ROOT: [None, 1, 0]}
    for kind, element, block, _ in tokens(page):
        if kind == "open" or kind == "single":
            found.setdefault(element.path, [element.above, 0, 0])[1] += 1
        elif kind == "text":
            found.setdefault(_text_token(element, block), [None, 0, len(block)])[1] += 1
            found[ROOT][2] += len(block)
    return found


def nested(classes: list[list[tuple[int, int | None]]]) -> list[list[int]]:
    """The tokens of the classes that nest, each class whole or not at all; classes hold (token, parent's token or None)."""
    kept: set[int] = {ROOT}
    made: list[list[int]] = []
    left = [c for c in classes if c]
    while True:
        # Texts alone hang on their slot.
        fits = [any(token == ROOT or parent in kept for token, parent in c) or all(parent is None for _, parent in c) for c in left]
        if not any(fits):
            return made
        for c, fit in zip(left, fits):
            if fit:
                made.append(sorted(token for token, _ in c))
                kept.update(made[-1])
        left = [c for c, fit in zip(left, fits) if not fit]


def _rows(columns: dict[str, pa.DataType], lists: list[list[tuple]]) -> pa.Array:
    """A list of structs for each row."""
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    flat = list(zip(*(t for x in lists for t in x))) or [()] * len(columns)
    made = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(flat, columns.values())], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)


def templates(pages: DataFrame, html: str = "html", host: str = "__host") -> DataFrame:
    """(host, template: (token, cls) for each token of the host's template) from pages with a host column."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(host).alias("host"), F.xxhash64(body, F.col(host)).alias("page"), body.alias("html"))
    workers_find_package(pages.sparkSession)
    kinds = {"token": pa.int64(), "parent": pa.int64(), "n": pa.int64(), "chars": pa.int64()}

    def emit(batches):
        for batch in (part for whole in batches for part in pieces(whole)):
            made = [[(t, *about) for t, about in occurrences(x).items()] for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), _rows(kinds, made)], names=["host", "page", "found"])

    # Copies of a page are one page: dropped before anything is counted.
    seen = rows.mapInArrow(emit, "host string, page bigint, found array<struct<token:bigint,parent:bigint,n:bigint,chars:bigint>>").dropDuplicates(["host", "page"]).select("host", "page", F.inline("found"))
    mixed = F.xxhash64("page", "n")
    half = lambda at: F.sum(F.shiftrightunsigned(mixed, at).bitwiseAND(0xFFFFFFFF))
    vectors = seen.groupBy("host", "token").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("total"), F.sum("chars").alias("sum"), half(0).alias("v1"), half(32).alias("v2"))
    # Most tokens are texts of a single page; roots, which say how many pages a host has, occur once in each.
    element = (F.col("sum") == 0) | (F.col("token") == ROOT)
    vectors = materialize(vectors.where((F.col("total") == F.col("pages")) & ((F.col("pages") > 1) | element)), "html_vectors")
    roots = vectors.where(F.col("token") == ROOT).select("host", F.col("pages").alias("all"), (F.col("sum") / F.col("pages")).alias("typical"))
    counted = vectors.withColumn("built", element).join(roots, "host").where(F.col("built") | (F.col("all") >= LEAST_PAGES))
    often = F.col("pages") >= SUPPORT * F.col("all")
    layout = (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LAYOUT * F.col("all"))
    classes = (counted.where(often | layout).groupBy("host", "typical", "all", "pages", "v1", "v2")
               .agg(F.collect_list(F.struct("token", "parent")).alias("tokens"), F.sum(F.when(~F.col("built"), F.col("sum") / F.col("pages")).otherwise(0)).alias("chars"), F.max("built").alias("built")))
    large = F.col("built") & (F.size("tokens") >= LEAST_SIZE)
    short = F.col("built") | (2 * F.col("chars") < F.col("typical"))
    # A template is no longer than 1 / LAYOUT pages: each of its tokens is in that share of the pages or more.
    made = classes.where((often | large) & short).groupBy("host").agg(F.collect_list("tokens").alias("classes"))

    def nest(batches):
        for batch in (part for whole in batches for part in pieces(whole)):
            found = [nested([[(x["token"], x["parent"]) for x in c] for c in row]) for row in batch.column("classes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), _rows({"token": pa.int64(), "cls": pa.int32()}, [[(t, n) for n, c in enumerate(sorted(x)) for t in c] for x in found])], names=["host", "template"])

    return made.mapInArrow(nest, "host string, template array<struct<token:bigint,cls:int>>")


#: Kinds of a page's facts: an element that it has, a block that is no template, the order of a class's tokens.
HAS, SAYS, ORDER = 0, 1, 2
#: What turns an element's token into that of its end.
ENDED = 0x5DEECE66D


def mark(page: str, template: dict[int, int], features: bool = True) -> tuple[list[tuple], list[tuple]]:
    """The page's blocks (slot, cls or -1, link, out, text), and its facts (kind, key, up, vote, h, chars)."""
    chain, slot = [ROOT], ROOT
    up: dict[int, int | None] = {ROOT: None}
    marks: set[int] = set()
    order: dict[int, list[int]] = defaultdict(list)
    weight: dict[int, int] = defaultdict(int)
    said, headed = defaultdict(int), defaultdict(int)
    blocks, facts = [], []
    for kind, element, block, link in tokens(page):
        if kind == "text":
            out = features and element is not None and (element.around == "out" or element.around == "header" and not (element.main and element.heading))
            token = _text_token(element, block)
            cls = template.get(token, -1)
            blocks.append((slot, cls, link, out, block))
            if cls >= 0:
                order[cls].append(token)
                continue
            facts.append((SAYS, slot, chain[-1], int(link), token, len(block)))
            if not link and not out:
                heading = element is not None and element.heading
                for x in chain:
                    weight[x] += len(block) * (MAIN_WEIGHT if features and element is not None and element.main else 1)
                    said[x] += 1
                    headed[x] += heading
        elif element.path in template:
            path = element.path
            if kind == "close":
                if path in chain:
                    del chain[chain.index(path) :]
                    slot = path ^ ENDED
                continue
            order[template[path]].append(path)
            up[path], slot = chain[-1], path
            if kind == "open":
                chain.append(path)
            if features and element.marks:
                marks.add(path)
    region = _region(up, weight, said, headed, marks)
    facts += [(HAS, x, above, int(x == region), None, 0) for x, above in up.items()]
    facts += [(ORDER, cls, None, 0, xxhash.xxh64_intdigest(repr(x)) - (1 << 63), 0) for cls, x in order.items()]
    return blocks, facts


def _region(up: dict, weight: dict, said: dict, headed: dict, marks: set[int]) -> int | None:
    """The innermost element with REGION of the weight, two blocks at least, and the headings that go with it."""
    if not weight[ROOT]:
        return None
    inner = defaultdict(list)
    for x, above in up.items():
        inner[above].append(x)
    at = ROOT
    while inner[at]:
        to = max(inner[at], key=lambda x: weight[x])
        left, left_headed = said[at] - said[to], headed[at] - headed[to]
        if weight[to] < REGION * weight[at] or said[to] < 2 and to not in marks or left and left == left_headed or at in marks and to not in marks:
            break
        at = to
    return at


def decide(facts: Iterable[tuple]) -> tuple[list[int], list[int], list[int], list[int], bool]:
    """Of one host's summed facts (kind, key, up, n, votes, chars, links, distinct, least, most): the slots that hold main
    text, other slots, slots that are mostly links, classes whose order differs between pages, and whether the main regions
    are less than the whole page."""
    facts = list(facts)
    up = {key: above for kind, key, above, *_ in facts if kind == HAS}
    wins = {key for kind, key, _, n, votes, *_ in facts if kind == HAS and 2 * votes >= n}

    def ancestors(x):
        while x is not None:
            yield x
            x = up.get(x)

    outer = {a for x in wins for a in list(ancestors(x))[1:]}
    regions = (wins - outer) or {ROOT}
    slots = defaultdict(lambda: [0, 0, 0, 0, False])
    for kind, key, above, n, _, chars, links, distinct, *_ in facts:
        if kind == SAYS:
            mine = slots[key]
            mine[:] = [mine[0] + n, mine[1] + chars, mine[2] + links, mine[3] + distinct, any(a in regions for a in ancestors(above))]
    largest = max(((chars, distinct / n) for n, chars, links, distinct, inside in slots.values() if inside and 2 * links <= chars), default=(0, 0.0))[1]
    text = {key for key, (n, _, _, distinct, inside) in slots.items() if inside and not (n >= JUDGED and distinct < RARE * largest * n)}
    # A slot that only template text fills has no facts of its own; its element says where it lies.
    text |= {key for x in up for key in (x, x ^ ENDED) if key not in slots and any(a in regions for a in ancestors(x if key == x else up[x]))}
    return (sorted(text), sorted(k for k, v in slots.items() if not v[4]), sorted(k for k, v in slots.items() if 2 * v[2] > v[1]),
            sorted(key for kind, key, *_, least, most in facts if kind == ORDER and least != most), ROOT not in regions)


def with_host(pages: DataFrame, url: str = "url", out: str = "__host") -> DataFrame:
    return pages.withColumn(out, F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))


def _with_template(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with __host) and their host's template."""
    hosts = materialize(rows.groupBy(F.col("__host").alias("host")).agg(F.count(F.lit(1)).alias("rows")), "html_hosts")
    total = hosts.agg(F.sum("rows")).first()[0] or 0
    hot = found.join(hosts.where(F.col("rows") * HOT >= total), "host").select(F.col("host").alias("__host"), F.col("template").alias("__hot"))
    cold = found.select(F.col("host").alias("__by"), F.col("template").alias("__cold"))
    if (hot.agg(F.sum(F.size("__hot"))).first()[0] or 0) > BROADCAST_TOKENS:
        return rows.join(cold, F.col("__host") == F.col("__by"), "left").select(*rows.columns, F.col("__cold").alias("__template"))
    # At most HOT hosts have so many pages; their templates go everywhere, and their pages spread by row instead of host.
    rows = rows.join(F.broadcast(hot), "__host", "left")
    spread = F.concat(F.lit("\u0000"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).cast("string"))
    rows = rows.withColumn("__by", F.when(F.col("__hot").isNull(), F.col("__host")).otherwise(spread))
    return rows.join(cold, "__by", "left").drop("__by").withColumn("__template", F.coalesce("__hot", "__cold")).drop("__hot", "__cold")


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None, features: bool = True) -> DataFrame:
    """pages with text (the main text, empty if there is none) and n_slots (the slots it came from)."""
    hosted = with_host(pages, url)
    found = materialize(templates(hosted, html), "html_templates")
    kept = [c for c in others(pages, "text", "n_slots") if keep is None or c in keep]
    rows = hosted.select(F.struct(F.lit(True).alias("__here"), *(F.col(f"`{c}`") for c in kept)).alias("__row"), F.col(html).alias("__html"), "__host")
    held = {"slot": pa.int64(), "cls": pa.int32(), "link": pa.bool_(), "out": pa.bool_(), "text": pa.string()}
    told = {"kind": pa.int8(), "key": pa.int64(), "up": pa.int64(), "flag": pa.int8(), "h": pa.int64(), "chars": pa.int64()}
    joined = _with_template(rows, found)
    added = "__blocks array<struct<slot:bigint,cls:int,link:boolean,out:boolean,text:string>>, __facts array<struct<kind:tinyint,key:bigint,up:bigint,flag:tinyint,h:bigint,chars:bigint>>"
    schema = T.StructType([*joined.select("__row", "__host").schema, *T.StructType.fromDDL(added)])

    def cut(batches):
        known: dict[str, dict[int, int]] = {}
        for batch in (part for whole in batches for part in pieces(whole)):
            blocks, facts = [], []
            for x, host, template in zip(batch.column("__html"), batch.column("__host").to_pylist(), batch.column("__template")):
                if host not in known:
                    if len(known) > HOT:
                        known.clear()
                    raw = template.values
                    known[host] = dict(zip(*(raw.field(i).to_pylist() for i in (0, 1)))) if raw is not None else {}
                one, other = mark(x.as_py() or "", known[host], features)
                blocks.append(one)
                facts.append(other)
            yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("__host"), _rows(held, blocks), _rows(told, facts)], names=["__row", "__host", "__blocks", "__facts"])

    marked = materialize(joined.mapInArrow(cut, schema), "html_slots", compression="zstd")
    links = F.when(F.col("kind") == SAYS, F.col("flag") * F.col("chars")).otherwise(0)
    summed = (marked.select(F.col("__host").alias("host"), F.inline("__facts")).groupBy("host", "kind", "key", "up")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("votes"), F.sum("chars").alias("chars"), F.sum(links).alias("links"), F.approx_count_distinct("h").alias("distinct"), F.min("h").alias("least"), F.max("h").alias("most")))
    # A host has a few facts for each token of its template, however many pages it has.
    by_host = summed.groupBy("host").agg(F.collect_list(F.struct("kind", "key", "up", "n", "votes", "chars", "links", "distinct", "least", "most")).alias("facts"))

    def judge(batches):
        for batch in batches:
            made = [decide(tuple(x.values()) for x in row) for row in batch.column("facts").to_pylist()]
            lists = (pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in range(4))
            yield pa.RecordBatch.from_arrays([batch.column("host"), *lists, pa.array([m[4] for m in made], pa.bool_())], names=["host", "main", "rest", "linked", "mixed", "inner"])

    judged = materialize(by_host.mapInArrow(judge, "host string, main array<bigint>, rest array<bigint>, linked array<bigint>, mixed array<bigint>, inner boolean"), "html_slots_judged")
    tokens_all = judged.agg(F.sum(F.size("main") + F.size("rest"))).first()[0] or 0
    # Slots of all hosts together: broadcast below the same bound as templates, else joined, where adaptive execution splits hot hosts.
    slots = judged.withColumnRenamed("host", "__host")
    texts = marked.drop("__facts").join(F.broadcast(slots) if tokens_all <= BROADCAST_TOKENS else slots, "__host")
    in_main = F.exists("__blocks", lambda b: F.array_contains("main", b["slot"]))
    here = lambda b: F.when(in_main, F.array_contains("main", b["slot"])).otherwise(F.array_contains("rest", b["slot"]))
    plain = lambda b: (b["cls"] < 0) | F.array_contains("mixed", b["cls"].cast("bigint"))
    fits = lambda b: ~b["out"] & here(b) & ~(b["link"] & F.array_contains("linked", b["slot"]))
    # Places of the first and the last text from slots; none are between where the region is the whole page.
    done = texts.withColumn("__plain", F.transform("__blocks", lambda b: fits(b) & plain(b)))
    first = F.array_position("__plain", True)
    done = done.withColumns({"__first": first, "__last": F.when(F.col("inner") & in_main & (first > 0), F.size("__plain") + 1 - F.array_position(F.reverse("__plain"), True)).otherwise(0)})
    between = lambda i: (i + 1 > F.col("__first")) & (i + 1 < F.col("__last"))
    done = done.withColumn("__chosen", F.filter("__blocks", lambda b, i: fits(b) & (plain(b) | between(i))))
    return done.select(*(F.col(f"__row.`{c}`") for c in kept), F.array_join(F.col("__chosen.text"), "\n\n").alias("text"), F.size(F.array_distinct("__chosen.slot")).alias("n_slots"))
