import base64
import hashlib
import random
from collections import Counter

import pytest

from stemma.llm import html_text, warc

PAGES = "page_id long, url string, html string, text string, digest string, ties int"


@pytest.fixture(scope="module")
def raw():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    made = []
    for i in range(40):
        body = "".join(f"<p>{' '.join(word() for _ in range(12))} &amp; x{i}</p>" for _ in range(r.randint(1, 4)))
        made.append((i, f"https://h{i % 3}.example.com/{i}", f"<html><head><title>t{i}</title></head><body><nav><ul><li>Home<li>{word()}</ul></nav><article><h1>Title {i}</h1>{body}</article><footer>same foot</footer></body></html>"))
    made += [(100, None, None), (101, "https://x/\r\ny é", ""), (102, "https://h0.example.com/5", made[5][2]), (103, "u", made[5][2]), (5, made[5][1], made[5][2]), (None, "u", made[5][2]), (104, "u", "<p>" + "long " * 60_000)]
    return [(*x, "old", "d", 1) for x in made]


@pytest.fixture(scope="module")
def pages(spark, raw):
    return spark.createDataFrame(raw, PAGES).repartition(3).cache()


@pytest.mark.parametrize("zip64,size,gzip", [(False, 16 << 20, False), (True, 3000, False), (False, 3000, True)])
def test_warc_round_trip(spark, pages, raw, zip64, size, gzip):
    got = warc.unpack(warc.pack(pages, archive_bytes=size, zip64=zip64, gzip=gzip)).collect()
    assert len(got) == len(raw)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h, *_ in raw:
        first[digest(h)] = min(first.get(digest(h), 10**9), 10**9 if i is None else i)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((None if i is None else str(i), len((h or "").encode()), digest(h)) for i, _, h, *_ in raw)
    assert Counter(r["payload_digest"] for r in got if r["record_type"] == "response") == Counter(list(first))
    for r in got:
        if r["record_type"] == "response":
            assert int(r["page_id"]) == first[r["payload_digest"]] and r["refers_to"] is None and digest(r["payload"].decode()) == r["payload_digest"]
        else:
            assert int(r["refers_to"]) == first[r["payload_digest"]] and r["payload"] is None
    assert {r["url"] for r in got} == {u for _, u, *_ in raw}
    all_full = warc.unpack(warc.pack(pages, least_bytes=10**9)).collect()
    assert all(r["record_type"] == "response" for r in all_full)
    assert warc.unpack(warc.pack(pages.where("false"))).count() == 0


def test_archive_files(spark, pages, raw, tmp_path):
    warc.export(warc.pack(pages, archive_bytes=4000), str(tmp_path))
    files = sorted(tmp_path.glob("*.wacz"))
    assert len(files) > 3
    read = lambda df: Counter(map(str, df.collect()))
    assert read(warc.unpack_files(spark, str(tmp_path))) == read(warc.unpack(warc.pack(pages, archive_bytes=4000)))
    reads = []
    with open(files[0], "rb") as f:
        def read(at, n):
            reads.append(n)
            f.seek(at)
            return f.read(n)

        assert list(warc.read_records(files[0].stat().st_size, read))
    assert max(reads) < files[0].stat().st_size or len(files[0].read_bytes()) < 70_000


def test_zip_directories():
    import io
    import zipfile

    members = [("archive/data.warc", b"abc" * 100), ("indexes/index.cdxj", b""), ("x", b"PK\5\6" * 9)]
    for zip64 in (False, True):
        raw = warc.pack_zip(members, zip64)
        found = warc.RangeZip(len(raw), lambda at, n: raw[at : at + n])
        assert {n: found.member(n) for n in found.members} == dict(members)
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == dict(members)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 1000)
        z.comment = b"says PK\5\6 itself, and more" + b"." * 30
    raw = out.getvalue()
    found = warc.RangeZip(len(raw), lambda at, n: raw[at : at + n])
    with pytest.raises(ValueError, match="compressed"):
        found.member("a")
    for broken in (b"", raw[:-40], b"x" * 100):
        with pytest.raises(ValueError):
            warc.RangeZip(len(broken), lambda at, n: broken[at : at + n])


def test_archives_of_others():
    """Several gzip members, a gzip index with a header line and offsets as text, names without their folder."""
    import gzip
    import json

    one, two = (gzip.compress(warc._record("response", i, f"http://x/{i}", b"<p>%d</p>" % i, base64.b32encode(hashlib.sha1(b"<p>%d</p>" % i).digest()).decode(), None)) for i in (1, 2))
    lines = ["!meta 0 x"] + [f"com,x)/ 20240101000000 {json.dumps({'url': f'http://x/{i}', 'filename': f, 'offset': str(at), 'length': str(n)})}" for i, f, at, n in ((1, "a.warc.gz", 3, len(one)), (2, "archive/b.warc.gz", 0, len(two)))]
    whole = warc.pack_zip([("archive/a.warc.gz", b"xyz" + one), ("archive/b.warc.gz", two), ("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode())), ("datapackage.json", b"{}")])
    read = lambda at, n: whole[at : at + n]
    assert [(r["page_id"], r["url"], r["payload"]) for r in warc.read_records(len(whole), read)] == [("1", "http://x/1", b"<p>1</p>"), ("2", "http://x/2", b"<p>2</p>")]
    assert warc._written("http://x/a b\r\né") == "http://x/a%20b%0D%0Aé"
    for members in ([("archive/a.warc", b"")], [("indexes/a.cdxj", b'x 1 {"filename": "gone", "offset": 0, "length": 1}')]):
        bad = warc.pack_zip(members)
        with pytest.raises(ValueError):
            list(warc.read_records(len(bad), lambda at, n: bad[at : at + n]))


def test_main_text(pages, raw):
    import html
    import re

    got = html_text.extract(pages).collect()
    assert len(got) == len(raw)

    def want(h):
        if h is None or "<article>" not in h:
            return " ".join(re.sub("<[^>]*>", " ", h or "").split())
        inner = re.search("<article>(.*?)</article>", h)[1]
        return "\n\n".join(html.unescape(x) for x in re.findall("<(?:h1|p)>(.*?)</(?:h1|p)>", inner))

    assert Counter((r["page_id"], r["text"]) for r in got) == Counter((i, want(h)) for i, _, h, *_ in raw)
    assert set(pages.columns) <= set(got[0].asDict()) and html_text.extract(pages.where("false")).count() == 0


def test_template_text_is_no_slot(spark):
    rows = [(i, "http://one/", f"<div id=top>Welcome to the shop</div><div class=body><p>item {i} is nice</p><p>number {i * 7}</p></div><p>All rights reserved</p>") for i in range(8)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["text"]) for r in got} == {(i, f"item {i} is nice\n\nnumber {i * 7}") for i in range(8)}


def test_template_decides_inside_articles(spark):
    page = lambda i: f"<nav>menu</nav><article><p>Read our <b>terms</b> first</p><h1>T{i}</h1><p>item {i} is nice</p></article>"
    rows = [(i, "http://one/", page(i)) for i in range(8)] + [(100 + i, "http://two/", page(i)) for i in range(3)]
    rows += [(200 + i, "http://copies/", page(50)) for i in range(9)] + [(300 + i, "http://copies/", page(i)) for i in range(5)]
    rows += [(400, "http://one/", "<p>around</p><article><p>Read our <b>terms</b> first</p></article>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"T{i}\n\nitem {i} is nice" for i in range(8)} | {100 + i: f"Read our terms first\n\nT{i}\n\nitem {i} is nice" for i in range(3)}
    want |= {200 + i: "T50\n\nitem 50 is nice" for i in range(9)} | {300 + i: want[i] for i in range(5)} | {400: ""}
    assert got == want


def test_classes_nest_whole():
    root = html_text.ROOT
    assert html_text.nested([[(root, None)], [(1, root), (2, 99)], [(3, 2)], [(4, 98), (5, 4)], [(6, 5)], [(7, None), (8, None)], [(9, None), (10, 98)]]) == [[root], [1, 2], [7, 8], [3]]


def deduced(pages, features=True):
    """The main texts of one host's pages, by plain dictionaries over all of them."""
    found = [html_text.occurrences(p) for p in dict.fromkeys(pages)]
    typical = sum(f[html_text.ROOT][2] for f in found) / len(found)
    classes = {}
    for token in {t for f in found for t in f}:
        vector = tuple(f[token][1] if token in f else 0 for f in found)
        built = next(f[token][2] for f in found if token in f) == 0 or token == html_text.ROOT
        if set(vector) <= {0, 1} and (built or len(found) >= html_text.LEAST_PAGES):
            parent = next(f[token][0] for f in found if token in f)
            classes.setdefault(vector, []).append((token, parent, built, next(f[token][2] for f in found if token in f)))
    valid = []
    for vector, members in classes.items():
        n, built = sum(vector), any(b for _, _, b, _ in members)
        often = n >= html_text.SUPPORT * len(found)
        layout = n >= html_text.LEAST_PAGES and n >= html_text.LAYOUT * len(found) and built and len(members) >= html_text.LEAST_SIZE
        if (often or layout) and (built or 2 * sum(c for _, _, b, c in members if not b) < typical):
            valid.append([(t, parent) for t, parent, *_ in members])
    template = {t: n for n, c in enumerate(sorted(html_text.nested(valid))) for t in c}
    marked = [html_text.mark(p, template, features) for p in pages]
    facts = {}
    for _, told in marked:
        for kind, key, up, flag, h, chars in told:
            x = facts.setdefault((kind, key, up), [0, 0, 0, 0, set()])
            x[:4] = [x[0] + 1, x[1] + flag, x[2] + chars, x[3] + flag * chars * (kind == html_text.SAYS)]
            x[4] |= {h} - {None}
    *lists, inner = html_text.decide((*k, *v[:4], len(v[4]), min(v[4], default=None), max(v[4], default=None)) for k, v in facts.items())
    main, rest, linked, mixed = map(set, lists)
    out = []
    for blocks, _ in marked:
        inside = any(b[0] in main for b in blocks)
        fits = [slot in (main if inside else rest) and not gone and not (link and slot in linked) for slot, _, link, gone, _ in blocks]
        own = [n for n, (fit, b) in enumerate(zip(fits, blocks)) if fit and (b[1] < 0 or b[1] in mixed)]
        taken = {*own, *(n for n in range(own[0], own[-1]) if fits[n])} if own and inside and inner else own
        out.append("\n\n".join(blocks[n][4] for n in sorted(taken)))
    return out


@pytest.mark.parametrize("features", [True, False])
@pytest.mark.parametrize("tag", ["article", "div class=x7"])
def test_articles_keep_what_they_share(spark, tag, features):
    """Bylines and standing headings of articles stay, as do closing words inside; what stands around the article goes."""
    r = random.Random(21)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        blocks = [say(5), ("By Ann", "By Bob", "By Cy")[i % 3 if i % 4 else 0], say(30), "Background", *(say(25) for _ in range(i % 3 + 1)), "What it means", say(12)]
        body = "".join(f"<h1>{b}</h1>" if n == 0 else f"<h2>{b}</h2>" if b in ("Background", "What it means") else f"<p>{b}</p>" for n, b in enumerate(blocks))
        rows.append((i, f"http://h{i % 2}/", f"<body><div class=x1><a href=/>Home</a> <a href=/n>News</a></div><div class=x2>The daily paper</div><{tag}>{body}</{tag.split()[0]}><div class=x3>Read it every day</div></body>"))
        want[i] = "\n\n".join(blocks)
    got = {x["page_id"]: x["text"] for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), features=features).collect()}
    assert got == want


@pytest.mark.parametrize("features", [True, False])
def test_extraction_equals_plain_deduction(spark, raw, features):
    from collections import defaultdict

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    rows = [x[:3] for x in raw]
    for i in range(60):  # three layouts, one of them with its tokens in another order on some pages, and broken tags
        side = f"<div class=box><h4>More</h4><p>Same promise</p><ul><li><a href=x>{word()} {word()}</a><li><a>{word()}</a></ul></div>"
        body = "".join(f"<p>{' '.join(word() for _ in range(r.randint(3, 30)))}" for _ in range(r.randint(1, 5)))
        parts = [f"<div id=c{i % 2}><h2>{word()} {word()}</h2>{body}</div>", side if i % 3 == 0 else "", f"<div class=f>fine print {i % 4}</div>"]
        rows.append((1000 + i, "http://layouts/", "".join(parts if i % 6 else parts[::-1])))
    by_host = defaultdict(list)
    for i, url, h in rows:
        by_host[(url or "").split("//")[-1].split("/")[0] if "//" in (url or "") else ""].append((i, h or ""))
    want = Counter((i, t) for pages in by_host.values() for (i, _), t in zip(pages, deduced([h for _, h in pages], features)))
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), features=features).collect()
    assert Counter((x["page_id"], x["text"]) for x in got) == want


def test_articles_without_article_tags(spark):
    """Pages whose article is a plain div among menus, adverts and notices of 12 variants, without any telling name."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    adverts, feet = [say(9) for _ in range(12)], [say(8) for _ in range(12)]
    rows, want = [], {}
    for i in range(200):
        blocks = [say(4), *(say(r.randint(5, 40)) for _ in range(r.randint(1, 6)))]
        menu = "".join(f"<li><a href=/{k}>{k}</a></li>" for k in adverts[i % 12].split())
        head, *rest = blocks
        rows.append((i, f"http://h{i % 4}/", f"<body><div class=x1><ul>{menu}</ul></div><div class=x2>{adverts[i % 12]}</div><div class=x3><h1>{head}</h1>{''.join(f'<p>{b}</p>' for b in rest)}</div><div class=x4>{feet[i % 12]}</div></body>"))
        want[i] = "\n\n".join(blocks)
    got = {x["page_id"]: x["text"] for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_given_articles_are_found_without_their_tags(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    both = [{x["page_id"]: x["text"] for x in html_text.extract(pages, features=f).collect()} for f in (True, False)]
    want = {}
    for x in pages.collect():
        inner = re.search("<article>(.*?)</article>", x["html"], re.S)[1].replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        blocks = (" ".join(html.unescape(b).split()) for b in re.split("</?(?:p|h1)>", inner))
        want[x["page_id"]] = "\n\n".join(b for b in blocks if b)
    assert both[0] == want and sum(both[1][i] == t for i, t in want.items()) >= 0.9 * len(want)


def test_copies_on_a_host_keep_their_article(spark):
    """Near copies that are most of a host's pages make no template of their article."""
    r = random.Random(8)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    shared = [say(20) for _ in range(6)]
    page = lambda paragraphs: f"<nav>menu</nav><article>{''.join(f'<p>{x}</p>' for x in paragraphs)}</article><footer>same</footer>"
    texts = {i: [*shared, say(4)] if i < 40 else [say(20) for _ in range(5)] for i in range(60)}
    got = {x["page_id"]: x["text"] for x in html_text.extract(spark.createDataFrame([(i, "http://h/", page(t)) for i, t in texts.items()], "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join(t) for i, t in texts.items()}


@pytest.mark.parametrize("page,text", [
    ("<main><p>a<p>b<br>c&lt;d<div class='comments'><p>no</p></div></main><aside>x</aside>", "a\n\nb c<d"),
    ("<article><header><h1>T</h1><p>by me</p></header><p>x<script>var a='</p>'</script>y</p></article>", "T\n\nxy"),
    ("<body><form>f</form><p class=notice>n</p><p>k</p><!-- <p>c</p> --><footer>z", "k"), ("", ""), ("plain < 3 text", "plain < 3 text"), ("<p>open <b>bold <i>both</b> end", "open bold both end")])
def test_markup(page, text):
    assert deduced([page]) == [text]
