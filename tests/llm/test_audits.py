"""Vector codes, the filter audit and benchmark decontamination against brute force and SQL."""

import glob
import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stemma.llm import audit, decontaminate, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("lead", ["op11_", "op12_", "op13_"])
def test_against_sql(spark, lead):
    name = next(n for n in __spark_entry__.queries() if n.startswith(lead))
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, SF).select(columns).collect()
    assert len(got) > 0 and Counter(map(tuple, got)) == Counter(want.fetchall())


# Vector codes.

def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label), all of one length; plain integers throughout."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    ints = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    seeds = sorted(range(len(rows)), key=lambda i: key(rows[i]))[:entries]
    books = [[list(cut[i][p]) for i in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min((far(x, e), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for c in cut:
            for p in range(parts):
                held[p, nearest(p, c[p])[1]].append(c[p])
        for (p, n), xs in held.items():
            books[p][n] = [sum(col) // len(xs) for col in zip(*xs)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    per = Counter()
    for f, r in zip(found, rows):
        per[r[2]] += sum(d for d, _ in f)
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f), per[r[2]], said) for f, r in zip(found, rows))


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, __label int"
COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("width,kind,n", [(4, "normal", 150), (1, "ties", 120), (3, "ties", 90), (5, "far", 70), (2, "few", 5)])
def test_vector_codes(spark, width, kind, n):
    r = random.Random(width)
    length = 16 * width
    number = {"normal": lambda: r.gauss(0, 0.3), "ties": lambda: r.choice([-1 / 256, 0.0, 1 / 256, 2 / 256]), "far": lambda: r.choice([0.0, 1e4, -1e4, 3.0, -0.1]), "few": lambda: r.random()}[kind]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    good = [(i, f32(number() for _ in range(length)), r.choice([None, 1, 2])) for i in range(n)]
    good += [good[0], (None, good[1][1], None), (good[2][0], good[3][1], 1)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [None] + good[0][1][1:], 1), (-4, [float("nan")] + good[0][1][1:], 1), (-5, [float("inf")] + good[0][1][1:], 2), (-6, [1.0] * (length - 1), 2), (n + 9, [1.0] * (length + 16), 2)]
    df = spark.createDataFrame([(*x, "old", "old", 7) for x in good + bad], VECTORS).repartition(3)
    got = vector_codes.compress(df)
    assert Counter(map(tuple, got.select(COLUMNS).collect())) == brute_codes(good)
    assert set(got.columns) == {*COLUMNS, "label", "__label"}


def test_bounds_lose_no_entry_and_spare_comparisons():
    r = np.random.default_rng(3)
    for width, spread in ((1, 50), (4, 30), (8, 200), (24, 50), (8, 2**27)):
        rows, entries = (r.integers(-spread, spread, (n, width)) for n in (3000, 64))
        entries[9] = entries[3]
        rows[:1500] = entries[r.integers(0, 64, 1500)] + r.integers(-1, 2, (1500, width))  # half of them near an entry
        book = vector_codes.Codebook(entries)
        at, d = book.nearest(rows)
        all_pairs = ((rows[:, None, :] - entries[None]) ** 2).sum(-1)
        assert (d == all_pairs.min(1)).all() and (at == all_pairs.argmin(1)).all()
        assert book.compared < all_pairs.size / 2
        for n in book.counts:
            bound = vector_codes.Blocks.of(rows, n).bound(vector_codes.Blocks.of(entries, n))
            assert (bound <= all_pairs).all()


def test_vector_codes_of_nothing_and_of_extremes(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(none).count() == 0 and set(vector_codes.compress(none).columns) == {*COLUMNS, "label", "__label"}
    huge = spark.createDataFrame([(i, [float(s) * 1e38] * 64, 1, "", "", 0) for i, s in enumerate((1, -1, 1))], VECTORS)
    assert [x["error"] for x in vector_codes.compress(huge).orderBy("vec_id").collect()] == [0, 0, 0]


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = vector_codes.fit(df)
    rows = vector_codes.decode(vector_codes.encode(df, books), books).join(df, "vec_id").collect()
    for r in rows:
        assert sum((math.floor(256 * x) - 256 * y) ** 2 for x, y in zip(r["embedding"], r["decoded"])) == r["error"]


# The filter audit.

def brute_audit(docs, labels):
    """docs: (id, text, part)."""
    size = lambda i: (i is None, i or 0)
    least = {}
    for i, t, _ in docs:
        least[t or ""] = min(least.get(t or "", (True, 1)), size(i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, p in docs:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        capitals = len(re.findall("[A-Z]", t))
        fails = {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * capitals > 5 * len(t), bool(re.search("[#$%&*|]", t)), size(i) > least[t])) if x}
        parts["" if p is None else str(p)].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        removed_in_all = Counter()
        for o in permutations("ABCDE"):
            left = rows
            for n, f in enumerate(o):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                removed_in_all[f] += len(gone)
                out[part, "".join(o), n + 1] = [len(left), len(gone), sum(f in x[0] for x in rows) - len(gone), sum(x[0] == {f} for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, o, n), x in out.items():
            if p == part:
                x.append(removed_in_all[o[n - 1]])
    return {k: tuple(v) for k, v in out.items()}


AUDITED = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(200)]
    made = [None, "", " \t", "A B C", "# x", "é" * 300 + "ABCDEFGHIJKLMNOP", "long " * 30_000, "word " * 60 + "$"]
    made += [" ".join(r.choice(vocabulary[:k]) for _ in range(n)) for n, k in ((60, 200), (60, 30), (49, 200), (50, 200), (100, 200), (100, 60))]
    docs = [(i, t, ("a", "b", None, "")[i % 4]) for i, t in enumerate(made)]
    docs += [(1000 - i, made[9], "hot") for i in range(400)] + [(5, made[9], "a"), (1000, made[9], "b"), (None, made[9], "b"), (None, "alone", None), (None, "alone", None), (3, made[3], "a")]
    labels = [(i, i % 2, i % 3) for i in range(0, 1100, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (7, None, 1), (9999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("kind", ["xxhash64", "one print for all", "two prints"])
def test_masks_over_range_boundaries(spark, kind):
    docs, labels = audit_rows()
    fingerprint = {"xxhash64": F.xxhash64, "one print for all": lambda t: F.lit(1).cast("bigint") + F.length(t) * 0, "two prints": lambda t: F.xxhash64(t).bitwiseAND(1)}[kind]
    df = spark.createDataFrame([(*x, "m", 1, "x") for x in docs], "doc_id long, text string, source string, mask string, task int, first string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        masked = audit.masks(df, fingerprint=fingerprint)
        found = audit.report(audit.counters(masked, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
        got = {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in AUDITED) for x in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_audit(docs, labels)
    assert got == want


def test_copies_spread_over_tasks(spark):
    """A hot group is dealt over ranges, and still has one first id."""
    df = spark.createDataFrame([(i, "the same words", "s") for i in range(3000)], "id long, text string, part string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = audit.runs(df).where("text IS NULL").groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) >= 3 and max(r["count"] for r in rows) < 2000
    masked = audit.masks(df, doc_id="id", part="part").groupBy("mask").count().collect()
    assert sorted((r["mask"] & audit.DUPLICATE, r["count"]) for r in masked) == [(0, 1), (audit.DUPLICATE, 2999)]


def test_audit_of_nothing(spark):
    docs, labels = audit_rows()
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    given = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert audit.audit(given.where("false"), labelled).count() == 0
    found = audit.audit(given, labelled.where("false"))
    assert found.count() == 600 * 4 and found.where("good_lost <> 0 OR toxic_lost <> 0").count() == 0


# Decontamination.

def brute_search(docs, items, window=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    having = defaultdict(set)
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            having[tuple(w[a : a + window])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for k in {len(p) for p in having}:
            for a in range(len(w) - k + 1):
                if (p := tuple(w[a : a + k])) in having:
                    hit.update(range(a, a + k))
                    found |= having[p]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


def leak_rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    said = lambda n: "".join(word() + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(n, said(r.choice([12, 30, 60]))) for n in range(100, 130)] + [(1, None), (2, ""), (3, "..."), (4, "Zq"), (5, "short item here"), (6, "short item here"), (None, "nobody owns this one at all"), (10, "x " * 40)]
    items += [items[0], (items[0][0], said(15)), (9, items[3][1]), (11, items[4][1] + " and more words " + said(20))]
    docs = [(0, None), (1, ""), (2, "..."), (3, "zQ"), (4, "a b zq? SHORT, item; here zq"), (5, "nobody owns this one at all"), (6, "x " * 9), (7, "x" + " x" * 100_000), (8, "y " * 50_000 + items[5][1])]
    for n in range(9, 80):
        text = items[r.randrange(30)][1].upper()
        at = r.randrange(len(text))
        docs.append((n, said(r.randint(0, 200)) + r.choice([text, text[at:], text[:at], ""]) + " " + said(r.randint(0, 40))))
    return docs + [docs[9], docs[9], (None, docs[10][1]), (12, docs[11][1])] + [(500, docs[9][1])] * 20, items


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 1500])
def test_decontamination(spark, block_chars):
    docs, items = leak_rows()
    df = spark.createDataFrame([(*x, "n", [1], "d") for x in docs], "doc_id long, text string, n_words string, items array<int>, low string").repartition(3)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int")
    got = decontaminate.search(df, bench, block_chars=block_chars)
    assert set(got.columns) == {"doc_id", "low", "n_words", "spans", "items"}
    assert Counter((x["doc_id"], x["n_words"], sum(s["high"] - s["low"] for s in x["spans"]), tuple(x["items"])) for x in got.collect()) == brute_search(docs, items)
    clean = decontaminate.decontaminate(df, bench, block_chars=block_chars)
    assert clean.columns == df.columns
    assert Counter(x["doc_id"] for x in clean.collect()) == Counter(i for (i, _, hit, _), n in brute_search(docs, items).items() for _ in range(n) if not hit)


def test_decontamination_of_nothing(spark):
    docs, items = leak_rows()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.search(df.where("false"), bench).count() == 0
    assert decontaminate.search(df, bench.where("false")).where("size(spans) + size(items) > 0").count() == 0


@pytest.mark.parametrize("lane", [7, 50, decontaminate.LANE])
def test_search_tables(monkeypatch, lane):
    monkeypatch.setattr(decontaminate, "LANE", lane)
    r = random.Random(lane)
    for _ in range(60):
        letters = r.choice(["ab", "abcé", "abcdefg"])
        words = ["".join(r.choice(letters) for _ in range(r.randint(1, r.choice([1, 2, 4, 20])))) for _ in range(r.randint(1, 6))]
        text = lambda n: r.choice([" ", ". ", "\n"]).join(r.choice(words) for _ in range(r.randint(0, n)))
        items = [(str(r.randint(0, 9)), text(r.choice([3, 14, 30]))) for _ in range(r.randint(0, 6))]
        docs = [(n, t) for n, t in enumerate([None, "", *(text(r.choice([5, 60, 600])) for _ in range(8))])]
        found = decontaminate.Patterns.of(items).find([t for _, t in docs])
        assert Counter((n, w, sum(b - a for a, b in s), tuple(i)) for n, (w, s, i) in enumerate(found)) == brute_search(docs, items)
