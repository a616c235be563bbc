"""Every query that SQL can ask, against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from stemma.plans.queries import ORACLES, QUERIES, flagship

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows):
    fix = lambda x: round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, oracle, name):
    made = QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    found = oracle.execute(ORACLES[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    want = plain([r[theirs.index(c)] for c in columns] for r in found.fetchall())
    assert plain(tuple(r) for r in made.select(columns).collect()) == want


def test_every_query_is_compared():
    """What SQL doesn't ask, test_grouped_tree does."""
    assert set(QUERIES) - set(ORACLES) == {"tree_collapsed", "tree_expanded", "tree_layout"}


def test_grouped_tree(spark):
    """The tree in groups against the whole one, which SQL has compared."""
    rows = {n: [r.asDict() for r in QUERIES[n](spark, SF).collect()] for n in ("lineage_tree", "tree_collapsed", "tree_expanded", "tree_layout")}
    whole, shown = {r["id"]: r for r in rows["lineage_tree"]}, {r["id"]: r for r in rows["tree_collapsed"]}
    groups, names = ([r for r in shown.values() if (r["kind"] == "group") == is_group] for is_group in (True, False))
    assert groups and all((whole[r["id"]]["label"], whole[r["id"]]["depth"], whole[r["id"]]["parent"]) == (r["label"], r["depth"], r["parent"]) for r in names)
    assert len(names) + sum(r["n_members"] for r in groups) == len(whole)  # everyone is shown or in one group
    assert all(r["label"] == f"+{r['n_members']} more" and r["parent"] in shown for r in groups)
    levels, siblings = Counter(abs(r["depth"]) for r in shown.values()), Counter(r["parent"] for r in shown.values() if r["depth"] > 0)
    assert max(levels.values()) <= 8 and max(siblings.values()) <= 4 and [r["id"] for r in names if r["depth"] == 0] == ["N11"]
    kids = Counter(r["parent"] for r in whole.values() if r["depth"] > 0)
    first = sorted((r for r in whole.values() if r["depth"] == 1), key=lambda r: (-kids[r["id"]], r["label"].lower(), r["id"]))
    stay = {r["id"] for r in names if r["depth"] == 1}
    assert stay <= {r["id"] for r in first[:3]}
    opened = next(r for r in rows["tree_collapsed"] if r["kind"] == "group")
    edges = {(r["source"], r["target"]) for r in rows["tree_expanded"]}
    added = {b for a, b in edges if a == opened["parent"]} - set(shown)
    assert len(added) == opened["n_members"] and added <= set(whole) and not any(opened["id"] in e for e in edges)
    at = {r["id"]: (r["x"], r["y"]) for r in rows["tree_layout"]}
    assert set(at) == set(shown) and all(0 <= x <= 1200 and 0 <= y <= 800 for x, y in at.values()) and len(set(at.values())) == len(at)
    ordered = sorted(shown, key=lambda i: shown[i]["depth"])
    assert all(at[a][0] < at[b][0] for a, b in zip(ordered, ordered[1:]) if shown[a]["depth"] < shown[b]["depth"])


@pytest.fixture(scope="module")
def twofold(tmp_path_factory):
    """The tables with every supplier, part, customer and line twice, keys shifted: names share labels, keys and items."""
    path, con = tmp_path_factory.mktemp("twofold"), duckdb.connect()
    keys = {"supplier": ["s_suppkey"], "part": ["p_partkey"], "customer": ["c_custkey"], "lineitem": ["l_partkey", "l_suppkey"]}
    for file in glob.glob(f"{SF}/*.parquet"):
        t = os.path.basename(file)[:-8]
        moved = ", ".join(f"{k} + 1000000 * i AS {k}" for k in keys.get(t, ()))
        rows = f"SELECT * EXCLUDE (i) REPLACE ({moved}) FROM '{file}', range(2) AS r(i)" if moved else f"SELECT * FROM '{file}'"
        con.execute(f"COPY ({rows}) TO '{path / t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path / t}.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["search_indexed"])
def test_shifted_copies(spark, twofold, name):
    sf, con = twofold
    made = QUERIES[name](spark, sf)
    found = con.execute(ORACLES[name])
    theirs = [d[0] for d in found.description]
    want = plain([r[theirs.index(c)] for c in sorted(made.columns)] for r in found.fetchall())
    assert want and plain(tuple(r) for r in made.select(sorted(made.columns)).collect()) == want


def test_flagship(spark):
    assert flagship(spark, SF).columns[0] == "id"
