"""Every query against its DuckDB counterpart, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from siltstone.plans import fact_queries, run_queries, web_queries  # noqa: F401
from siltstone.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    found = sorted((tuple(plain(x) for x in r) for r in got.select(columns).collect()), key=repr)
    if name not in ORACLE:
        return
    asked = duck.execute(ORACLE[name])
    names = [x[0] for x in asked.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted((tuple(plain(r[i]) for i in order) for r in asked.fetchall()), key=repr)


def test_fallback_of_own_markup(spark, small, tmp_path):
    """Against brute force: the pages as they are, and shells among them."""
    from siltstone.functions import rules
    from siltstone.sources.html_pages import parse_page

    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    shells = ["<script id='__NEXT_DATA__'></script>", "<div id='__next'><p>words</p></div>", "<div data-reactroot></div>", "<div v-cloak id='app'></div>", "<div id='root'></div>", "<script></script>" * 3 + "<p>few</p>", "<p>Just a moment</p>", "<script></script>" * 3 + f"<p>{'word ' * 80}</p>"]
    pages += [(10_000 + k, h) for k, h in enumerate(shells)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    expected = {}
    for i, h in pages:
        r = parse_page(h)
        c, n = r["cleaned"], len(r["text"].strip(" "))
        found = [
            ("challenge-page", any(w in h.lower() for _, words in rules.CHALLENGES for w in words)),
            ("nextjs-shell", n <= 50 and ("__NEXT_DATA__" in c or 'id="__next"' in c)),
            ("react-shell", n <= 50 and "data-reactroot" in c),
            ("vue-shell", n <= 50 and "v-cloak" in c),
            ("empty-shell", n == 0 and ('id="root"' in c or 'id="app"' in c)),
            ("script-heavy", c.count("<script") >= 3 and n <= 300),
        ]
        expected[i] = ",".join(f"browser:{name}" for name, yes in found if yes)
    got = {r["page_id"]: r["rule_ids"] for r in QUERIES["fallback_pages"](spark, str(tmp_path)).collect()}
    assert got == expected and len(set(expected.values())) >= 6


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
