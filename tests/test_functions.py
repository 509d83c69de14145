"""Functions and operators on hand-made rows."""

from datetime import date

from pyspark.sql import functions as F

from siltstone.functions import rules, text, urls
from siltstone.operators import crawl, discovery, reconcile, views


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_urls(spark):
    assert one(spark, " HTTPS://Shop.Example.com:443//a//b/?x=1#f ", urls.normalize) == "https://shop.example.com/a/b"
    assert one(spark, "http://a.co:8080", urls.normalize) == "http://a.co:8080/"
    assert one(spark, "https://a.co/?b=2&utm_source=x&a=1", lambda c: urls.normalize(c, True)) == "https://a.co/?a=1&b=2"
    assert one(spark, "http://a.co:port/", urls.normalize) is None
    assert one(spark, "WWW.Shop.co.nz/", urls.website) == "shop.co.nz"
    assert one(spark, "localhost", urls.website) is None
    assert one(spark, "https://www.A.com:8/x", urls.company_domain) == "a.com"
    assert one(spark, "a.b.co.uk", urls.registrable_domain) == "b.co.uk"
    assert one(spark, "my-shop.com.au", urls.fallback_name) == "Com"
    assert one(spark, "x.com.au", urls.tld_country) == "Australia"
    assert one(spark, None, urls.normalize) is None


def test_text(spark):
    assert one(spark, " a  b\n", text.collapse) == "a b"
    assert one(spark, " \t", text.blank_to_null) is None
    assert one(spark, "mail me@x.co!", text.redact_emails) == "mail [redacted-email]!"
    assert one(spark, "on 2024-02-30 or May 1, 2024", text.date) is None
    assert one(spark, "May 1, 2024", text.date) == date(2024, 5, 1)
    assert one(spark, "Head of IT Manager", text.role) == "technology"
    assert one(spark, "Please verify you are human", text.challenge) == "captcha"
    assert one(spark, "image/png", text.page_content_type) is False
    assert one(spark, None, text.page_content_type) is True


def test_confidence_rounds_half_to_even(spark):
    row = spark.range(1).select(text.confidence(F.lit(1), F.lit(0), F.lit(0), F.lit(14), F.lit(1), F.lit(0), F.lit(False), F.lit(False)).alias("a"), text.confidence(F.lit(90), F.lit(90), F.lit(90), F.lit(90), F.lit(3), F.lit(65), F.lit(True), F.lit(False)).alias("b")).first()
    assert (row["a"], row["b"]) == (2, 68)


def test_classify(spark):
    rows = spark.createDataFrame([("/pages/about-us.html", ["x"]), ("/products/x", []), ("/x", ["Our TRADEmark", "trade"]), ("/x", []), ("/", [])], "p string, a array<string>")
    got = [tuple(r["k"]) for r in rows.select(discovery.classify(F.col("p"), F.col("a")).alias("k")).collect()]
    assert got == [("about", 95, "path:about:/about-us"), ("product", 90, "prefix:product_prefix:/products/"), ("trade", 50, "anchor:trade"), ("unknown", 0, "unmatched"), ("homepage", 100, "path:homepage:/")]


def test_target_caps(spark):
    rows = [("r", f"https://a.co/{k:03}", k, "unknown", 3, 0, False) for k in range(50)] + [("r", "https://a.co/p", 60, "faq", 2, 0, False), ("r", "https://a.co/c", 61, "cart", 4, 0, False), ("r", "https://a.co/a", 62, "about", 1, 0, False)]
    c = spark.createDataFrame(rows, "run string, url string, ord long, page_type string, priority int, depth int, preferred boolean")
    got = [r["page_type"] for r in crawl.select_targets(c).orderBy("position").collect()]
    assert got == ["about", "faq", "unknown", "unknown", "unknown"]
    assert [r["page_type"] for r in crawl.select_targets(c, pages=2).orderBy("position").collect()] == ["about", "faq"]


def test_robots(spark):
    files = spark.createDataFrame([("o", "User-agent: a\nUser-agent: *\nDisallow: /x # no\nAllow: /x/y\n\nUser-agent: b\nDisallow: /\n")], "origin string, text string")
    paths = spark.createDataFrame([("o", "/x/1"), ("o", "/x/y"), ("o", "/z"), ("p", "/z")], "origin string, path string")
    got = {(r["origin"], r["path"]): r["outcome"] for r in crawl.evaluate_robots(paths, crawl.robots_rules(files), "c").collect()}
    assert got == {("o", "/x/1"): "disallowed", ("o", "/x/y"): "allowed", ("o", "/z"): "allowed", ("p", "/z"): "unknown"}


def test_scalar_conflict_and_override(spark):
    rows = [(1, "f", 1, "A", "json_ld", 92), (1, "f", 2, "B", "open_graph", 78), (2, "f", 3, "A", "json_ld", 92), (2, "f", 4, " a ", "html_element", 75), (3, "f", 5, "A", "json_ld", 92), (3, "f", 6, "B", "link", 99), (4, "f", 7, "x", "link", 20)]
    c = spark.createDataFrame(rows, "company int, field string, id long, value string, source string, confidence int")
    got = {r["company"]: (r["value"], r["status"], r["state"], r["n_sources"]) for r in reconcile.scalar(c).collect()}
    assert got == {1: (None, "conflicting", "conflicting", 2), 2: ("A", "accepted", "verified", 2), 3: ("A", "accepted", "verified", 1), 4: (None, "unknown", "unknown", 0)}


def test_transitions(spark):
    rows = spark.createDataFrame([(1, 1, "imported"), (1, 2, "discovering"), (1, 3, "crawled"), (1, 4, "crawled")], "k int, t int, s string")
    got = [r["valid"] for r in views.transitions(rows, rules.PROCESSING, "k", ["t"], "s").orderBy("t").collect()]
    assert got == [True, True, False, True]


def test_sitemap_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "parent string, child string")
    got = discovery.sitemap_closure(spark.createDataFrame([("a",)], "url string"), edges)
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2)]
