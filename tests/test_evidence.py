"""Matches with places, people, contacts and evidence against plain Python over the driver's pages and made ones."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from siltstone.functions import rules, text
from siltstone.operators import extract, facts, gate, matches
from siltstone.operators.runs import crawl_key, extraction_key
from siltstone.sources.html_pages import parse_pages

SAID = [
    "wholesale application", "We do not offer wholesale", "trade account", "click & collect", "click and collect is not available", "subscribe and save", "book an appointment", "online-only store", "made to order", "gift set",
    "engraving", "pickup is available", "software engineer", "we're hiring", "growing", "opening a new store", "merger", "now shipping to Perth", "write to a.b@c.co", "or +61 2 1234 5678", "plain words", "über uns", "\U0001f600", "2024-03-01",
]


def spoken(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice([*SAID, "x" * r.randrange(1, 90)]) for _ in range(r.randrange(0, 25))) for _ in range(n)]


def brute(page, of, around):
    found = []
    for rule in of:
        for p in rule.patterns:
            for m in re.finditer(p, page, re.I):
                before, behind = page[max(0, m.start() - around) : m.start()], page[m.end() : m.end() + around]
                if not rule.nearby or any(re.search(n, f"{before} {m[0]} {behind}", re.I) for n in rule.nearby):
                    found.append((rule.name, rule.field, m[0] if rule.said is None else rule.said, rule.confidence, m.start(), m.end(), m[0], before, behind))
    return found


def test_places_of_matches(spark):
    every = matches.BUSINESS + matches.WORDING + matches.GROWTH
    pages = [(i, t) for i, t in enumerate(spoken(120, 1))] + [(900, None), (901, "")]
    df = spark.createDataFrame(pages, "page_id int, text string")
    names = set()
    for around in (7, 200):
        got = sorted(tuple(r)[0:] for r in matches.pattern_matches(df, every, around=around).collect())
        assert got == sorted((i, *x) for i, t in pages for x in brute(t or "", every, around))
        names |= {x[1] for x in got}
    assert names > {"business.wholesale:true", "business.wholesale:false", "growth.hiring", "growth.expansion"}
    only = [matches.Rule("r", "f", None, 1, ("a",), without=("stop",), page_types=("about",))]
    typed = spark.createDataFrame([(1, "about", "a b"), (2, "faq", "a b"), (3, "about", "a stop"), (4, None, "a")], "page_id int, page_type string, text string")
    assert [r["page_id"] for r in matches.pattern_matches(typed, only).orderBy("page_id").collect()] == [1, 4]


def test_every_candidate_has_evidence(spark, small):
    """Over the driver's pages with wording put into them: ids by their formula, excerpts of the fragments, places that hold them."""
    said = spoken(50, 2)
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html")
    extra = spark.createDataFrame(list(enumerate(said)), "nth int, more string")
    pages = pages.join(extra, F.col("page_id") % 50 == F.col("nth")).select("page_id", F.lit("shop.co.nz").alias("host"), F.lit("about").alias("page_type"), F.concat(F.lit('<html lang="en"><p>'), "more", F.lit("</p>"), "html").alias("html"))
    parsed = parse_pages(pages)
    texts = {r["page_id"]: r["text"] for r in parsed.select("page_id", "text").collect()}
    got = extract.extract(parsed).collect()
    fields = set()
    for r in got:
        assert r["evidence_id"] and r["excerpt"] is not None and r["extractor_id"] in {x[1] for x in rules.EXTRACTORS}
        if r["place"]:
            a, b = map(int, re.fullmatch(r"text\[(\d+):(\d+)\]", r["place"]).groups())
            words = texts[r["page_id"]][a:b]
            assert r["evidence_id"] == hashlib.sha256(f"{r['page_id']}|{r['field']}||{hashlib.sha256(words.encode()).hexdigest()}".encode()).hexdigest()
            assert r["excerpt"] == re.sub(r"\s+", " ", words).strip() and not re.search(text.EMAIL, r["prefix"] + r["suffix"])
            fields.add(r["field"])
    wanted = sorted((p, x[1], x[3]) for p, t in texts.items() for x in brute(t, matches.BUSINESS + matches.WORDING + matches.GROWTH, 200))
    assert sorted((r["page_id"], r["field"], r["confidence"]) for r in got if r["place"]) == wanted and len(fields) > 10


def test_contacts_once_a_page(spark):
    html = """<a href="MAILTO:Info@Acme.com?subject=x">m</a><a href="mailto: info@acme.com ">m</a><a href="tel:+61 2 9999 0000">t</a><script type="application/ld+json">{"email": "INFO@acme.com", "telephone": "02 1111 2222"}</script>
    <script type="application/ld+json">[{"email": "press@acme.com"}, {"email": ["no@acme.com"], "telephone": {"x": 1}}]</script><p>Write to info@acme.com, press@acme.com or sales@acme.com, call 02 1111 2222, +61 2 9999 0000 or 03 4444 5555.</p>"""
    pages = parse_pages(spark.createDataFrame([(1, "a.co", "contact", html), (2, "a.co", "contact", "<p>info@acme.com</p>"), (3, "a.co", "contact", None)], "page_id int, host string, page_type string, html string"))
    got = sorted((r["page_id"], r["field"].split(".")[1], r["value"], r["confidence"], r["source"], r["fragment"]) for r in extract.contacts(pages).collect())
    assert got == sorted([
        (1, "emails", "info@acme.com", 82, "link", "Info@Acme.com"), (1, "emails", "press@acme.com", 85, "json_ld", "press@acme.com"), (1, "emails", "sales@acme.com", 70, "html_element", "sales@acme.com"), (2, "emails", "info@acme.com", 70, "html_element", "info@acme.com"),
        (1, "phone_numbers", "+61299990000", 80, "link", "+61 2 9999 0000"), (1, "phone_numbers", "0211112222", 85, "json_ld", "02 1111 2222"), (1, "phone_numbers", "0344445555", 65, "html_element", "03 4444 5555"),
    ])


def test_people_and_recommended_contacts(spark):
    ld = '[{"@type": ["Thing", "Person"], "name": " Ann Lee ", "jobTitle": "Head of E-commerce", "email": "ann@a.co", "telephone": "1"}, {"@type": "person", "name": "Bo"}, {"@type": "Person", "name": " "}, {"@type": "Organization", "name": "Acme"}]'
    team = '<div class="team-member"><h3>Cy <b>Dee</b></h3><p class="job-title">Warehouse  Manager</p></div><div class="x person"><h4>Eve</h4></div><div class="person"><p class="role">Founder</p></div>'
    page = f"<script type='application/ld+json'>{ld}</script>{team}"
    df = spark.createDataFrame([(1, "a.co", "team", "https://a.co/team", page), (2, "b.co", "team", None, "<p>none</p>")], "page_id int, host string, page_type string, url string, html string")
    got = extract.people(parse_pages(df)).collect()
    people = [json.loads(r["value"]) for r in got if r["field"] == "organisation.people"]
    base = {"source_url": "https://a.co/team"}
    assert people == [
        {"name": "Ann Lee", "role_title": "Head of E-commerce", "role_category": "ecommerce", "email": "ann@a.co", "phone": "1"} | base, {"name": "Bo", "role_title": "", "role_category": "unknown", "email": None, "phone": None} | base,
        {"name": "Cy Dee", "role_title": "Warehouse Manager", "role_category": "operations", "email": None, "phone": None} | base, {"name": "Eve", "role_title": "", "role_category": "unknown", "email": None, "phone": None} | base,
    ]
    ranked = [r for r in got if r["field"] == "organisation.recommended_contact_candidates"]
    assert [(json.loads(r["value"])["name"], json.loads(r["value"])["priority"], r["sort_key"], r["confidence"], r["source"]) for r in ranked] == [(n, p, p, 55, "deterministic_inference") for n, p in (("Ann Lee", 1), ("Bo", 9), ("Cy Dee", 2), ("Eve", 9))]
    assert [(r["fragment"], r["dedup_key"], r["confidence"]) for r in got if r["field"] == "organisation.people"] == [("Ann Lee — Head of E-commerce", "ann lee|ecommerce", 80), ("Bo", "bo|unknown", 80), ("Cy Dee — Warehouse Manager", "cy dee|operations", 68), ("Eve", "eve|unknown", 68)]


def test_keys_of_runs(spark):
    """Ten requests against keys made with a JSON encoder."""
    from pyspark.sql import types as T

    def digest(x):
        return hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()

    kind = T.StructType().add("user_agent", T.StringType()).add("default_delay_s", T.DoubleType()).add("max_attempts", T.LongType()).add("retryable_status_codes", T.ArrayType(T.LongType())).add("max_product_pages", T.LongType())
    r = random.Random(9)
    rows, wanted = [], []
    for i in range(10):
        config = {"user_agent": r.choice(['bot "x"', "böt/1.0\n", "bot"]), "default_delay_s": r.choice([1.0, 0.5, 1e-05, 1e16, 12.25]), "max_attempts": r.choice([3, None]), "retryable_status_codes": r.sample([429, 500, 503, 408], 3), "max_product_pages": 5}
        urls, kinds = [r.choice(["https://b.co/é", "https://a.co/", "a\\b"]) for _ in range(r.randrange(4))], r.sample(["about", "contact", "faq"], r.randrange(4))
        most, policy, force = r.choice([None, 7]), r.choice([None, "never"]), r.choice([True, False])
        rows.append((i, f"c{i}", f"d{i}", config, urls, kinds, most, policy, force))
        options = {"manual_urls": sorted(urls), "include_page_types": sorted(kinds), "exclude_page_types": [], "max_pages": most, "browser_policy": policy, "force_refresh": force}
        snapshot = config | {"retryable_status_codes": sorted(config["retryable_status_codes"])}
        crawl = hashlib.sha256(f"c{i}|d{i}|{digest(snapshot)}|{digest(options)}".encode()).hexdigest()
        extraction = hashlib.sha256(f"c{i}|d{i}|{digest({'extractor_ids': sorted(urls), 'page_types': sorted(kinds), 'force_refresh': force})}".encode()).hexdigest()
        wanted.append((i, crawl, extraction))
    schema = T.StructType().add("i", T.IntegerType()).add("c", T.StringType()).add("d", T.StringType()).add("config", kind).add("urls", T.ArrayType(T.StringType())).add("kinds", T.ArrayType(T.StringType())).add("most", T.LongType()).add("policy", T.StringType()).add("force", T.BooleanType())
    df = spark.createDataFrame(rows, schema)
    crawl = crawl_key(F.col("c"), F.col("d"), F.col("config"), kind, {"manual_urls": F.col("urls"), "include_page_types": F.col("kinds"), "max_pages": F.col("most"), "browser_policy": F.col("policy"), "force_refresh": F.col("force")})
    extraction = extraction_key(F.col("c"), F.col("d"), {"extractor_ids": F.col("urls"), "page_types": F.col("kinds"), "force_refresh": F.col("force")})
    assert sorted(map(tuple, df.select("i", crawl, extraction).collect())) == wanted


def test_typed_keys(spark):
    rows = [(" Blue ", "string", "text:blue"), ("1", "string", "text:1"), ("1", "integer", "number:1"), ("1.0", "float", "number:1"), ("True", "boolean", "number:1"), ("false", "boolean", "number:0"), ("2.50", "float", "number:2.5"), ("-0.0", "float", "number:0"),
            ("007", "integer", "number:7"), ("1e20", "float", "number:1e+20"), ("{}", "structured_entity", "json:{}"), (None, "string", None)]
    df = spark.createDataFrame(rows, "value string, kind string, want string").withColumn("got", facts.value_key(F.col("value"), F.col("kind")))
    assert [(r["value"], r["got"]) for r in df.collect()] == [(v, w) for v, _, w in rows]
    apart = df.where("kind in ('integer', 'float', 'boolean')").select(facts.value_key(F.col("value"), F.col("kind"), apart=True)).distinct()
    assert {"integer:1", "float:1", "boolean:1"} <= {r[0] for r in apart.collect()}


def test_extractors_see_their_pages(spark):
    pages = spark.createDataFrame([(1, "homepage", "fetched", True), (2, "product", "unchanged", True), (3, None, "fetched", True), (4, "about", "failed", True), (5, "about", "fetched", False)], "page_id int, page_type string, fetch_status string, has_content boolean")
    none = spark.createDataFrame([], "page_id int, extractor_id string")
    got = {}
    for r in gate.executions(pages, none).collect():
        got.setdefault(r["page_id"], set()).add(r["extractor_id"])
    every = {x[1] for x in rules.EXTRACTORS}
    assert got == {1: every - {"business.brands"}, 2: every - {"identity.company_name"}, 3: every - {"business.brands", "identity.company_name"}}
    some = gate.executions(pages, spark.createDataFrame([(2, "business.brands")] * 3, none.schema), spark.createDataFrame([(1, "growth.signals")] * 2, none.schema), only=["business.brands", "growth.signals"], page_types=["product", "homepage"])
    assert sorted(tuple(r) for r in some.select("page_id", "extractor_id", "status", "candidates_produced").collect()) == [(1, "growth.signals", "failed", 0), (2, "business.brands", "succeeded", 3), (2, "growth.signals", "succeeded", 0)]
