"""Queries over the driver tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import rules, text, urls
from siltstone.operators import crawl, discovery, extract, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# Pieces of SQL that several counterparts share.
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
_PATH = "CASE WHEN regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/+$', '') END"
_CANON = f"split_part(url, '://', 1) || '://' || {_HOST} || {_PATH}"
_SEGMENT = "regexp_replace(list_extract(string_split(regexp_replace(lower(path), '/+$', ''), '/'), -1), '\\.[a-z0-9]+$', '')"
_SLUGS = " ".join(f"WHEN {_SEGMENT} = '{s}' THEN '{name}'" for name, words, _, _ in rules.PAGE_TYPES for s in words)
_TYPE = f"CASE WHEN lower(path) IN ('', '/') THEN 'homepage' {_SLUGS} " + " ".join(f"WHEN starts_with(lower(path), '{p}') THEN '{n}'" for n, ps in rules.PATH_PREFIXES for p in ps) + " ELSE 'unknown' END"
_PRIO = "CASE page_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.PRIORITY.items()) + " ELSE 3 END"
_LINKS = "SELECT page_id, url, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"[^>]*>', 1), 1) - 1 AS ord, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"[^>]*>', 1)) AS href FROM pages"
_REG = f"CASE WHEN array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.') IN ({_list(rules.COMPOUND_SUFFIXES)}) THEN array_to_string(list_slice(string_split({_HOST}, '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.') END"


@query(f"SELECT page_id, {_CANON} AS normalized_url, {_HOST} AS host FROM pages")
def url_canonical(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", urls.normalize(F.col("url")).alias("normalized_url"), urls.hostname(F.col("url")).alias("host"))


@query(f"SELECT {_HOST} AS host, count(*) AS n_pages, count(DISTINCT {_CANON}) AS n_urls FROM pages GROUP BY 1")
def url_hosts(spark, d):
    p = _t(spark, d, "pages").select(urls.hostname(F.col("url")).alias("host"), urls.normalize(F.col("url")).alias("u"))
    # Counts by URL first: a host with very many pages is then summed, not gathered.
    per_url = p.groupBy("host", "u").agg(F.count("*").alias("n"))
    return per_url.groupBy("host").agg(F.sum("n").alias("n_pages"), F.count("u").alias("n_urls"))


@query(f"SELECT {_REG} AS domain, count(*) AS n_pages FROM pages GROUP BY 1")
def registrable_domain_counts(spark, d):
    return _t(spark, d, "pages").groupBy(urls.registrable_domain(urls.hostname(F.col("url"))).alias("domain")).agg(F.count("*").alias("n_pages"))


@query(
    "WITH q AS (SELECT page_id, url, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM pages), k AS (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN (" + _list(rules.REDACTED_PARAMS) + ")) AS kept FROM q) "
    "SELECT page_id, CASE WHEN query = '' THEN url ELSE regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || regexp_extract(url, '(#.*)$', 1) END AS redacted FROM k"
)
def url_query_redaction(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.redact_query(F.col("url")).alias("redacted"))


# What stands before, in place of the host, and behind the path of a page's address, and why the whole is rejected.
_REJECTED = [
    ("mailto:", "", "disallowed scheme: mailto"), ("JavaScript:", "", "disallowed scheme: javascript"), ("ws://", "a.co", "unsupported scheme: ws"), ("", "a.co", "unsupported scheme: (none)"), ("https://", "u:p@a.co", "credentials in URL are not allowed"),
    ("https://", "", "malformed URL: missing host"), ("http://", "localhost", "localhost is not allowed"), ("http://", "10.0.0.1", "private/internal IP addresses are not allowed"), ("http://", "8.8.8.8:80", "IP address literals are not allowed"),
    ("http://", "[fe80::1]:80", "private/internal IP addresses are not allowed"), ("http://", "[2606:4700::1]", "IP address literals are not allowed"), ("http://", "intranet", "malformed URL: host has no domain suffix"),
    ("http://", "a.test", "private/internal hostnames are not allowed"), ("http://", "-a.co", "malformed URL: invalid host label"), ("http://", "a.co:port", "malformed URL"), ("http://", "999.1.1.1", None), (" HTTPS://", "A.co.", None),
]


@query(
    "SELECT page_id, CASE page_id % " + f"{len(_REJECTED)} " + " ".join(f"WHEN {i} THEN '{scheme}{host}'" for i, (scheme, host, _) in enumerate(_REJECTED)) + " END || regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS url, CASE page_id % " + f"{len(_REJECTED)} " + " ".join(f"WHEN {i} THEN '{why}'" for i, (_, _, why) in enumerate(_REJECTED) if why) + " END AS reason FROM pages"
)
def url_rejections(spark, d):
    """Every page's path behind a scheme and host of its own, most of them not to be taken."""
    k, path = F.col("page_id") % len(_REJECTED), F.regexp_extract("url", "^[a-z]+://[^/]*(.*)$", 1)
    front = F.element_at(F.array(*[F.lit(scheme + host) for scheme, host, _ in _REJECTED]), (k + 1).cast("int"))
    rows = _t(spark, d, "pages").select("page_id", F.concat(front, path).alias("url"))
    return rows.select("page_id", "url", urls.rejection(F.col("url")).alias("reason"))


@query(f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id, {_TYPE} AS page_type FROM p")
def page_type_by_url(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", discovery.classify(urls.path(F.col("url")))["page_type"].alias("page_type"))


@query(f"WITH l AS ({_LINKS}), p AS (SELECT page_id, ord, href AS path FROM l), t AS (SELECT *, {_TYPE} AS page_type FROM p) SELECT page_type, {_PRIO} AS priority, count(*) AS n_links FROM t GROUP BY 1, 2")
def link_priorities(spark, d):
    links = discovery.href_links(_t(spark, d, "pages").select("page_id", "url", "html"))
    kind = discovery.classify(F.col("href"))["page_type"]
    rows = links.select(kind.alias("page_type"), discovery.priority(kind, F.col("href"), F.lit(True)).alias("priority"))
    return rows.groupBy("page_type", "priority").agg(F.count("*").alias("n_links"))


@query(f"SELECT page_id, regexp_matches(lower(regexp_extract(url, '^([^?#]*)', 1)), '\\.({'|'.join(rules.EXCLUDED_EXTENSIONS)})$') AS excluded FROM pages")
def excluded_ext(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.excluded_extension(F.col("url")).alias("excluded"))


@query(f"SELECT page_id, ord::INT AS ord, href FROM ({_LINKS})")
def link_extract(spark, d):
    return discovery.href_links(_t(spark, d, "pages").select("page_id", "html")).select("page_id", "ord", "href")


_CANDIDATES = f"""l AS ({_LINKS}), c AS (SELECT {_HOST} AS run, href AS path, page_id * 1000 + ord AS ord, ord % 3 AS depth, CASE WHEN ord < 3 THEN 'navigation' ELSE 'html' END AS source FROM l),
 k AS (SELECT *, {_TYPE} AS page_type FROM c), cand AS (SELECT *, {_PRIO} AS priority, 45 + (ord % 4) * 5 AS confidence FROM k)"""


def _candidates(spark, d) -> DataFrame:
    links = discovery.href_links(_t(spark, d, "pages").select("page_id", "url", "html"))
    rows = links.select(
        urls.hostname(F.col("url")).alias("run"), F.col("href").alias("url"), (F.col("page_id") * 1000 + F.col("ord")).alias("ord"), (F.col("ord") % 3).alias("depth"), F.when(F.col("ord") < 3, "navigation").otherwise("html").alias("source"), "anchor"
    )
    rows = rows.withColumn("page_type", discovery.classify(F.col("url"))["page_type"])
    return rows.withColumn("priority", discovery.priority(F.col("page_type"), F.lit(""), F.lit(True))).withColumn("confidence", F.lit(45) + (F.col("ord") % 4) * 5)


@query(
    f"WITH {_CANDIDATES} SELECT run, path AS url, arg_max(page_type, confidence * 1000000000000 - ord) AS page_type, max(confidence) AS confidence, min(priority) AS priority, min(depth)::INT AS depth, count(*) AS merged, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM cand GROUP BY 1, 2"
)
def link_reconcile(spark, d):
    c = _candidates(spark, d).withColumn("same_domain", F.lit(True))
    out = discovery.reconcile_urls(c)
    return out.select("run", "url", "page_type", F.col("confidence").cast("long").alias("confidence"), "priority", "depth", "merged", F.array_join(F.array_sort("sources"), ",").alias("sources"))


_ORDER_CASE = "CASE page_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(rules.CRAWL_ORDER)) + " END"


@query(
    f"""WITH {_CANDIDATES}, o AS (SELECT *, {_ORDER_CASE} AS type_order, source = 'navigation' AS pref FROM cand),
 u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY run, path ORDER BY depth, NOT pref, ord) = 1),
 ok AS (SELECT * FROM u WHERE page_type NOT IN ({_list(rules.CRAWL_DENIED)}) AND priority < 4),
 fixed AS (SELECT * FROM ok WHERE priority = 1),
 pool AS (SELECT *, CASE WHEN page_type IN ('collection', 'category') THEN 'collection' WHEN page_type IN ('product', 'unknown') THEN page_type ELSE '-' END AS cat FROM ok WHERE priority > 1),
 capped AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY run, cat ORDER BY priority, type_order, depth, NOT pref, path) <= CASE cat WHEN 'product' THEN 5 WHEN 'collection' THEN 8 WHEN 'unknown' THEN 3 ELSE 1000000 END),
 total AS (SELECT c.*, row_number() OVER (PARTITION BY c.run ORDER BY priority, type_order, depth, NOT pref, path) AS t, coalesce(f.n, 0) AS n FROM capped c LEFT JOIN (SELECT run, count(*) AS n FROM fixed GROUP BY 1) f ON c.run = f.run),
 sel AS (SELECT run, path, page_type, priority, type_order FROM fixed UNION ALL SELECT run, path, page_type, priority, type_order FROM total WHERE t <= 30 - n)
 SELECT run, path AS url, page_type, priority, row_number() OVER (PARTITION BY run ORDER BY type_order, priority, path)::INT AS position FROM sel"""
)
def crawl_target_select(spark, d):
    c = _candidates(spark, d).withColumn("preferred", F.col("source").isin(rules.PREFERRED_SOURCES))
    return crawl.select_targets(c).select("run", "url", "page_type", "priority", "position")


@query(
    "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '<a ')) AS n_links, len(regexp_extract_all(html, '<script')) AS n_scripts, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages"
)
def page_meta(spark, d):
    def n(p):
        return F.size(F.split("html", p)).cast("long") - 1

    return _t(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), n("<a ").alias("n_links"), n("<script").alias("n_scripts"), n("<p>").alias("n_paragraphs")
    )


@query("WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents), k AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY ord) AS n FROM b WHERE block <> '') SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (WHERE n <= 2) AS n_kept FROM k GROUP BY 1")
def block_repeat_cap(spark, d):
    b = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "block")).where("block <> ''")
    k = b.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("ord")))
    return k.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("n") <= 2).alias("n_kept"))


_CHALLENGE = "CASE " + " ".join("WHEN " + " OR ".join("contains(low, '" + p.replace("'", "''") + "')" for p in ps) + f" THEN '{n}'" for n, ps in rules.CHALLENGES) + " END"
_WORDS = "just a moment|verify you are human|403 forbidden|password protected|maintenance mode|unusual traffic|hello".split("|")
_SEED = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS))


@query(f"WITH s AS (SELECT page_id, lower(html || CASE page_id % 7 {_SEED} END) AS low FROM pages) SELECT page_id, {_CHALLENGE} AS class FROM s")
def challenge_classify(spark, d):
    seed = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("page_id") % 7 + 1).cast("int"))
    return _t(spark, d, "pages").select("page_id", text.challenge(F.concat("html", seed)).alias("class"))


@query(
    "WITH s AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '<script><script><script>' WHEN 1 THEN '<div id=\"__next\">' WHEN 2 THEN '<div data-reactroot>' WHEN 3 THEN '<div id=\"app\" v-cloak>' ELSE 'plain' END AS html, left(regexp_extract(html, '<title>([^<]*)', 1), (page_id % 4 * 30)::INT) AS txt FROM pages), r AS (SELECT page_id, len(trim(txt)) AS n, html, page_id % 11 = 0 AS blocked FROM s) "
    "SELECT page_id, array_to_string(list_filter([CASE WHEN blocked THEN 'browser:challenge-page' END, CASE WHEN n <= 50 AND (contains(html, '__NEXT_DATA__') OR contains(html, 'id=\"__next\"')) THEN 'browser:nextjs-shell' END, CASE WHEN n <= 50 AND contains(html, 'data-reactroot') THEN 'browser:react-shell' END, CASE WHEN n <= 50 AND contains(html, 'v-cloak') THEN 'browser:vue-shell' END, CASE WHEN n = 0 AND (contains(html, 'id=\"root\"') OR contains(html, 'id=\"app\"')) THEN 'browser:empty-shell' END, CASE WHEN len(regexp_extract_all(html, '<script')) >= 3 AND n <= 300 THEN 'browser:script-heavy' END], lambda x: x IS NOT NULL), ',') AS rule_ids FROM r"
)
def fallback_detect(spark, d):
    k = F.col("page_id") % 5
    html = F.when(k == 0, "<script><script><script>").when(k == 1, '<div id="__next">').when(k == 2, "<div data-reactroot>").when(k == 3, '<div id="app" v-cloak>').otherwise("plain")
    txt = F.substring(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(1), (F.col("page_id") % 4 * 30).cast("int"))
    rows = _t(spark, d, "pages").select("page_id", html.alias("h"), txt.alias("t"))
    return rows.select("page_id", F.array_join(text.fallback_rules(F.col("h"), F.col("t"), F.col("page_id") % 11 == 0), ",").alias("rule_ids"))


@query("SELECT doc_id, sha256(text) AS raw_sha256, sha256(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS text_sha256 FROM documents")
def content_hashes(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("raw_sha256"), F.sha2(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")), 256).alias("text_sha256"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_content(spark, d):
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")


@query(
    f"WITH p AS (SELECT page_id, {_HOST} AS company, {_PATH} AS path, sha256(html) AS raw, sha256(regexp_replace(html, '[^<>/a-z]', '', 'g')) AS st FROM pages), l AS (SELECT *, lag(page_id) OVER w AS b_id, lag(raw) OVER w AS b_raw, lag(st) OVER w AS b_st FROM p WINDOW w AS (PARTITION BY company ORDER BY path, page_id)) SELECT page_id, CASE WHEN coalesce(b_raw = raw, false) OR coalesce(b_st = st, false) THEN b_id END AS unchanged_from FROM l"
)
def change_detect(spark, d):
    p = _t(spark, d, "pages").select(
        urls.hostname(F.col("url")).alias("company"), F.lit("").alias("url"), urls.path(F.col("url")).alias("fetched_at"), "page_id", F.sha2("html", 256).alias("raw_hash"), F.sha2(F.regexp_replace("html", "[^<>/a-z]", ""), 256).alias("structural_hash")
    )
    return crawl.changes(p).select("page_id", "unchanged_from")


_EMAIL = text.EMAIL.replace("'", "''")


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL}', '[redacted-email]', 'g')) AS redacted_md5, len(regexp_extract_all(text, '{_EMAIL}')) AS n_emails FROM documents")
def email_redact(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(text.redact_emails(F.col("text"))).alias("redacted_md5"), F.size(F.regexp_extract_all("text", F.lit(text.EMAIL), F.lit(0))).cast("long").alias("n_emails"))


@query(f"WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{text.PHONE}'), lambda x: regexp_replace(x, '[^0-9+]', '', 'g')) AS p FROM documents) SELECT doc_id, unnest(list_distinct(list_filter(p, lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 7 AND 15))) AS phone FROM f")
def phone_extract(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(text.phones(F.col("text"))).alias("phone"))


@query(f"SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{_EMAIL}'), lambda x: lower(x)))) AS email FROM documents")
def email_extract(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(text.emails(F.col("text"))).alias("email"))


@query("SELECT event_id, v AS note, CASE event_id % 4 WHEN 0 THEN DATE '2024-02-29' WHEN 1 THEN NULL WHEN 2 THEN DATE '2023-03-05' END AS found FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'on 2024-02-29 x' WHEN 1 THEN 'on 2023-02-30 or March 5, 2023' WHEN 2 THEN 'opens March 5, 2023!' ELSE 'none' END AS v FROM events)")
def date_parse(spark, d):
    k = F.col("event_id") % 4
    note = F.when(k == 0, "on 2024-02-29 x").when(k == 1, "on 2023-02-30 or March 5, 2023").when(k == 2, "opens March 5, 2023!").otherwise("none")
    return _t(spark, d, "events").select("event_id", note.alias("note")).select("event_id", "note", text.date(F.col("note")).alias("found"))


_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(r, '(?i){p}') THEN '{n}'" for n, p in rules.ROLES) + " ELSE 'unknown' END"
_TITLES = ["Founder & CEO", "IT Manager", "warehouse  manager", "Head of Brand", "Customer Service", "Sales rep", "Director", "Chef", "Ecommerce lead", "Shop owner"]


@query("WITH t AS (SELECT c_custkey, CASE c_custkey % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + f" END AS r FROM customer), k AS (SELECT c_custkey, {_ROLE} AS role FROM t) SELECT c_custkey, role, CASE role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.CONTACT_PRIORITY.items()) + " ELSE 9 END AS priority FROM k")
def role_priority(spark, d):
    title = F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (F.col("c_custkey") % 10 + 1).cast("int"))
    rows = _t(spark, d, "customer").select("c_custkey", text.role(title).alias("role"))
    return rows.withColumn("priority", text.contact_priority(F.col("role")))


def _technology_sql() -> str:
    parts = []
    for name, field, hosts, generators, marks, conf in rules.TECHNOLOGIES:
        def any_of(column, words):
            return " OR ".join(f"contains({column}, '{w}')" for w in words) or "false"

        parts.append(f"SELECT page_id, '{name}' AS technology, '{field}' AS field, {conf} AS confidence, CASE WHEN {any_of('src', hosts)} THEN 'script_marker' WHEN {any_of('gen', generators)} THEN 'meta_tag' ELSE 'html_element' END AS source FROM s WHERE {any_of('src', hosts)} OR {any_of('gen', generators)} OR {any_of('low', marks)}")
    seeds = ["https://cdn.shopify.com/a.js", "wp-content/plugins/woocommerce", "magento", "https://static.wix.com/x", "squarespace", "none"]
    case = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(seeds))
    return f"WITH s AS (SELECT page_id, CASE page_id % 6 {case} END AS src, CASE (page_id // 6) % 6 {case} END AS gen, lower(html) || CASE (page_id // 36) % 6 {case} END AS low FROM pages) " + " UNION ALL ".join(parts)


@query(_technology_sql())
def tech_signatures(spark, d):
    seeds = F.array(*[F.lit(x) for x in ["https://cdn.shopify.com/a.js", "wp-content/plugins/woocommerce", "magento", "https://static.wix.com/x", "squarespace", "none"]])

    def pick(k):
        return F.element_at(seeds, (k % 6 + 1).cast("int"))

    s = _t(spark, d, "pages").select("page_id", pick(F.col("page_id")).alias("src"), pick(F.floor(F.col("page_id") / 6)).alias("gen"), F.concat(F.lower("html"), pick(F.floor(F.col("page_id") / 36))).alias("low"))

    pages = s.select(F.lit("h").alias("host"), "page_id", F.array("src").alias("script_hosts"), F.col("gen").alias("generator"), F.col("low").alias("cleaned"))
    return extract.technology(pages).select("page_id", F.col("value").alias("technology"), "field", "confidence", "source")


_PHRASES = ["Wholesale  enquiries here", "we do not offer wholesale", "click & collect", "made to order", "trade account", "online-only store", "nothing"]


def _business_sql() -> str:
    case = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES))
    parts = [f"SELECT doc_id, '{field}' AS field, {str(value).lower()} AS value, {conf} AS confidence FROM s WHERE regexp_matches(t, '(?i){'|'.join(ps)}')" for field, value, conf, ps in rules.BUSINESS_RULES]
    return f"WITH s AS (SELECT doc_id, text || ' ' || CASE doc_id % 7 {case} END AS t FROM documents) " + " UNION ALL ".join(parts)


@query(_business_sql())
def pattern_rules_simple(spark, d):
    said = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("doc_id") % 7 + 1).cast("int"))
    s = _t(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" "), said).alias("t"))
    pages = s.select(F.lit("h").alias("host"), F.col("doc_id").alias("page_id"), F.col("t").alias("text"))
    return extract.business_model(pages).select(F.col("page_id").alias("doc_id"), "field", (F.col("value") == "true").alias("value"), "confidence")


_IMPORT = f"i AS (SELECT page_id, 0 AS batch, CASE WHEN page_id % 13 = 0 THEN NULL ELSE regexp_replace({_HOST}, '^www\\.', '') END AS domain FROM pages), o AS (SELECT *, CASE WHEN domain IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY batch, domain ORDER BY page_id) > 1 THEN 'duplicate' ELSE 'importable' END AS outcome FROM i)"


def _imports(spark, d) -> DataFrame:
    site = F.when(F.col("page_id") % 13 == 0, F.lit("localhost")).otherwise(F.col("url"))
    rows = _t(spark, d, "pages").select("page_id", F.lit(0).alias("batch"), urls.website(site).alias("domain"))
    return views.import_rows(rows, order="page_id")


@query(f"WITH {_IMPORT} SELECT page_id, domain, outcome FROM o")
def import_dedupe(spark, d):
    return _imports(spark, d).select("page_id", "domain", "outcome")


@query(f"WITH {_IMPORT} SELECT count(*) AS n_rows, count(*) FILTER (WHERE outcome <> 'invalid') AS n_valid, count(*) FILTER (WHERE outcome = 'invalid') AS n_invalid, count(*) FILTER (WHERE outcome = 'duplicate') AS n_duplicates, count(*) FILTER (WHERE outcome = 'importable') AS n_importable FROM o")
def import_summary(spark, d):
    o = F.col("outcome")
    return _imports(spark, d).agg(
        F.count("*").alias("n_rows"), F.count_if(o != "invalid").alias("n_valid"), F.count_if(o == "invalid").alias("n_invalid"), F.count_if(o == "duplicate").alias("n_duplicates"), F.count_if(o == "importable").alias("n_importable")
    )
