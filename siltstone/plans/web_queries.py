"""Queries on links, hosts, bodies, sitemaps, run keys and projections, each with its DuckDB counterpart."""

from __future__ import annotations

import ipaddress


from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import addresses, rules, text, urls
from siltstone.operators import asof, crawl, discovery, facts, gate, runs, views
from siltstone.plans.queries import _CANON, _HOST, _LINKS, _list, _t, query
from siltstone.plans.run_queries import _pick, _pick_sql

# The references of section 5.4 of RFC 3986, normal and abnormal.
_REFERENCES = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g",
    "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "g#s/../x", "http:g",
]


def _folded(segments: str) -> str:
    """SQL: a list of segments without dots, as a path."""
    fold = f"list_reduce(list_transform({segments}, lambda s: [s]), lambda a, x: CASE WHEN x[1] = '..' THEN a[1:len(a) - 1] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END, CAST([] AS VARCHAR[]))"
    whole = f"array_to_string(list_concat({fold}, CASE WHEN ({segments})[-1] IN ('.', '..') THEN [''] ELSE CAST([] AS VARCHAR[]) END), '/')"
    return f"CASE WHEN starts_with({whole}, '/') THEN {whole} ELSE '/' || {whole} END"


@query(
    f"""WITH given AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/b/c/d;p?q' AS base, unnest([{_list(_REFERENCES)}]) AS ref, generate_subscripts([{_list(_REFERENCES)}], 1)::INT - 1 AS ord FROM pages
   UNION ALL SELECT page_id, url, href, (1000 + ord)::INT FROM ({_LINKS})),
 cut AS (SELECT *, regexp_extract(base, '^([a-z]+)://', 1) AS bs, regexp_extract(base, '^[a-z]+://([^/?#]*)', 1) AS ba, regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS bp, nullif(regexp_extract(base, '^[^?#]*\\?([^#]*)', 1), '') AS bq,
   nullif(regexp_extract(ref, '^([a-z]+):', 1), '') AS rs, regexp_replace(ref, '^[a-z]+:', '') AS rest FROM given),
 part AS (SELECT *, nullif(regexp_extract(rest, '^//([^/?#]*)', 1), '') AS ra, regexp_extract(regexp_replace(rest, '^//[^/?#]*', ''), '^([^?#]*)', 1) AS rp, nullif(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '') AS rq, nullif(regexp_extract(rest, '#(.*)$', 1), '') AS rf FROM cut),
 own AS (SELECT *, regexp_extract(rp, '(;[^/]*)$', 1) AS params, string_split(regexp_replace(rp, ';[^/]*$', ''), '/') AS o, string_split(regexp_replace(bp, '[^/]+$', ''), '/') AS b FROM part),
 seg AS (SELECT *, CASE WHEN starts_with(rp, '/') THEN o ELSE list_concat([''], list_filter(list_concat(b, o)[2:-2], lambda x: x <> ''), [o[-1]]) END AS s FROM own),
 path AS (SELECT *, {_folded("s")} || params AS p FROM seg)
 SELECT page_id, ord, ref, CASE WHEN ref = '' THEN base WHEN rs <> bs THEN ref
   WHEN ra IS NOT NULL THEN bs || '://' || ra || rp || coalesce('?' || rq, '') || coalesce('#' || rf, '')
   WHEN rp = '' THEN bs || '://' || ba || bp || coalesce('?' || coalesce(rq, bq), '') || coalesce('#' || rf, '')
   ELSE bs || '://' || ba || p || coalesce('?' || rq, '') || coalesce('#' || rf, '') END AS resolved FROM path"""
)
def reference_resolution(spark, d):
    """All references of the standard on a folder of every page's host, and every page's own links, made absolute."""
    pages = _t(spark, d, "pages").select("page_id", "url", "html")
    base = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/b/c/d;p?q"))
    given = pages.select("page_id", base.alias("base")).select("page_id", "base", F.posexplode(F.array(*[F.lit(x) for x in _REFERENCES])).alias("ord", "ref"))
    links = discovery.href_links(pages).select("page_id", F.col("url").alias("base"), (F.col("ord") + 1000).alias("ord"), F.col("href").alias("ref"))
    return urls.with_resolved(given.unionByName(links), "base", "ref", "resolved").select("page_id", "ord", "ref", "resolved")


# Labels and their forms in ASCII.
_LABELS = [("münchen", "xn--mnchen-3ya"), ("Bücher", "xn--bcher-kva"), ("faß", "fass"), ("日本語", "xn--wgv71a119e"), ("пример", "xn--e1afmkfd"), ("ελλάδα", "xn--hxakic4aa"), ("plain", "plain"), ("ü" * 70, "")]


@query(
    f"WITH p AS (SELECT page_id, page_id % {len(_LABELS)} + 1 AS k, {_CANON} AS canon FROM pages) SELECT page_id, CASE WHEN k < {len(_LABELS)} THEN regexp_replace(canon, '^([a-z]+://)', '\\1' || ([{_list(x for _, x in _LABELS)}])[k] || '.') END AS normalized_url, CASE WHEN k = {len(_LABELS)} THEN 'malformed URL: invalid host label' END AS reason FROM p"
)
def ascii_hosts(spark, d):
    """Every page's address under a label of another script, normalised: hosts in Punycode, too long labels rejected."""
    label = _pick([x for x, _ in _LABELS], F.col("page_id"))
    pages = _t(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", "^([a-z]+://)", 1), label, F.lit("."), F.regexp_extract("url", "^[a-z]+://(.*)$", 1)).alias("url"))
    rows = addresses.with_ascii_host(pages, "url", "plain")
    return rows.select("page_id", urls.normalize(F.col("plain")).alias("normalized_url"), urls.rejection(F.col("plain")).alias("reason"))


_GROUPS6 = ["2001", "2002", "fe80", "fc00", "2600", "ff02", "64", "3fff", "2001:20", "2001:db8", "0"]
_SPAN = "(event_id * 2654435761) % 4294967296"


def _networks(names: list[str]) -> str:
    nets = [ipaddress.ip_network(x) for x in names]
    return ", ".join(f"({n.version}, '{int(n[0])}'::UHUGEINT, '{int(n[-1])}'::UHUGEINT)" for n in nets)


@query(
    f"""WITH e AS (SELECT event_id, event_id % 5 AS kind, {_SPAN} AS n, ([{_list(_GROUPS6)}])[event_id % {len(_GROUPS6)} + 1] AS g FROM events),
 h AS (SELECT *, CASE kind WHEN 0 THEN concat_ws('.', n >> 24, n >> 16 & 255, n >> 8 & 255, n & 255) WHEN 1 THEN g || '::' || printf('%x:%x', n >> 16, n & 65535) WHEN 2 THEN '[' || upper(g) || '::' || concat_ws('.', n >> 24, n >> 16 & 255, n >> 8 & 255, n & 255) || ']'
   WHEN 3 THEN concat_ws('.', 256 + (n >> 24), n >> 16 & 255, 0, 1) ELSE g || ':' || printf('%x', n & 65535) || '::1::' END AS host FROM e),
 v AS (SELECT *, CASE WHEN kind = 0 THEN 4 WHEN kind < 3 THEN 6 END AS version, CASE WHEN kind = 0 THEN n::UHUGEINT WHEN kind < 3 THEN ('0x' || lpad(split_part(g, ':', 1), 4, '0'))::UHUGEINT * pow(2::DOUBLE, 112)::UHUGEINT + ('0x0' || split_part(g, ':', 2))::UHUGEINT * pow(2::DOUBLE, 96)::UHUGEINT + n::UHUGEINT END AS value FROM h),
 i(version, a, b) AS (VALUES {_networks(rules.INNER_NETWORKS)}), o(version, a, b) AS (VALUES {_networks(rules.OUTER_NETWORKS)})
 SELECT event_id, host, version, CASE WHEN version IS NOT NULL THEN EXISTS (SELECT 1 FROM i WHERE i.version = v.version AND value BETWEEN a AND b) AND NOT EXISTS (SELECT 1 FROM o WHERE o.version = v.version AND value BETWEEN a AND b) END AS inner_range FROM v"""
)
def ip_ranges(spark, d):
    """Addresses of both families, made of every event, against the table of private and reserved ranges."""
    n = F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296))

    def byte(k):
        return F.shiftright(n, k).bitwiseAND(255).cast("string")

    four = F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))
    g, kind = _pick(_GROUPS6, F.col("event_id")), F.col("event_id") % 5
    low, high = F.lower(F.hex(n.bitwiseAND(65535))), F.lower(F.hex(F.shiftright(n, 16)))
    host = (
        F.when(kind == 0, four).when(kind == 1, F.concat(g, F.lit("::"), high, F.lit(":"), low)).when(kind == 2, F.concat(F.lit("["), F.upper(g), F.lit("::"), four, F.lit("]")))
        .when(kind == 3, F.concat_ws(".", (F.shiftright(n, 24) + 256).cast("string"), byte(16), F.lit("0"), F.lit("1"))).otherwise(F.concat(g, F.lit(":"), low, F.lit("::1::")))
    )
    rows = _t(spark, d, "events").select("event_id", host.alias("host")).withColumn("number", addresses.ip_number(F.col("host")))
    ranges = spark.createDataFrame(addresses.inner_ranges(), "first string, last string").withColumn("hit", F.lit(True))
    found = addresses.in_ranges(rows, ranges)
    return found.select("event_id", "host", F.substring("number", 1, 1).cast("int").alias("version"), F.when(F.col("number").isNotNull(), F.coalesce("hit", F.lit(False))).alias("inner_range"))


_SENT = "[^\\x00-\\x7F]"


@query(
    """WITH p AS (SELECT page_id, page_id % 8 AS k, coalesce(html, '') AS html, regexp_replace(coalesce(html, ''), '[^\\x00-\\x7F]', '', 'g') AS plain FROM pages),
 t AS (SELECT page_id, k, CASE k WHEN 2 THEN html || chr(65533) WHEN 3 THEN chr(65533) || html WHEN 4 THEN chr(65533) || html WHEN 5 THEN plain || '€' || chr(65533) WHEN 6 THEN html || chr(65533) WHEN 7 THEN plain || 'аб' ELSE html END AS html FROM p)
 SELECT page_id, CASE k WHEN 1 THEN 'UTF-16LE' WHEN 2 THEN 'UTF-16BE' WHEN 3 THEN 'UTF-16LE' WHEN 5 THEN 'windows-1252' WHEN 7 THEN 'koi8-r' ELSE 'UTF-8' END AS charset, md5(html) AS html_md5, k IN (2, 3, 4, 5, 6) AS replaced, k IN (2, 5, 6) AS truncated FROM t"""
)
def body_decoding(spark, d):
    """Every page's markup as a body in one of eight charsets, some with odd, lone, undefined or cut bytes, read back."""
    html, k = F.coalesce("html", F.lit("")), F.col("page_id") % 8
    plain = F.regexp_replace(html, _SENT, "")

    def raw(hexed):
        return F.unhex(F.lit(hexed))

    body = (
        F.when(k == 1, F.concat(raw("FFFE"), F.encode(html, "UTF-16LE"))).when(k == 2, F.concat(F.encode(html, "UTF-16BE"), raw("D8"))).when(k == 3, F.concat(raw("00D8"), F.encode(html, "UTF-16LE")))
        .when(k == 4, F.concat(raw("FF"), F.encode(html, "UTF-8"))).when(k == 5, F.concat(F.encode(plain, "UTF-8"), raw("8081"))).when(k == 6, F.concat(F.encode(html, "UTF-8"), raw("E282"))).when(k == 7, F.concat(F.encode(plain, "UTF-8"), raw("C1C2"))).otherwise(F.encode(html, "UTF-8"))
    )
    kind = F.when(k == 2, "text/html; charset=utf-16be").when(k == 3, 'text/html; charset="UTF-16LE"').when(k == 5, "text/html;charset=windows-1252").when(k == 7, "text/html; charset=KOI8-R").otherwise("text/html")
    bodies = _t(spark, d, "pages").select("page_id", body.alias("body"), kind.alias("kind"))
    return text.decoded(bodies, "body", "kind").select("page_id", "decoded.charset", F.md5("decoded.html").alias("html_md5"), "decoded.replaced", "decoded.truncated")


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey % 160 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ((o_orderkey * 7919) % 2592000) AS at FROM orders),
 e AS (SELECT user_id, ts, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1, 2)
 SELECT o_orderkey, event_id, event_type FROM o ASOF LEFT JOIN e ON o.user_id = e.user_id AND o.at > e.ts"""
)
def page_as_of(spark, d):
    """Every order as a target with the latest event of its user before its time."""
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("o_orderkey") * 7919) % 2592000)
    targets = _t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 160).alias("user_id"), at.alias("at"))
    pages = _t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    return asof.latest_before(targets, pages, ["user_id"], ["event_id", "event_type"], "at", "ts", "event_id").select("o_orderkey", "event_id", "event_type")


@query(
    """WITH RECURSIVE k AS (SELECT p_partkey AS k, count(*) OVER () AS n FROM part), e AS (SELECT DISTINCT k AS parent, unnest([2 * k, 2 * k + 1, (3 * k) % n, 1]) AS child, unnest([0, 1, 2, 3]) AS ord FROM k),
 r AS (SELECT n_nationkey AS run, n_nationkey::BIGINT + 1 AS url, 0 AS ord FROM nation UNION ALL SELECT n_nationkey, n_nationkey::BIGINT * 3 + 2, 1 FROM nation),
 walk(run, url, depth, path) AS (SELECT run, url, 0, [ord] FROM r UNION SELECT run, child, depth + 1, list_append(path, e.ord) FROM walk JOIN e ON parent = url WHERE depth < 4),
 least AS (SELECT * FROM (SELECT run, url, depth, min(path) AS path FROM walk GROUP BY 1, 2, 3) QUALIFY depth = min(depth) OVER (PARTITION BY run, url))
 SELECT run, url, depth::INT AS depth, (row_number() OVER (PARTITION BY run ORDER BY depth, path, url))::INT AS position FROM least QUALIFY position <= 50"""
)
def sitemap_reading(spark, d):
    """The files that the runs of all nations read, from two roots each, over a graph with cycles made of the parts."""
    parts = _t(spark, d, "part")
    n = parts.count()
    k = F.col("p_partkey")
    edges = parts.select(k.alias("parent"), F.posexplode(F.array(2 * k, 2 * k + 1, (3 * k) % n, F.lit(1).cast("long"))).alias("ord", "child"))
    nations = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    roots = nations.select(F.col("k").cast("int").alias("run"), F.posexplode(F.array(F.col("k") + 1, F.col("k") * 3 + 2)).alias("ord", "url"))
    return discovery.sitemap_search(roots, edges, depth=4)


_POLICIES = ["never", "detect_only", "enabled"]
_STATES = ["completed", "failed", "queued", "partial", "cancelled", "completed_with_warnings"]
_REQUESTS = f"""q AS (SELECT o_orderkey, o_custkey % 50 AS company, o_orderkey % 7 AS discovery, o_orderkey % 3 AS attempts, list_sort(['https://é.co/' || (o_orderkey % 4), 'a"b']) AS manual, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5)::VARCHAR ELSE 'null' END AS most, {_pick_sql(_POLICIES, "o_orderkey % 9 // 3")} AS policy, o_orderkey % 11 = 0 AS force, o_orderdate, {_pick_sql(_STATES, "o_orderkey % 6")} AS status FROM orders),
 j AS (SELECT *, '{{"default_delay_s": 1.0, "max_attempts": ' || attempts || ', "retryable_status_codes": [429, 500, 503], "user_agent": "bot/1.0"}}' AS config, '{{"browser_policy": "' || policy || '", "exclude_page_types": [], "force_refresh": ' || force || ', "include_page_types": ["about", "contact"], "manual_urls": [' || array_to_string(list_transform(manual, lambda m: '"' || replace(replace(m, '"', '\\"'), 'é', '\\u00e9') || '"'), ', ') || '], "max_pages": ' || most || '}}' AS options FROM q),
 k AS (SELECT *, sha256(company || '|' || discovery || '|' || sha256(config) || '|' || sha256(options)) AS key FROM j)"""


@query(
    f"""WITH {_REQUESTS}, r AS (SELECT company, key, arg_max(o_orderkey, (epoch_us(o_orderdate)::HUGEINT * 1000000000 + o_orderkey)) AS run, arg_max(status, (epoch_us(o_orderdate)::HUGEINT * 1000000000 + o_orderkey)) AS s FROM k WHERE o_orderkey % 2 = 0 AND status NOT IN ('failed', 'cancelled') GROUP BY 1, 2)
 SELECT o_orderkey, k.key, CASE WHEN s IN ('queued', 'running') THEN 'rejected' WHEN s IS NOT NULL THEN 'reused' ELSE 'new' END AS outcome, run AS known_run FROM k LEFT JOIN r ON r.company = k.company AND r.key = k.key WHERE o_orderkey % 2 = 1"""
)
def run_reuse(spark, d):
    """Requests with their keys, and the run that each repeats: odd orders as requests, even ones as runs."""
    k = F.col("o_orderkey")
    config_kind = T.StructType().add("user_agent", T.StringType()).add("max_attempts", T.LongType()).add("default_delay_s", T.DoubleType()).add("retryable_status_codes", T.ArrayType(T.IntegerType()))
    config = F.struct(F.lit("bot/1.0").alias("user_agent"), (k % 3).alias("max_attempts"), F.lit(1.0).alias("default_delay_s"), F.array(*[F.lit(x) for x in (503, 429, 500)]).alias("retryable_status_codes"))
    options = {
        "manual_urls": F.array(F.concat(F.lit("https://é.co/"), (k % 4).cast("string")), F.lit('a"b')), "include_page_types": F.array(F.lit("contact"), F.lit("about")), "max_pages": F.nullif(k % 5, F.lit(0)),
        "browser_policy": _pick(_POLICIES, F.floor(k % 9 / 3)), "force_refresh": k % 11 == 0,
    }
    company = F.col("o_custkey") % 50
    rows = _t(spark, d, "orders").select(k, company.alias("company"), runs.crawl_key(company, k % 7, config, config_kind, options).alias("key"), F.col("o_orderdate").alias("created_at"), _pick(_STATES, k % 6).alias("status"), k.alias("run_id"))
    found = runs.reuse(rows.where("o_orderkey % 2 = 1").select("o_orderkey", "company", "key"), rows.where("o_orderkey % 2 = 0"))
    return found.select("o_orderkey", "key", "outcome", "known_run")


_FIELDS = ["identity.company_name", "identity.country", "business.wholesale", "catalogue.sizes.max", "operations.locations", "technology.platform", "organisation.emails", "growth.hiring", "other.thing"]
_FACT_STATES = ["verified", "measured", "conflicting", "stale"]


@query(
    f"""WITH f AS (SELECT l_suppkey AS company, {_pick_sql(_FIELDS, "l_partkey")} AS field, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS ord, l_extendedprice::VARCHAR AS value, {_pick_sql(_FACT_STATES, "l_orderkey")} AS state, (50 + l_linenumber * 7)::BIGINT AS confidence, l_linenumber::BIGINT AS n_evidence FROM lineitem),
 g AS (SELECT *, split_part(field, '.', 1) AS grp, regexp_replace(field, '^[^.]*\\.', '') AS short FROM f WHERE NOT starts_with(field, 'other.')),
 s AS (SELECT company, grp, short, arg_max(confidence, ord) AS confidence, arg_max(state, ord) AS state, arg_max(n_evidence, ord) AS n_evidence FROM g GROUP BY 1, 2, 3),
 q AS (SELECT company, count(*) FILTER (WHERE state NOT IN ('stale', 'conflicting')) AS accepted, count(*) FILTER (WHERE state = 'conflicting') AS conflicting, count(*) FILTER (WHERE state = 'stale') AS stale, coalesce(floor(avg(confidence) FILTER (WHERE state NOT IN ('stale', 'conflicting'))), 0)::BIGINT AS mean, count(DISTINCT field) AS covered FROM g GROUP BY 1)
 SELECT s.company, grp AS field_group, short, confidence, state, n_evidence, accepted, conflicting, stale, mean, covered FROM s JOIN q ON s.company = q.company"""
)
def projection_maps(spark, d):
    """The maps of all suppliers' facts, an entry a row, with what the company's summary says."""
    rows = _t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("company"), _pick(_FIELDS, F.col("l_partkey")).alias("field"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey")).alias("ord"), F.col("l_extendedprice").cast("string").alias("value"),
        _pick(_FACT_STATES, F.col("l_orderkey")).alias("state"), (F.lit(50) + F.col("l_linenumber") * 7).cast("long").alias("confidence"), F.sequence(F.lit(1), F.col("l_linenumber")).alias("evidence"), F.col("l_shipdate").alias("verified_at"),
    )
    found = facts.group_maps(rows)

    def entries_of(group):
        return F.transform(F.map_entries(group), lambda e: F.struct(F.lit(group).alias("g"), e["key"].alias("short"), e["value"].alias("shown")))

    entries = F.concat(*[entries_of(g) for g in rules.GROUPS])
    out = found.select("company", "quality", F.explode(entries).alias("e"))
    return out.select(
        "company", F.col("e.g").alias("field_group"), "e.short", "e.shown.confidence", F.col("e.shown.verification_state").alias("state"), F.size("e.shown.evidence_ids").cast("long").alias("n_evidence"), F.col("quality.facts_accepted").alias("accepted"),
        F.col("quality.facts_conflicting").alias("conflicting"), F.col("quality.facts_stale").alias("stale"), F.col("quality.average_confidence").alias("mean"), F.col("quality.fields_covered").alias("covered"),
    )


@query(
    """WITH v AS (SELECT l_orderkey % 500 AS company, l_linenumber % 5 AS k, l_linenumber, l_quantity, l_returnflag FROM lineitem),
 t AS (SELECT company, CASE k WHEN 0 THEN 'text:' || lower(l_returnflag) WHEN 1 THEN 'number:' || (l_quantity::BIGINT)::VARCHAR WHEN 2 THEN 'number:' || CASE WHEN l_quantity % 2 = 0 THEN ((l_quantity / 2)::BIGINT)::VARCHAR ELSE (l_quantity / 2)::VARCHAR END WHEN 3 THEN 'number:' || (l_returnflag = 'N')::INT ELSE 'text:' || l_linenumber END AS key FROM v)
 SELECT company, key AS value_key, count(*) AS n FROM t GROUP BY 1, 2"""
)
def typed_values(spark, d):
    """Values of several kinds, grouped by their typed keys: integers, whole and broken floats, booleans and texts."""
    k = F.col("l_linenumber") % 5
    value = (
        F.when(k == 0, F.concat(F.lit(" "), "l_returnflag", F.lit(" "))).when(k == 1, F.col("l_quantity").cast("long").cast("string")).when(k == 2, (F.col("l_quantity") / 2).cast("string"))
        .when(k == 3, F.when(F.col("l_returnflag") == "N", "True").otherwise("false")).otherwise(F.col("l_linenumber").cast("string"))
    )
    kind = F.when(k == 1, "integer").when(k == 2, "float").when(k == 3, "boolean").otherwise("string")
    rows = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("company"), facts.value_key(value, kind).alias("value_key"))
    return rows.groupBy("company", "value_key").agg(F.count("*").alias("n"))


_PATHS = ["/", "/about", "/products/x", "/brands", "/contact"]
_KINDS = ["homepage", "about", "product", "brands", "contact"]
_IDS = sorted(x[1] for x in rules.EXTRACTORS)
_CATALOGUE = ", ".join(f"('{i}', '{v}', [{_list(t)}]::VARCHAR[])" for _, i, v, t, _ in rules.EXTRACTORS)
_FETCHED = ["fetched", "unchanged", "failed", "browser_fetched"]


@query(
    f"""WITH p AS (SELECT page_id, {_pick_sql(_KINDS, "page_id")} AS kind, {_pick_sql(_FETCHED, "page_id // 5")} AS fetch_status FROM pages), x(id, version, types) AS (VALUES {_CATALOGUE}),
 c AS (SELECT page_id, ([{_list(_IDS)}])[page_id % {len(_IDS)} + 1] AS id, page_id % 4 AS n FROM pages)
 SELECT p.page_id, x.id AS extractor_id, version, CASE WHEN p.page_id % 13 = 0 AND x.id = 'growth.signals' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN p.page_id % 13 = 0 AND x.id = 'growth.signals' THEN 0 ELSE coalesce(n, 0) END AS candidates_produced
 FROM p JOIN x ON len(types) = 0 OR list_contains(types, kind) LEFT JOIN c ON c.page_id = p.page_id AND c.id = x.id WHERE fetch_status <> 'failed' AND p.page_id % 17 <> 0"""
)
def extractor_audit(spark, d):
    """The record of all extractors over all pages: which ran where, what failed, and how many candidates each gave."""
    p = F.col("page_id")
    pages = _t(spark, d, "pages").select(p, discovery.classify(_pick(_PATHS, p))["page_type"].alias("page_type"), _pick(_FETCHED, F.floor(p / 5)).alias("fetch_status"), (p % 17 != 0).alias("has_content"))
    candidates = _t(spark, d, "pages").where(p % 4 > 0).select(p, _pick(_IDS, p).alias("extractor_id"), F.explode(F.sequence(F.lit(1).cast("long"), p % 4)).alias("n"))
    failures = _t(spark, d, "pages").where(p % 13 == 0).select(p, F.lit("growth.signals").alias("extractor_id"))
    return gate.executions(pages, candidates, failures)


_DELAYS = ["10", "2", "1e1", "0.5", "soon", ".25", "7 # then"]


@query(
    f"""WITH p AS (SELECT page_id, ([{_list(_DELAYS)}])[page_id % 7 + 1] AS a, ([{_list(_DELAYS)}])[page_id // 7 % 7 + 1] AS b, page_id % 3 AS k FROM pages), v AS (SELECT page_id, k, TRY_CAST(trim(split_part(a, '#', 1)) AS DOUBLE) AS a, TRY_CAST(trim(split_part(b, '#', 1)) AS DOUBLE) AS b FROM p)
 SELECT page_id AS origin, CASE WHEN k < 2 THEN coalesce(b, a) ELSE coalesce(a, 99) END AS delay FROM v WHERE k = 2 OR a IS NOT NULL OR b IS NOT NULL"""
)
def robots_last_delay(spark, d):
    """Delays of a robots file of each page's own, with two lines: for the agent, for all, or one for each."""
    p = F.col("page_id")
    a, b = _pick(_DELAYS, p), _pick(_DELAYS, F.floor(p / 7))
    said = (
        F.when(p % 3 == 0, F.concat(F.lit("User-agent: Silt\nCrawl-delay: "), a, F.lit("\nDisallow: /x\nUser-agent: other\nUser-agent: silt\ncrawl-delay:"), b))
        .when(p % 3 == 1, F.concat(F.lit("User-agent: *\nCrawl-delay: "), a, F.lit("\nCrawl-delay: "), b)).otherwise(F.concat(F.lit("User-agent: *\nCrawl-delay: 99\n\nUser-agent: silt\nCrawl-delay: "), a))
    )
    files = _t(spark, d, "pages").select(p.alias("origin"), said.alias("text"))
    return crawl.robots_delays(files, "silt").select("origin", "delay")


@query(
    f"""WITH l AS (SELECT page_id, url AS page, href, 'navigation' AS source FROM ({_LINKS}) UNION ALL SELECT page_id, url, '/c/' || page_id || '/', 'canonical' FROM pages UNION ALL SELECT page_id, url, '//alt.co/' || page_id, 'alternate' FROM pages),
 a AS (SELECT page_id, source, CASE WHEN starts_with(href, '//') THEN split_part(page, ':', 1) || ':' || href ELSE regexp_extract(page, '^([a-z]+://[^/?#]*)', 1) || href END AS url FROM l)
 SELECT page_id, source, {_CANON} AS normalized_url, count(*) AS n FROM a GROUP BY 1, 2, 3"""
)
def page_link_candidates(spark, d):
    """All pages' anchors with a canonical and an alternate address put before them, as candidates."""
    from siltstone.sources.html_pages import parse_pages

    p = F.col("page_id").cast("string")
    head = F.concat(F.lit("<link rel=Canonical href=' /c/"), p, F.lit("/ '><link rel=canonical href=/late><link rel=alternate href='//ALT.co/"), p, F.lit("#x'><link rel=alternate href='mailto:a@b.co'><link rel=icon href=/i>"))
    pages = _t(spark, d, "pages").select("page_id", "url", F.concat(head, "html").alias("html"))
    found = discovery.page_candidates(parse_pages(pages))
    return found.groupBy("page_id", "source", "normalized_url").agg(F.count("*").alias("n"))


# What is typed as a website before a page's path, whether its own host stands in it, and what comes of it.
_TYPED = [
    ("", True, None), ("  WWW.", True, None), ("ftp://u:p@", True, None), ("", False, "missing website"), ("localhost:80", False, "localhost is not allowed"), ("http://10.0.0.1", False, "IP addresses are not allowed"),
    ("[2606:4700::1]", False, "IP addresses are not allowed"), ("intranet", False, "private/internal hostnames are not allowed"), ("a.test", False, "private/internal hostnames are not allowed"), ("-a.co", False, "malformed host"), ("münchen.", True, None), ("http://", False, "malformed host"),
]
_SOLD = ["Shopify", " MAGENTO ", "unheard-of", "", "custom"]


@query(
    f"""WITH p AS (SELECT page_id, page_id % {len(_TYPED)} + 1 AS k, {_HOST} AS host, {_pick_sql(_SOLD, "page_id")} AS sold FROM pages)
 SELECT page_id, CASE k WHEN 1 THEN regexp_replace(host, '^www\\.', '') WHEN 2 THEN host WHEN 3 THEN regexp_replace(host, '^www\\.', '') WHEN 11 THEN 'xn--mnchen-3ya.' || host END AS normalized_domain, CASE sold WHEN 'Shopify' THEN 'shopify' WHEN ' MAGENTO ' THEN 'magento' WHEN 'custom' THEN 'custom' END AS platform, CASE WHEN page_id % 2 = 0 THEN 'Perth' END AS city,
  CASE WHEN k IN (1, 2, 3, 11) THEN 'valid' ELSE 'invalid' END AS validation_status, ([{", ".join("NULL" if w is None else f"'{w}'" for _, _, w in _TYPED)}])[k] AS message FROM p"""
)
def import_row_errors(spark, d):
    """Every page's host as a row of a pasted list, typed in twelve ways, with what is wrong with it."""
    k = F.col("page_id") % len(_TYPED)
    own = F.when(_pick([str(x) for _, x, _ in _TYPED], F.col("page_id")) == "True", urls.hostname(F.col("url"))).otherwise("")
    typed = F.when(k == 3, " ").otherwise(F.concat(_pick([x for x, _, _ in _TYPED], F.col("page_id")), own, F.lit("/x?y#z")))
    rows = _t(spark, d, "pages").select("page_id", typed.alias("website"), _pick(_SOLD, F.col("page_id")).alias("platform"), F.lit(" ").alias("country"), F.when(F.col("page_id") % 2 == 0, " Perth").alias("city"))
    found = views.checked_rows(rows)
    return found.select("page_id", "normalized_domain", "platform", "city", "validation_status", F.get("errors.message", F.lit(0)).alias("message"))


@query("SELECT sha256(html) AS digest, count(*) AS n_pages, any_value(strlen(html)) AS n_bytes FROM pages WHERE html IS NOT NULL GROUP BY 1")
def stored_bodies(spark, d):
    """All pages' markup, stored under its digest and checked."""
    found = runs.store_bodies(_t(spark, d, "pages").select("page_id", F.col("html").alias("body")))
    return found.select("digest", "n_pages", F.octet_length("body").cast("long").alias("n_bytes"))
