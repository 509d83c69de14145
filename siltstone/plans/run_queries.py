"""Queries on runs, filters and kept facts, each with its DuckDB counterpart over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import facts, filters, reconcile, runs, views
from siltstone.plans.queries import _list, _t, query


def _pick(values: list[str], n: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], n: str) -> str:
    return f"([{_list(values)}])[({n}) % {len(values)} + 1]"


_FETCH = ["fetched", "unchanged", "skipped", "blocked_by_robots", "rejected", "failed", "browser_required", "browser_fetched", "fetched"]
_TARGETS = f"""t AS (SELECT l_orderkey AS run_id, l_linenumber AS ord, l_partkey AS part, CASE WHEN l_linenumber = 1 THEN 'homepage' ELSE 'product' END AS page_type, {_pick_sql(_FETCH, "l_partkey + l_suppkey")} AS fetch_status,
 (l_suppkey % 3 = 0)::BIGINT AS n_warnings, l_quantity::BIGINT AS bytes, l_orderkey % 50 = 0 AS cancelled FROM lineitem)"""


def _targets(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") == 1, "homepage").otherwise("product").alias("page_type"),
        _pick(_FETCH, F.col("l_partkey") + F.col("l_suppkey")).alias("fetch_status"), (F.col("l_suppkey") % 3 == 0).cast("long").alias("n_warnings"), F.col("l_quantity").cast("long").alias("bytes"), (F.col("l_orderkey") % 50 == 0).alias("cancelled"),
    )


@query(
    f"""WITH {_TARGETS}, g AS (SELECT run_id, count(*) AS targets_selected, count(*) FILTER (WHERE fetch_status IN ('fetched', 'browser_required', 'browser_fetched')) AS pages_fetched, count(*) FILTER (WHERE fetch_status = 'unchanged') AS pages_unchanged,
 count(*) FILTER (WHERE fetch_status = 'skipped') AS pages_skipped, count(*) FILTER (WHERE fetch_status = 'blocked_by_robots') AS pages_blocked_by_robots, count(*) FILTER (WHERE fetch_status IN ('failed', 'rejected')) AS pages_failed,
 count(*) FILTER (WHERE fetch_status IN ('browser_required', 'browser_fetched')) AS pages_requiring_browser, count(*) FILTER (WHERE fetch_status = 'browser_fetched') AS pages_browser_fetched, sum(n_warnings)::BIGINT AS warnings, sum(bytes)::BIGINT AS bytes_downloaded,
 bool_or(cancelled) AS c, bool_or(page_type = 'homepage' AND fetch_status IN ('failed', 'rejected')) AS h FROM t GROUP BY run_id)
 SELECT * EXCLUDE (c, h), CASE WHEN c THEN 'cancelled' WHEN h THEN 'failed' WHEN pages_failed > 0 AND pages_fetched = 0 AND pages_unchanged = 0 THEN 'failed' WHEN pages_failed > 0 OR warnings > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM g"""
)
def crawl_run_summary(spark, d):
    return runs.crawl_summary(_targets(spark, d))


@query(
    f"""WITH {_TARGETS}, p AS (SELECT *, fetch_status IN ('fetched', 'unchanged', 'browser_fetched') AS ok, part % 11 = 0 AS failed FROM t),
 g AS (SELECT run_id, count(*) AS pages_considered, count(*) FILTER (WHERE ok AND NOT failed) AS pages_processed, count(*) FILTER (WHERE NOT ok) AS pages_skipped, sum(CASE WHEN ok AND NOT failed THEN bytes ELSE 0 END)::BIGINT AS candidates_created,
 sum(CASE WHEN ok AND NOT failed THEN ord ELSE 0 END)::BIGINT AS evidence_created, sum(n_warnings)::BIGINT AS warnings, bool_or(cancelled) AS c, bool_or(ok AND failed) AS f FROM p GROUP BY run_id)
 SELECT * EXCLUDE (c, f), CASE WHEN c THEN 'cancelled' WHEN f OR pages_processed = 0 THEN 'partial' WHEN warnings > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM g"""
)
def extraction_run_summary(spark, d):
    p = _targets(spark, d).withColumns({"n_candidates": F.col("bytes"), "n_evidence": F.col("ord").cast("long"), "failed": F.col("part") % 11 == 0})
    return runs.extraction_summary(p)


_DISCOVERED = """c AS (SELECT user_id AS run_id, (event_id % 40)::VARCHAR AS normalized_url, CASE WHEN event_id % 40 % 7 = 0 THEN 'excluded' ELSE 'priority_2' END AS priority,
 (['sitemap', 'robots', 'html_link', 'sitemap_index'])[event_id % 4 + 1] AS source, (event_type = 'error' AND user_id % 3 = 0)::BIGINT AS n_warnings FROM events)"""


@query(
    f"""WITH {_DISCOVERED}, u AS (SELECT run_id, normalized_url, count(*) AS n, min(priority) AS p, sum(n_warnings) AS w FROM c GROUP BY ALL),
 s AS (SELECT run_id, count(*) FILTER (WHERE source IN ('sitemap', 'sitemap_index')) AS s, count(*) FILTER (WHERE source = 'robots') AS r FROM c GROUP BY 1)
 SELECT u.run_id, sum(n)::BIGINT AS urls_found, count(*) FILTER (WHERE p <> 'excluded') AS urls_accepted, count(*) FILTER (WHERE p = 'excluded') AS urls_excluded, any_value(s.s) AS sitemap_urls_found, any_value(s.r) AS robots_urls_found,
 (sum(n) - count(*))::BIGINT AS duplicate_urls_merged, sum(w)::BIGINT AS warnings, CASE WHEN sum(w) > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM u JOIN s ON u.run_id = s.run_id GROUP BY 1"""
)
def discovery_run_summary(spark, d):
    k = F.col("event_id") % 40
    c = _t(spark, d, "events").select(
        F.col("user_id").alias("run_id"), k.cast("string").alias("normalized_url"), F.when(k % 7 == 0, "excluded").otherwise("priority_2").alias("priority"), _pick(["sitemap", "robots", "html_link", "sitemap_index"], F.col("event_id")).alias("source"),
        ((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0)).cast("long").alias("n_warnings"),
    )
    return runs.discovery_summary(c)


@query(
    """WITH r AS (SELECT o_custkey % 10 AS batch, o_orderkey AS row_number, CASE WHEN o_orderkey % 9 > 0 THEN 'd' || (o_custkey % 200)::VARCHAR END AS domain, o_orderkey % 13 = 0 AS failed FROM orders),
 o AS (SELECT *, CASE WHEN domain IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY batch, domain ORDER BY row_number) > 1 THEN 'duplicate' ELSE 'importable' END AS outcome, coalesce(domain IN (SELECT 'd' || c_custkey::VARCHAR FROM customer WHERE c_custkey % 4 = 0), false) AS known FROM r)
 SELECT batch, count(*) FILTER (WHERE outcome = 'importable' AND NOT known AND NOT failed) AS created, count(*) FILTER (WHERE outcome = 'duplicate' OR (outcome = 'importable' AND known)) AS skipped_existing, count(*) FILTER (WHERE outcome = 'invalid') AS skipped_invalid,
 count(*) FILTER (WHERE outcome = 'importable' AND NOT known AND failed) AS failed FROM o GROUP BY batch"""
)
def import_outcome_counts(spark, d):
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select((F.col("o_custkey") % 10).alias("batch"), k.alias("row_number"), F.when(k % 9 > 0, F.concat(F.lit("d"), F.col("o_custkey") % 200)).alias("domain"), (k % 13 == 0).alias("failed"))
    known = _t(spark, d, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("d"), "c_custkey").alias("domain"))
    return runs.import_counts(views.import_rows(rows), known)


@query(
    """WITH e AS (SELECT event_id, (['allowed', 'disallowed', 'unknown', 'allowed', 'allowed'])[event_id % 5 + 1] AS robots, CASE WHEN event_id % 11 = 0 THEN 'timeout' END AS err, event_id % 13 = 0 AS nm, CASE WHEN event_id % 17 = 0 THEN 503 ELSE 200 + event_id % 3 END AS st,
 CASE WHEN event_id % 19 = 0 THEN 'binary' END AS inv, CASE WHEN event_type = 'error' THEN 'captcha' END AS ch, user_id % 7 = 0 AS un, user_id % 5 = 0 AS br, user_id % 10 = 0 AS re FROM events)
 SELECT event_id, CASE WHEN robots = 'disallowed' THEN 'blocked_by_robots' WHEN err IS NOT NULL THEN 'failed' WHEN nm THEN 'unchanged' WHEN st >= 300 THEN 'failed' WHEN inv IS NOT NULL THEN 'rejected' WHEN ch IS NOT NULL THEN 'rejected' WHEN un THEN 'unchanged' WHEN br AND re THEN 'browser_fetched' WHEN br THEN 'browser_required' ELSE 'fetched' END AS fetch_status,
 coalesce(CASE WHEN robots = 'disallowed' THEN NULL WHEN err IS NOT NULL THEN 'fetch_failed' WHEN nm THEN NULL WHEN st >= 300 THEN 'http_error_status' WHEN inv IS NOT NULL THEN 'validation_rejected' WHEN ch IS NOT NULL THEN 'challenge_page_detected' END, CASE WHEN robots = 'unknown' THEN 'robots_policy_unknown' END) AS warning,
 st IN (408, 425, 429, 500, 502, 503, 504) OR coalesce(err = 'timeout', false) AS again FROM e"""
)
def page_outcomes(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    error, status = F.when(k % 11 == 0, "timeout"), F.when(k % 17 == 0, 503).otherwise(F.lit(200) + k % 3)
    p = {
        "robots": _pick(["allowed", "disallowed", "unknown", "allowed", "allowed"], k), "fetch_error": error, "not_modified": k % 13 == 0, "http_status": status, "invalid": F.when(k % 19 == 0, "binary"),
        "challenge": F.when(F.col("event_type") == "error", "captcha"), "unchanged": u % 7 == 0, "browser_required": u % 5 == 0, "rendered": u % 10 == 0,
    }
    return _t(spark, d, "events").select("event_id", runs.page_outcome(p, browser_policy="fetch_when_required").alias("o"), runs.transient_failure(status, error).alias("again")).select("event_id", "o.*", "again")


@query(
    """WITH r AS (SELECT o_orderkey AS id, o_custkey AS company, o_orderpriority AS a, o_orderkey % 3 AS m, o_orderstatus AS s FROM orders),
 live AS (SELECT company, a, m, min(id) AS blocked_by FROM r WHERE s IN ('O', 'P') GROUP BY ALL) SELECT r.id, live.blocked_by FROM r LEFT JOIN live USING (company, a, m)"""
)
def idempotent_requests(spark, d):
    k = F.col("o_orderkey")
    options = [runs.as_set(F.array(F.lit("about"), F.col("o_orderpriority"))), (k % 3).alias("most")]
    r = _t(spark, d, "orders").select(k.alias("id"), runs.idempotency_key(F.col("o_custkey"), F.lit("x"), options=options).alias("key"), F.col("o_orderstatus").alias("status"))
    # The same options in another order make the same key.
    again = [runs.as_set(F.array(F.col("o_orderpriority"), F.lit("about"), F.lit("about"))), (k % 3).alias("most")]
    old = _t(spark, d, "orders").select(k.alias("run_id"), runs.idempotency_key(F.col("o_custkey"), F.lit("x"), options=again).alias("key"), F.col("o_orderstatus").alias("status"))
    return runs.admit(r.select("id", "key"), old, ["O", "P"]).select("id", "blocked_by")


@query(
    f"""WITH {_TARGETS}, x AS (SELECT run_id, ord, part, CASE WHEN run_id % 50 = 0 THEN 3 END AS stop, fetch_status FROM t), y AS (SELECT run_id, ord, part, CASE WHEN stop IS NOT NULL AND ord >= stop THEN 'skipped' ELSE fetch_status END AS fetch_status, stop IS NOT NULL AS cancelled FROM x)
 SELECT run_id, ord, part, fetch_status, cancelled FROM y WHERE fetch_status IN ('failed', 'rejected', 'blocked_by_robots')"""
)
def retry_after_cancel(spark, d):
    t = _targets(spark, d).drop("cancelled").withColumn("cancelled_at", F.when(F.col("run_id") % 50 == 0, 3))
    return runs.retry_subset(runs.skip_after_cancel(t), with_blocked=True).select("run_id", "ord", "part", "fetch_status", "cancelled")


_RUN_STATUS = ["completed", "completed_with_warnings", "partial", "failed", "cancelled"]


@query(
    f"""WITH r AS (SELECT o_orderkey, {_pick_sql(_RUN_STATUS, "o_orderkey")} AS s, (['crawling', 'crawled', 'imported'])[o_custkey % 3 + 1] AS cur FROM orders), w AS (SELECT *, CASE WHEN s IN ('completed', 'completed_with_warnings', 'partial') THEN 'crawled' ELSE 'failed' END AS wanted FROM r)
 SELECT o_orderkey, CASE WHEN cur IN ('crawling') OR (cur = 'crawled' AND wanted = 'failed') THEN wanted ELSE cur END AS processing, CASE WHEN s = 'cancelled' THEN 'failed' ELSE s END AS status, CASE WHEN s = 'cancelled' THEN 'cancelled' END AS error,
 CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 30 ELSE 30 END AS max_pages, 'detect_only' AS browser_policy FROM w"""
)
def stage_end_states(spark, d):
    from siltstone.functions import rules

    status = _pick(_RUN_STATUS, F.col("o_orderkey"))
    state = runs.advance(_pick(["crawling", "crawled", "imported"], F.col("o_custkey")), runs.stage_end(status, "crawled"), rules.PROCESSING)
    options = runs.overlay({"max_pages": 30, "browser_policy": "detect_only"}, {"max_pages": F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 30)})
    return _t(spark, d, "orders").select("o_orderkey", state.alias("processing"), runs.finalised(status, F.lit(None).cast("string")).alias("f"), options.alias("o")).select("o_orderkey", "processing", "f.*", "o.*")


_URLS = """u AS (SELECT event_id, user_id AS run_id, (['high', 'excluded', 'low'])[event_id % 3 + 1] AS priority, event_type AS page_type, [event_type, 'sitemap' || (event_id % 4)::VARCHAR] AS sources FROM events)"""


def _urls(spark, d) -> DataFrame:
    k = F.col("event_id")
    return _t(spark, d, "events").select(k, F.col("user_id").alias("run_id"), _pick(["high", "excluded", "low"], k).alias("priority"), F.col("event_type").alias("page_type"), F.array("event_type", F.concat(F.lit("sitemap"), k % 4)).alias("sources"))


@query(f"WITH {_URLS}, v AS (SELECT * FROM u WHERE priority <> 'excluded' AND page_type <> 'view' AND list_contains(sources, 'sitemap1')) SELECT event_id, priority, (SELECT count(*) FROM v) AS total FROM v")
def discovered_url_filter(spark, d):
    found = filters.discovered_urls(_urls(spark, d).where("page_type <> 'view'"), source="sitemap1")
    return filters.with_total(found.select("event_id", "priority"), found)


@query(f"WITH {_TARGETS} SELECT run_id, ord, part, fetch_status FROM t WHERE fetch_status <> 'failed' AND page_type = 'product' AND (fetch_status LIKE 'browser%')")
def crawled_page_filter(spark, d):
    t = _targets(spark, d).withColumn("fallback_reason", F.when(F.col("fetch_status").startswith("browser"), "empty_html"))
    return filters.pages(t, page_type="product", browser_required=True).select("run_id", "ord", "part", "fetch_status")


@query("WITH f AS (SELECT o_orderkey, (['accepted', 'stale', 'superseded', 'conflicting'])[o_orderkey % 4 + 1] AS status, o_orderkey % 101 AS confidence FROM orders) SELECT * FROM f WHERE status NOT IN ('stale', 'superseded') AND confidence >= 60")
def fact_filter(spark, d):
    k = F.col("o_orderkey")
    f = _t(spark, d, "orders").select(k, _pick(["accepted", "stale", "superseded", "conflicting"], k).alias("status"), (k % 101).alias("confidence"))
    return filters.facts(f, least_confidence=60)


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey) AS place FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), '7 furn')")
def company_search(spark, d):
    c = filters.search(_t(spark, d, "customer"), " 7 FURN ", "c_name", "c_mktsegment").select(F.col("c_custkey"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("score"))
    return views.numbered(c, filters.by_score(c, tie="c_custkey")).select("c_custkey", "place")


@query("SELECT o_orderkey AS run_id, queued_at, row_number() OVER (ORDER BY queued_at DESC NULLS LAST, o_orderkey) AS place FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS queued_at FROM orders)")
def jobs_by_queue_time(spark, d):
    """All jobs in the order of their list, with their places."""
    jobs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate")).alias("queued_at"))
    return views.numbered(jobs, views.by_queue_time(jobs))


@query(
    """SELECT event_id, regexp_full_match(props, '[A-Za-z0-9_-]+') AS safe, CASE WHEN regexp_full_match(event_type || event_id::VARCHAR, '[0-9]{1,9}') THEN 0 WHEN event_id % 3 = 0 THEN event_id END AS wait, true AS is_object, event_id % 2 = 0 AS is_kind FROM events"""
)
def value_predicates(spark, d):
    k = F.col("event_id")
    kind = F.when(k % 2 == 0, "number").otherwise("boolean")
    return _t(spark, d, "events").select(k, filters.safe_identifier(F.col("props")).alias("safe"), filters.seconds(F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise(F.concat("event_type", k))).alias("wait"), filters.has_type(F.col("props"), F.lit("object")).alias("is_object"), filters.has_type(F.col("value").cast("string"), kind).alias("is_kind"))


@query(
    """WITH p AS (SELECT event_id AS page_id, CASE WHEN event_id % 3 = 0 THEN props END AS inline, CASE WHEN event_id % 5 = 0 THEN event_type END AS stored, CASE WHEN event_id % 2 = 0 THEN event_id - 1 END AS unchanged_from FROM events)
 SELECT p.page_id, coalesce(p.inline, p.stored, q.inline, q.stored) AS content, CASE WHEN octet_length(coalesce(p.inline, p.stored, q.inline, q.stored)::BLOB) <= 7 THEN 'inline' ELSE 'external' END AS mode FROM p LEFT JOIN p q ON q.page_id = p.unchanged_from WHERE coalesce(p.inline, p.stored, q.inline, q.stored) IS NOT NULL"""
)
def page_contents(spark, d):
    k = F.col("event_id")
    p = _t(spark, d, "events").select(k.alias("page_id"), F.when(k % 3 == 0, F.col("props")).alias("inline"), F.when(k % 5 == 0, F.col("event_type")).alias("stored"), F.when(k % 2 == 0, k - 1).alias("unchanged_from"))
    return runs.content(p).select("page_id", "content", runs.storage_mode(F.col("content"), 7).alias("mode"))


_ITEMS = """c AS (SELECT l_suppkey AS company, 'organisation.people' AS field, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, l_partkey, ' ' || (l_partkey % 37)::VARCHAR || CASE WHEN l_orderkey % 2 = 0 THEN 'Ab' ELSE 'aB' END AS value, (55 + l_partkey % 45)::BIGINT AS confidence,
 CASE WHEN l_partkey % 3 = 0 THEN 'K' || (l_partkey % 5)::VARCHAR END AS dedup_key, l_quantity::BIGINT % 4 AS sort_key FROM lineitem)"""


def _items(spark, d) -> DataFrame:
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    return _t(spark, d, "lineitem").groupBy(((k * 10 + F.col("l_linenumber")) * 1000000 + p).alias("id"), F.col("l_suppkey").alias("company"), p.alias("part"), k.alias("k"), (F.col("l_quantity").cast("long") % 4).alias("q")).agg(F.count("*").alias("copies")).select(
        "company", F.lit("organisation.people").alias("field"), "id", F.concat(F.lit(" "), F.col("part") % 37, F.when(F.col("k") % 2 == 0, "Ab").otherwise("aB")).alias("value"), (F.lit(55) + F.col("part") % 45).alias("confidence"),
        F.when(F.col("part") % 3 == 0, F.concat(F.lit("K"), F.col("part") % 5)).alias("dedup_key"), F.col("q").alias("sort_key"), F.array(F.col("id").cast("string")).alias("evidence"),
    )


@query(
    f"""WITH {_ITEMS}, u AS (SELECT DISTINCT * EXCLUDE (l_partkey), l_partkey FROM c), k AS (SELECT *, lower(trim(coalesce(dedup_key, value))) AS key FROM u WHERE confidence >= 70),
 m AS (SELECT company, field, key, arg_max(value, confidence * 10000000000000000 - id) AS value, max(confidence) AS confidence, count(*) AS n, min(coalesce(sort_key, 0)) AS sort_key, min(id) AS f, string_agg(id::VARCHAR, '+' ORDER BY id) AS ev FROM k GROUP BY ALL)
 SELECT company, field, max(confidence) AS confidence, sum(n)::BIGINT AS n_sources, string_agg(value || '/' || confidence::VARCHAR || '/' || n::VARCHAR || '/' || ev, ';' ORDER BY sort_key, f) AS said FROM m GROUP BY 1, 2"""
)
def array_facts(spark, d):
    f = facts.arrays(_items(spark, d))
    said = F.array_join(F.transform("items", lambda x: F.concat_ws("/", x["value"], x["confidence"].cast("string"), x["source_count"].cast("string"), F.array_join(x["evidence"], "+"))), ";")
    return f.select("company", "field", "confidence", "n_sources", said.alias("said"))


_STRATEGIES = ["boolean_explicit", "boolean_positive_only", "set_union", "scalar_preferred", "numeric_exact_or_estimate"]


def _mixed(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    field = F.concat(F.lit("f"), (k % 5).cast("string"))
    value = F.when(k % 5 < 2, F.when(k % 3 == 0, "false").otherwise("true")).when(k % 5 == 4, (k % 11).cast("string")).otherwise(F.col("o_orderpriority"))
    return _t(spark, d, "orders").select(
        F.col("o_custkey").alias("company"), field.alias("field"), k.alias("id"), value.alias("value"), F.lit("html_element").alias("source"), (F.lit(55) + k % 45).alias("confidence"), (k % 2 == 0).alias("exact"),
        F.lit(None).cast("string").alias("dedup_key"), F.lit(0).cast("long").alias("sort_key"), F.array(k.cast("string")).alias("evidence"),
    )


def _catalogue(spark) -> DataFrame:
    return spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(_STRATEGIES)], "field string, strategy string")


_MIXED_SQL = """c AS (SELECT o_custkey AS company, o_orderkey % 5 AS f, o_orderkey AS id, CASE WHEN o_orderkey % 5 < 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END WHEN o_orderkey % 5 = 4 THEN (o_orderkey % 11)::VARCHAR ELSE o_orderpriority END AS v,
 (55 + o_orderkey % 45)::BIGINT AS cf, o_orderkey % 2 = 0 AS ex FROM orders), ok AS (SELECT * FROM c WHERE cf >= 70),
 b AS (SELECT company, f, count(*) FILTER (WHERE cf >= 70 AND v = 'true') AS t, count(*) FILTER (WHERE cf >= 70 AND v = 'false') AS n FROM c WHERE f = 0 OR (f = 1 AND v = 'true') GROUP BY ALL),
 s AS (SELECT company, f, count(DISTINCT lower(trim(v))) FILTER (WHERE cf >= 70) AS k FROM c WHERE f = 3 GROUP BY ALL), a AS (SELECT company, f FROM ok WHERE f = 2 GROUP BY ALL),
 m AS (SELECT company, f, count(DISTINCT v) FILTER (WHERE ex) AS e FROM ok WHERE f = 4 GROUP BY ALL)"""
_MIXED_STATUS = """SELECT company, 'f' || f::VARCHAR AS field, CASE WHEN t > 0 AND n > 0 THEN 'conflicting' WHEN t + n > 0 THEN 'accepted' ELSE 'unknown' END AS status FROM b
 UNION ALL SELECT company, 'f' || f::VARCHAR, CASE k WHEN 0 THEN 'unknown' WHEN 1 THEN 'accepted' ELSE 'conflicting' END FROM s UNION ALL SELECT company, 'f' || f::VARCHAR, 'accepted' FROM a
 UNION ALL SELECT company, 'f' || f::VARCHAR, CASE WHEN e > 1 THEN 'conflicting' ELSE 'accepted' END FROM m"""


@query(f"WITH {_MIXED_SQL} {_MIXED_STATUS}")
def facts_by_strategy(spark, d):
    return facts.by_strategy(_mixed(spark, d), _catalogue(spark)).select("company", "field", "status")


_OLD_SQL = """SELECT o_custkey AS company, 'identity.platform' AS field, max_by(o_orderpriority, o_orderkey) AS value, CASE WHEN o_custkey % 3 = 0 THEN 'conflicting' ELSE 'accepted' END AS status, CASE WHEN o_custkey % 3 = 0 THEN 'conflicting' ELSE 'verified' END AS state FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey"""
_NEW_SQL = """SELECT o_custkey AS company, 'identity.platform' AS field, CASE WHEN o_custkey % 5 > 0 THEN upper(max_by(o_orderpriority, o_orderkey)) END AS value, (['conflicting', 'accepted', 'accepted', 'unknown', 'accepted'])[o_custkey % 5 + 1] AS status FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY o_custkey"""


@query(
    f"""WITH o AS ({_OLD_SQL}), n AS ({_NEW_SQL}), j AS (SELECT n.*, o.company IS NOT NULL AND CASE WHEN n.status = 'conflicting' THEN o.status <> 'conflicting' ELSE n.status = 'accepted' AND lower(trim(n.value)) IS DISTINCT FROM lower(trim(o.value)) END AS sup FROM n LEFT JOIN o USING (company, field))
 SELECT company, field, value, status, status AS state FROM n WHERE status <> 'unknown'
 UNION ALL SELECT o.company, o.field, o.value, CASE WHEN j.sup THEN 'stale' ELSE o.status END, CASE WHEN j.sup THEN 'stale' ELSE o.state END FROM o LEFT JOIN (SELECT * FROM j WHERE status <> 'unknown') j USING (company, field) WHERE j.company IS NULL OR j.sup"""
)
def superseded_facts(spark, d):
    o = _t(spark, d, "orders")
    third = F.col("company") % 3 == 0
    old = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("company")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("value"))
    old = old.select("company", F.lit("identity.platform").alias("field"), "value", F.when(third, "conflicting").otherwise("accepted").alias("status"), F.when(third, "conflicting").otherwise("verified").alias("state"))
    new = o.where("o_orderkey % 4 <> 3").groupBy(F.col("o_custkey").alias("company")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("v"))
    status = _pick(["conflicting", "accepted", "accepted", "unknown", "accepted"], F.col("company"))
    new = new.select("company", F.lit("identity.platform").alias("field"), F.when(F.col("company") % 5 > 0, F.upper("v")).alias("value"), status.alias("status"), status.alias("state"))
    catalogue = spark.createDataFrame([("identity.platform", "scalar_preferred")], "field string, strategy string")
    return facts.current_facts(facts.against_existing(new, old, catalogue), old)


@query(
    """WITH c AS (SELECT user_id AS company, event_type AS field, event_id AS id, ts, (['a', 'b'])[event_id % 2 + 1] AS extractor, (event_id % 3)::VARCHAR AS version, event_id % 4 > 0 AS selected, CASE WHEN event_id % 5 = 0 THEN 'm' || (event_id % 7)::VARCHAR END AS method FROM events),
 v AS (SELECT company, field, extractor, arg_max(version, id) AS version FROM c GROUP BY ALL), w AS (SELECT company, field, string_agg(extractor || '=' || version, ',' ORDER BY extractor) AS versions FROM v GROUP BY ALL)
 SELECT c.company, c.field, min(ts) AS first_observed_at, max(ts) AS last_observed_at, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (WHERE selected), '') AS evidence, arg_max(method, id) FILTER (WHERE selected AND method IS NOT NULL) AS estimation_method, any_value(w.versions) AS versions
 FROM c JOIN w ON c.company = w.company AND c.field = w.field GROUP BY 1, 2"""
)
def fact_assembly(spark, d):
    k = F.col("event_id")
    c = _t(spark, d, "events").select(
        F.col("user_id").alias("company"), F.col("event_type").alias("field"), k.alias("id"), F.col("ts").alias("observed_at"), _pick(["a", "b"], k).alias("extractor"), (k % 3).cast("string").alias("version"), F.array(k.cast("string")).alias("evidence"),
        (k % 4 > 0).alias("selected"), F.when(k % 5 == 0, F.concat(F.lit("m"), k % 7)).alias("estimation_method"), F.lit(None).cast("long").alias("sample_size"), F.lit(None).cast("boolean").alias("exact"),
    )
    f = facts.assembled(c)
    said = F.array_join(F.transform(F.map_entries("versions"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return f.select("company", "field", "first_observed_at", "last_observed_at", F.array_join("evidence", ",").alias("evidence"), "estimation_method", said.alias("versions"))


@query(
    """WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'organisation.emails' ELSE 'business.brands' END AS field, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL),
 s AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN plain ELSE regexp_replace(plain, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}', '[redacted-email]', 'g') END AS shown FROM d WHERE plain <> '')
 SELECT doc_id, sha256(doc_id::VARCHAR || '|' || field || '|' || coalesce(CASE WHEN doc_id % 3 = 0 THEN 'p[1]' END, '') || '|' || sha256(text)) AS evidence_id, substring(shown, 1, 300) AS excerpt, length(shown) > 300 AS truncated FROM s"""
)
def evidence_records(spark, d):
    k = F.col("doc_id")
    drafts = _t(spark, d, "documents").select(k.alias("page_id"), F.when(k % 2 == 0, "organisation.emails").otherwise("business.brands").alias("field"), F.when(k % 3 == 0, "p[1]").alias("locator"), F.col("text").alias("fragment"))
    return facts.with_evidence(drafts).select(F.col("page_id").alias("doc_id"), "evidence_id", "excerpt", "truncated")


@query(
    "WITH d AS (SELECT user_id AS origin, (['*', 'SiltBot', 'other'])[event_id % 3 + 1] AS agent, event_id % 9 AS delay FROM events WHERE user_id % 4 > 0 OR event_id % 3 <> 1) SELECT origin, coalesce(max(delay) FILTER (WHERE lower(agent) = 'siltbot'), max(delay) FILTER (WHERE agent = '*')) AS delay FROM d GROUP BY 1"
)
def matched_crawl_delay(spark, d):
    k = F.col("event_id")
    e = _t(spark, d, "events").where("user_id % 4 > 0 or event_id % 3 <> 1")
    return filters.matched_delay(e.select(F.col("user_id").alias("origin"), _pick(["*", "SiltBot", "other"], k).alias("agent"), (k % 9).alias("delay")), "siltbot")


@query(
    "SELECT 'discovery' AS kind, event_id AS run_id, user_id AS company, CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM events UNION ALL SELECT 'crawl', o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END FROM orders"
    " UNION ALL SELECT 'extraction', l_orderkey * 10 + l_linenumber, l_suppkey, CASE l_returnflag WHEN 'N' THEN 'completed' ELSE 'failed' END FROM lineitem"
)
def jobs_of_all_kinds(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("company"), F.col("event_type").alias("status"), F.col("ts").alias("queued_at"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("company"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("queued_at"))
    x = _t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), F.col("l_suppkey").alias("company"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").alias("queued_at"))
    table = {"error": "failed", "signup": "completed", "view": "completed", "click": "completed", "purchase": "completed", "F": "completed", "O": "queued", "P": "running", "N": "completed", "A": "failed", "R": "failed"}
    return runs.jobs({"discovery": e, "crawl": o, "extraction": x}, table).select("kind", "run_id", "company", "status")


_PLACES = ["/stores", "/contact", "/returns", "/collections/x", "/about"]
_SHOPS = """p AS (SELECT page_id, page_id % 5 AS k, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS company FROM pages),
 s AS (SELECT *, 'Shop ' || page_id || CASE WHEN page_id % 7 = 0 THEN ' Warehouse' WHEN page_id % 7 = 1 THEN ' Showroom' ELSE '' END AS name, CASE WHEN page_id % 7 = 0 THEN 'warehouse' WHEN page_id % 7 = 1 THEN 'showroom' ELSE 'retail_store' END AS kind FROM p),
 r AS (SELECT company, 'operations.locations' AS field, '{"location_type":"' || kind || '","ownership":"owned","name":"' || name || '","address_line":"' || page_id || ' High St","city":"Perth","postal_code":"6000","country":"AU","phone":"' || page_id || '"}' AS value, 82 AS confidence, page_id, page_id || ' high st perth 6000 au' AS dedup_key, NULL AS exact, NULL AS method FROM s
  UNION ALL SELECT company, 'operations.' || kind || '_count', '1', 78, page_id, NULL, true, 'exact' FROM s WHERE k < 2
  UNION ALL SELECT company, 'operations.returns_location_count', '1', 70, page_id, NULL, true, 'exact' FROM s WHERE k = 2
  UNION ALL SELECT company, 'catalogue.product_count', (page_id % 90)::VARCHAR, 82, page_id, NULL, true, 'exact' FROM s WHERE k = 3 AND page_id % 2 = 0
  UNION ALL SELECT company, 'catalogue.product_count_estimate', CASE WHEN page_id % 3 = 0 THEN '24' ELSE '2' END, CASE WHEN page_id % 3 = 0 THEN 60 ELSE 40 END, page_id, NULL, false, CASE WHEN page_id % 3 = 0 THEN 'pagination_derived' ELSE 'sampled_collection' END FROM s WHERE k = 3 AND page_id % 2 = 1
  UNION ALL SELECT company, 'catalogue.collection_count', '1', 50, page_id, NULL, false, 'counted_navigation_links' FROM s)"""


@query(f"WITH {_SHOPS} SELECT company, field, value, confidence, page_id, dedup_key, exact, method FROM r")
def shop_candidates(spark, d):
    """Places, their counts and catalogue marks of all pages, with a shop, a list of goods and links put before each."""
    from siltstone.operators import discovery, shops
    from siltstone.functions import urls
    from siltstone.sources.html_pages import parse_pages
    from siltstone.storage import materialize

    k, p = F.col("page_id"), F.col("page_id").cast("string")
    kind = F.when(k % 7 == 0, " Warehouse").when(k % 7 == 1, " Showroom").otherwise("")
    shop = F.concat(F.lit('<script type="application/ld+json">[{"@type": "Store", "name": "Shop '), p, kind, F.lit('", "telephone": "'), p, F.lit('", "address": {"streetAddress": "'), p, F.lit(' High St", "addressLocality": "Perth", "postalCode": "6000", "addressCountry": "AU"}}'))
    goods = F.when(k % 2 == 0, F.concat(F.lit(', {"@type": "ItemList", "numberOfItems": '), (k % 90).cast("string"), F.lit("}"))).otherwise("")
    links = F.lit(']</script><a href="/collections/all">all</a><a href="/products/a">a</a><a href="/product/b">b</a><a href="/products/a">again</a>')
    page = F.concat(F.lit("<p>page 1 of "), F.when(k % 3 == 0, "12").otherwise("none"), F.lit("</p>"))
    pages = _t(spark, d, "pages").select(
        "page_id", urls.hostname(F.col("url")).alias("host"), discovery.classify(_pick(_PLACES, k))["page_type"].alias("page_type"), F.concat(shop, goods, links, page, "html").alias("html")
    )
    parsed = materialize(parse_pages(pages), "parsed")
    return shops.operations(parsed).unionByName(shops.catalogue(parsed)).select("company", "field", "value", "confidence", "page_id", "dedup_key", "exact", "method")


@query(
    """WITH c AS (SELECT l_orderkey AS company, 'catalogue.product_count' AS field, l_orderkey * 10 + l_linenumber AS id, l_partkey % 6 AS v, l_linenumber % 2 = 0 AS ex, (60 + l_suppkey % 40)::BIGINT AS cf FROM lineitem), n AS (SELECT company, field, count(DISTINCT v) FILTER (WHERE ex AND cf >= 70) AS e, count(*) FILTER (WHERE cf >= 70) AS k FROM c GROUP BY ALL)
 SELECT company, field, CASE WHEN e > 1 THEN 'conflicting' ELSE 'accepted' END AS status FROM n WHERE k > 0"""
)
def count_facts(spark, d):
    c = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("company"), F.lit("catalogue.product_count").alias("field"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 6).cast("string").alias("value"), (F.col("l_linenumber") % 2 == 0).alias("exact"), (F.lit(60) + F.col("l_suppkey") % 40).alias("confidence"))
    return reconcile.numeric(c).select("company", "field", "status")


@query(
    """WITH u AS (SELECT event_id, user_id AS run, CASE WHEN event_id % 4 = 0 THEN [] ELSE [event_type, 'nav'] END AS s, CASE WHEN event_id % 3 = 0 THEN [] ELSE ['a', props] END AS a FROM events),
 x AS (SELECT event_id, run, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS source, generate_subscripts(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END, 1)::INT - 1 AS nth_source, a FROM u)
 SELECT event_id, run, source, unnest(CASE WHEN len(a) = 0 THEN [NULL] ELSE a END) AS anchor, nth_source, generate_subscripts(CASE WHEN len(a) = 0 THEN [NULL] ELSE a END, 1)::INT - 1 AS nth_anchor FROM x"""
)
def candidate_fan_out(spark, d):
    from siltstone.operators import discovery

    k, none = F.col("event_id"), F.array().cast("array<string>")
    u = _t(spark, d, "events").select(k, F.col("user_id").alias("run"), F.when(k % 4 == 0, none).otherwise(F.array("event_type", F.lit("nav"))).alias("sources"), F.when(k % 3 == 0, none).otherwise(F.array(F.lit("a"), "props")).alias("anchors"))
    return discovery.fan_out(u)


@query(
    "WITH c AS (SELECT 0 AS phase, event_id AS ord, user_id AS run, event_type AS source FROM events UNION ALL SELECT 1, o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL SELECT 2, c_custkey, c_custkey % 50, 'sitemap' FROM customer)"
    " SELECT run, source, phase, ord FROM c QUALIFY row_number() OVER (PARTITION BY run ORDER BY phase, ord) <= 3"
)
def candidate_streams(spark, d):
    from siltstone.operators import discovery

    e = _t(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("run"), F.col("event_type").alias("source"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("source"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 50).alias("run"), F.lit("sitemap").alias("source"))
    both = discovery.in_phases(e, o, c).withColumnRenamed("ord", "own").withColumn("ord", F.struct("phase", "own"))
    return discovery.first_candidates(both, 3).select("run", "source", "phase", F.col("own").alias("ord"))


@query(
    """WITH u AS (SELECT event_type || (event_id % 50)::VARCHAR AS url, event_id, user_id FROM events), f AS (SELECT url, arg_min(user_id, event_id) AS user_id FROM u GROUP BY 1), p AS (SELECT o_custkey AS company, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1)
 SELECT c_custkey, f.user_id, p.o_orderstatus FROM customer LEFT JOIN f ON f.url = 'view' || (c_custkey % 70)::VARCHAR LEFT JOIN p ON p.company = c_custkey"""
)
def target_lookups(spark, d):
    from siltstone.operators import crawl, discovery

    targets = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("view"), F.col("c_custkey") % 70).alias("url"), F.col("c_custkey").alias("company"))
    urls = _t(spark, d, "events").select(F.concat("event_type", F.col("event_id") % 50).alias("url"), F.col("event_id").alias("ord"), "user_id")
    pages = _t(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("fetched_at"), "o_orderstatus")
    found = discovery.with_discovered(targets, urls, ["user_id"])
    return crawl.latest_before(found, pages, ["o_orderstatus"], keys=["company"]).select("c_custkey", "user_id", "o_orderstatus")
