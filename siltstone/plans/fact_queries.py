"""Queries on candidates, facts, jobs, states and robots, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import rules, text
from siltstone.operators import crawl, discovery, reconcile, views
from siltstone.plans.queries import _list, _t, query

_SOURCES = ["json_ld", "open_graph", "html_element", "deterministic_inference", "manual"]
_SRC = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SOURCES[:4]))
_SRC_PRIO = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.SOURCE_PRIORITY.items()) + " ELSE 0 END"
_SCALARS = f"""c AS (SELECT o_custkey AS company, 'identity.platform' AS field, o_orderkey AS id, o_orderpriority AS value,
  CASE WHEN o_orderkey % 97 = 0 THEN 'manual' ELSE CASE o_orderkey % 4 {_SRC} END END AS source, (50 + o_orderkey % 50)::BIGINT AS confidence FROM orders)"""


def _scalars(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    source = F.when(k % 97 == 0, "manual").otherwise(F.element_at(F.array(*[F.lit(s) for s in _SOURCES[:4]]), (k % 4 + 1).cast("int")))
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.lit("identity.platform").alias("field"), k.alias("id"), F.col("o_orderpriority").alias("value"), source.alias("source"), (F.lit(50) + k % 50).alias("confidence"))


_SCALAR_SQL = f"""WITH {_SCALARS}, r AS (SELECT *, {_SRC_PRIO} AS prio, lower(trim(value)) AS key FROM c),
 m AS (SELECT company, field, arg_max(value, confidence * 1000000000000 - id) AS v, max(confidence) AS cf FROM r WHERE source = 'manual' GROUP BY 1, 2),
 v AS (SELECT company, field, key, max(prio) AS prio, max(confidence) AS conf, count(*) AS n, min(id) AS f, arg_max(value, confidence * 1000000000000 - id) AS value, arg_max(source, confidence * 1000000000000 - id) AS source FROM r WHERE source <> 'manual' AND confidence >= 70 GROUP BY 1, 2, 3),
 k AS (SELECT *, row_number() OVER w AS rank, lead(prio) OVER w AS nxt, sum(n) OVER (PARTITION BY company, field) AS all_n, max(conf) OVER (PARTITION BY company, field) AS top FROM v WINDOW w AS (PARTITION BY company, field ORDER BY prio DESC, conf DESC, f)),
 a AS (SELECT *, nxt IS NULL AS one, coalesce(prio - nxt >= 20, false) AS wins FROM k WHERE rank = 1),
 g AS (SELECT DISTINCT company, field FROM r)
 SELECT g.company, g.field, CASE WHEN m.cf IS NOT NULL THEN m.v WHEN one OR wins THEN a.value END AS value,
  CASE WHEN m.cf IS NOT NULL THEN m.cf WHEN one OR wins THEN conf ELSE top END AS confidence,
  CASE WHEN m.cf IS NOT NULL OR one OR wins THEN 'accepted' WHEN a.key IS NOT NULL THEN 'conflicting' ELSE 'unknown' END AS status,
  CASE WHEN m.cf IS NOT NULL THEN 'verified' WHEN a.key IS NULL THEN 'unknown' WHEN one THEN CASE WHEN n > 1 THEN 'verified' WHEN source = 'deterministic_inference' THEN 'inferred' ELSE 'measured' END WHEN wins THEN 'verified' ELSE 'conflicting' END AS state,
  CASE WHEN m.cf IS NOT NULL THEN 'reconciliation.manual_overrides_automated' WHEN a.key IS NULL THEN 'reconciliation.below_threshold_remains_unknown' WHEN one THEN 'reconciliation.highest_confidence_scalar_selected' WHEN wins THEN 'reconciliation.json_ld_overrides_title_inference' ELSE 'reconciliation.conflicting_strong_sources_preserved' END AS rule,
  (CASE WHEN m.cf IS NOT NULL THEN 1 WHEN a.key IS NULL THEN 0 WHEN one OR wins THEN n ELSE all_n END)::BIGINT AS n_sources
 FROM g LEFT JOIN m ON g.company = m.company AND g.field = m.field LEFT JOIN a ON g.company = a.company AND g.field = a.field"""


@query(_SCALAR_SQL)
def scalar_reconcile(spark, d):
    return reconcile.scalar(_scalars(spark, d))


@query(
    """WITH c AS (SELECT l_orderkey AS company, l_shipmode AS field, l_returnflag AS rf, (60 + l_linenumber * 5)::BIGINT AS confidence FROM (SELECT l_orderkey, 'business.' || l_linestatus AS l_shipmode, l_returnflag, l_linenumber FROM lineitem)),
 k AS (SELECT company, field, count(*) FILTER (WHERE confidence >= 70 AND rf = 'R') AS t, count(*) FILTER (WHERE confidence >= 70 AND rf = 'A') AS f, max(confidence) FILTER (WHERE confidence >= 70 AND rf = 'R') AS tc, max(confidence) FILTER (WHERE confidence >= 70 AND rf = 'A') AS fc FROM c GROUP BY 1, 2)
 SELECT company, field, CASE WHEN t > 0 AND f > 0 THEN NULL WHEN t > 0 THEN 'true' WHEN f > 0 THEN 'false' END AS value, CASE WHEN t > 0 AND f > 0 THEN greatest(tc, fc) WHEN t > 0 THEN tc ELSE fc END AS confidence,
 CASE WHEN t > 0 AND f > 0 THEN 'conflicting' WHEN t + f > 0 THEN 'accepted' ELSE 'unknown' END AS status, CASE WHEN t > 0 AND f > 0 THEN 'conflicting' WHEN t + f > 0 THEN 'verified' ELSE 'unknown' END AS state,
 CASE WHEN t > 0 AND f > 0 THEN 'reconciliation.conflicting_strong_sources_preserved' WHEN t > 0 THEN 'reconciliation.boolean_true_or_unknown_only' WHEN f > 0 THEN 'reconciliation.boolean_false_requires_explicit_evidence' ELSE 'reconciliation.below_threshold_remains_unknown' END AS rule, (CASE WHEN t > 0 AND f > 0 THEN t + f WHEN t > 0 THEN t ELSE f END)::BIGINT AS n_sources FROM k"""
)
def boolean_reconcile(spark, d):
    c = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("company"),
        F.concat(F.lit("business."), "l_linestatus").alias("field"),
        F.when(F.col("l_returnflag") == "R", "true").when(F.col("l_returnflag") == "A", "false").otherwise("other").alias("value"),
        (F.lit(60) + F.col("l_linenumber") * 5).cast("long").alias("confidence"),
    )
    return reconcile.boolean(c)


@query(
    """WITH c AS (SELECT l_partkey AS company, 'catalogue.size' AS field, (l_orderkey * 10 + l_linenumber) * 100000000 + l_suppkey AS id, (l_quantity::BIGINT)::VARCHAR AS value, l_returnflag = 'N' AND l_linenumber > 5 AS exact, (60 + l_linenumber * 5)::BIGINT AS confidence FROM lineitem),
 g AS (SELECT company, field, count(*) FILTER (WHERE exact) AS e, count(DISTINCT value) FILTER (WHERE exact) AS ev, max(confidence) FILTER (WHERE exact) AS ec, arg_max(value, confidence::HUGEINT * 100000000000000000000 - id) FILTER (WHERE exact) AS evalue, arg_max(value, confidence::HUGEINT * 100000000000000000000 - id) FILTER (WHERE NOT exact) AS est, max(confidence) FILTER (WHERE NOT exact) AS estc FROM c WHERE confidence >= 70 GROUP BY 1, 2)
 SELECT company, field, CASE WHEN ev = 1 THEN evalue WHEN ev > 1 THEN NULL ELSE est END AS value, CASE WHEN ev > 0 THEN ec ELSE estc END AS confidence, CASE WHEN ev > 1 THEN 'conflicting' ELSE 'accepted' END AS status, CASE WHEN ev = 1 THEN 'measured' WHEN ev > 1 THEN 'conflicting' ELSE 'inferred' END AS state,
 CASE WHEN ev = 1 THEN 'reconciliation.exact_value_beats_estimate' WHEN ev > 1 THEN 'reconciliation.competing_exact_counts_conflict' ELSE 'reconciliation.highest_confidence_scalar_selected' END AS rule, (CASE WHEN ev > 0 THEN e ELSE 1 END)::BIGINT AS n_sources FROM g"""
)
def numeric_reconcile(spark, d):
    c = _t(spark, d, "lineitem").select(
        F.col("l_partkey").alias("company"),
        F.lit("catalogue.size").alias("field"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_suppkey")).alias("id"),
        F.col("l_quantity").cast("long").cast("string").alias("value"),
        ((F.col("l_returnflag") == "N") & (F.col("l_linenumber") > 5)).alias("exact"),
        (F.lit(60) + F.col("l_linenumber") * 5).cast("long").alias("confidence"),
    )
    return reconcile.numeric(c)


@query(
    """WITH i AS (SELECT l_suppkey AS company, lower(l_returnflag) AS key, arg_max(l_returnflag, l_linenumber::HUGEINT * 100000000000000000000 - ((l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey)) AS value, max(60 + l_linenumber * 5)::BIGINT AS confidence, count(*) AS n, min((l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey) AS f FROM lineitem WHERE 60 + l_linenumber * 5 >= 70 GROUP BY 1, 2)
 SELECT company, 'catalogue.flags' AS field, string_agg(value, ',' ORDER BY f, value) AS items, max(confidence) AS confidence, sum(n)::BIGINT AS n_sources FROM i GROUP BY 1"""
)
def set_union_reconcile(spark, d):
    c = _t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("company"), F.lit("catalogue.flags").alias("field"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey")).alias("id"), F.col("l_returnflag").alias("value"), (F.lit(60) + F.col("l_linenumber") * 5).cast("long").alias("confidence")
    )
    out = reconcile.union(c)
    return out.select("company", "field", F.array_join(F.transform("items", lambda s: s["value"]), ",").alias("items"), "confidence", "n_sources")


@query(
    f"WITH f AS ({_SCALAR_SQL}), s AS (SELECT company, field, confidence, CASE WHEN company % 9 = 0 THEN 'stale' ELSE state END AS state FROM f WHERE status <> 'unknown') SELECT company, count(*) FILTER (WHERE state NOT IN ('stale', 'conflicting')) AS facts_accepted, count(*) FILTER (WHERE state = 'conflicting') AS facts_conflicting, count(*) FILTER (WHERE state = 'stale') AS facts_stale, floor(coalesce(avg(confidence) FILTER (WHERE state NOT IN ('stale', 'conflicting')), 0))::BIGINT AS average_confidence, count(DISTINCT field) AS fields_covered, 52 AS fields_total FROM s GROUP BY 1"
)
def projection_quality(spark, d):
    f = reconcile.scalar(_scalars(spark, d)).where("status <> 'unknown'")
    return reconcile.projection(f.withColumn("state", F.when(F.col("company") % 9 == 0, "stale").otherwise(F.col("state"))))


@query(
    """WITH i AS (SELECT o_orderkey, o_orderkey % 101 AS a, o_custkey % 101 AS b, o_orderkey % 89 AS c, o_custkey % 97 AS e, 1 + o_orderkey % 4 AS n, o_custkey % 400 AS days, o_orderkey % 3 = 0 AS inf, o_orderkey % 5 = 0 AS con FROM orders),
 s AS (SELECT *, (a * 40 + b * 25 + c * 20 + e * 15) AS h FROM i), r AS (SELECT *, h // 100 + CASE WHEN h % 100 > 50 OR (h % 100 = 50 AND (h // 100) % 2 = 1) THEN 1 ELSE 0 END + least(15, (n - 1) * 8) AS x FROM s),
 y AS (SELECT *, CASE WHEN inf THEN least(x, 74) ELSE x END AS x1 FROM r), z AS (SELECT *, CASE WHEN con THEN least(x1, 60) ELSE x1 END AS x2 FROM y)
 SELECT o_orderkey, greatest(0, least(100, x2 - least(25, (days // 30) * 3)))::INT AS score FROM z"""
)
def confidence_score(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return _t(spark, d, "orders").select("o_orderkey", text.confidence(o % 101, c % 101, o % 89, c % 97, F.lit(1) + o % 4, c % 400, o % 3 == 0, o % 5 == 0).alias("score"))


_FIELDS = ["identity.company_name", "identity.platform", "organisation.emails", "growth.hiring", "technology.analytics", "catalogue.product_count", "business.wholesale"]
_DAYS = dict(zip(_FIELDS, [365, 180, 180, 30, 90, 30, 180], strict=True))


@query(
    "WITH f AS (SELECT event_id, ts, CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FIELDS)) + " END AS field FROM events), n AS (SELECT max(ts) AS now FROM events), k AS (SELECT event_id, field, floor((epoch_us(now) - epoch_us(ts)) / 86400000000)::BIGINT > CASE field " + " ".join(f"WHEN '{k}' THEN {v // 20}" for k, v in _DAYS.items()) + " END AS stale FROM f, n) SELECT event_id, field, stale, CASE WHEN stale THEN 50 ELSE 80 END AS confidence FROM k"
)
def staleness(spark, d):
    e = _t(spark, d, "events")
    # One row: the latest time.
    now = e.agg(F.max("ts").alias("now"))
    field = F.element_at(F.array(*[F.lit(x) for x in _FIELDS]), (F.col("event_id") % 7 + 1).cast("int"))
    rows = e.select("event_id", "ts", field.alias("field")).join(F.broadcast(now))
    age = F.floor((F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400000000)
    rows = rows.withColumn("stale", text.stale(F.col("field"), age, 20))
    return rows.select("event_id", "field", "stale", text.penalised(F.lit(80), F.col("stale")).alias("confidence"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_run_per_company(spark, d):
    return views.latest(_t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


_STATUS = {"O": "queued", "P": "running", "F": "completed", "N": "completed", "A": "failed", "R": "failed"}


@query(
    "WITH j AS (SELECT 'crawl' AS kind, o_orderkey AS run_id, o_custkey AS company, o_orderstatus AS s FROM orders UNION ALL SELECT 'extraction', l_orderkey * 10 + l_linenumber, l_suppkey, l_returnflag FROM lineitem) SELECT kind, CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END AS status, coalesce(c_name, company::VARCHAR) AS domain, count(*) AS n_jobs, max(run_id) AS last_run FROM j LEFT JOIN customer ON c_custkey = company AND c_custkey % 10 <> 0 GROUP BY 1, 2, 3"
)
def jobs_union(spark, d):
    a = _t(spark, d, "orders").select(F.lit("crawl").alias("kind"), F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("company"), F.col("o_orderstatus").alias("s"))
    b = _t(spark, d, "lineitem").select(F.lit("extraction").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), F.col("l_suppkey").alias("company"), F.col("l_returnflag").alias("s"))
    # Summed by company before the names are joined on: fewer rows move.
    jobs = a.unionByName(b).groupBy("kind", "company", views.job_status(F.col("s"), _STATUS).alias("status")).agg(F.count("*").alias("n"), F.max("run_id").alias("last"))
    names = _t(spark, d, "customer").where(F.col("c_custkey") % 10 != 0).select(F.col("c_custkey").alias("company"), "c_name")
    named = jobs.join(names, "company", "left").withColumn("domain", F.coalesce("c_name", F.col("company").cast("string")))
    return named.groupBy("kind", "status", "domain").agg(F.sum("n").alias("n_jobs"), F.max("last").alias("last_run"))


@query("SELECT c_custkey, c_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20")
def company_list_page(spark, d):
    n = _t(spark, d, "nation")
    c = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").join(n, F.col("c_nationkey") == n["n_nationkey"])
    return views.page(c, [F.desc("c_acctbal"), "c_custkey"], 2).select("c_custkey", "c_name", "n_name", "c_mktsegment")


@query("SELECT c_mktsegment, count(*) AS total FROM customer GROUP BY 1")
def company_totals(spark, d):
    return _t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("total"))


@query("SELECT o_orderkey AS fact, l_linenumber AS evidence, l_returnflag AS kind FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag <> 'N'")
def fact_evidence_join(spark, d):
    o = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    e = _t(spark, d, "lineitem").where("l_returnflag <> 'N'")
    return o.join(e, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("fact"), F.col("l_linenumber").alias("evidence"), F.col("l_returnflag").alias("kind"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def new_domains_anti(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def evidence_semi(spark, d):
    hit = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").join(hit, "o_orderkey", "left_semi").select("o_orderkey")


_EVENT_STATES = {"signup": "imported", "view": "discovering", "click": "discovered", "purchase": "crawling", "error": "failed"}
_TABLE = {k: v for k, v in rules.PROCESSING.items()} | {"ready": ["discovering", "stale"], "partial": ["discovering"], "failed": ["discovering"], "stale": ["discovering"]}
_OK = " OR ".join(f"(before = '{k}' AND state IN ({_list(v)}))" for k, v in _TABLE.items())


@query(
    "WITH s AS (SELECT event_id, user_id, ts, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENT_STATES.items()) + f" END AS state FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s) SELECT event_id, before, state, before IS NULL OR before = state OR coalesce({_OK}, false) AS valid FROM l"
)
def status_transition_check(spark, d):
    table = F.create_map(*[F.lit(x) for p in _EVENT_STATES.items() for x in p])
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", table[F.col("event_type")].alias("state"))
    return views.transitions(e, _TABLE, "user_id", ["ts", "event_id"], "state").select("event_id", "before", "state", "valid")


@query(
    "WITH j AS (SELECT event_type AS queue, event_id AS id, CASE user_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'started' WHEN 2 THEN 'finished' WHEN 3 THEN 'failed' WHEN 4 THEN 'deferred' ELSE 'scheduled' END AS s FROM events), f AS (SELECT queue, id FROM j WHERE s = 'failed' QUALIFY row_number() OVER (PARTITION BY queue ORDER BY id) <= 50) "
    "SELECT j.queue, " + ", ".join(f"count(*) FILTER (WHERE s = '{s}') AS {s}" for s in ("queued", "started", "finished", "failed", "deferred", "scheduled")) + ", any_value(x.ids) AS failed_ids FROM j LEFT JOIN (SELECT queue, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM f GROUP BY 1) x ON j.queue = x.queue GROUP BY 1"
)
def queue_stats(spark, d):
    states = ["queued", "started", "finished", "failed", "deferred", "scheduled"]
    s = F.element_at(F.array(*[F.lit(x) for x in states]), (F.col("user_id") % 6 + 1).cast("int"))
    jobs = _t(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("id"), s.alias("state"))
    return views.queue_stats(jobs, states, "failed").withColumn("failed_ids", F.array_join(F.col("failed_ids").cast("array<string>"), ","))


@query("SELECT event_id, (least(0.5 * power(2, greatest((event_id % 8)::BIGINT - 1, 0)), 30.0) * (0.5 + 0.5 * (event_id % 5) / 5.0))::DOUBLE AS delay FROM events")
def backoff(spark, d):
    k = F.col("event_id")
    return _t(spark, d, "events").select("event_id", text.backoff(k % 8, 0.5, 30.0, (k % 5) / F.lit(5.0)).alias("delay"))


@query(
    "WITH r AS (SELECT user_id AS host, event_id AS ord, CASE WHEN event_id % 3 = 0 THEN 4.0 WHEN event_id % 3 = 1 THEN 0.25 END AS crawl_delay FROM events), k AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY host ORDER BY ord) > 1 THEN greatest(coalesce(greatest(1.0, crawl_delay), 1.0), 0.5) ELSE 0 END AS del FROM r) SELECT host, ord, sum(del) OVER (PARTITION BY host ORDER BY ord ROWS UNBOUNDED PRECEDING)::DOUBLE AS starts_at FROM k"
)
def pacing_schedule(spark, d):
    k = F.col("event_id")
    r = _t(spark, d, "events").select(F.col("user_id").alias("host"), k.alias("ord"), F.when(k % 3 == 0, 4.0).when(k % 3 == 1, 0.25).alias("crawl_delay"))
    return crawl.pacing(r).select("host", "ord", "starts_at")


_ROBOTS = "# all\nUser-agent: *\nDisallow: /th\nAllow: /the\nDisallow: /de # de\n\nUser-agent: siltbot\nUser-agent: other\nDisallow: /on\nCrawl-delay: 2\n"


@query(
    "WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"[^>]*>', 1)) AS path FROM pages) SELECT path, CASE WHEN starts_with(path, '/the') THEN 'allowed' WHEN starts_with(path, '/th') OR starts_with(path, '/de') THEN 'disallowed' ELSE 'allowed' END AS outcome, CASE WHEN starts_with(path, '/the') THEN 'Allow: /the' WHEN starts_with(path, '/th') THEN 'Disallow: /th' WHEN starts_with(path, '/de') THEN 'Disallow: /de' END AS matched_rule FROM l"
)
def robots_eval(spark, d):
    paths = discovery.href_links(_t(spark, d, "pages").select("html")).select(F.lit("o").alias("origin"), F.col("href").alias("path")).distinct()
    robots = crawl.robots_rules(spark.createDataFrame([("o", _ROBOTS)], "origin string, text string"))
    return crawl.evaluate_robots(paths, robots, "unnamed").select("path", "outcome", "matched_rule")


@query("WITH RECURSIVE e(parent, child) AS (SELECT p_partkey::VARCHAR, (p_partkey * 2)::VARCHAR FROM part UNION ALL SELECT p_partkey::VARCHAR, (p_partkey * 2 + 1)::VARCHAR FROM part UNION ALL SELECT p_partkey::VARCHAR, '1' FROM part), b(url, depth) AS (SELECT '1', 0 UNION SELECT child, depth + 1 FROM b JOIN e ON parent = url WHERE depth < 5), m AS (SELECT url, min(depth) AS depth FROM b GROUP BY 1) SELECT url, depth FROM m ORDER BY depth, url LIMIT 50")
def sitemap_bfs(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("k"))
    s = F.col("k").cast("string").alias("parent")
    edges = p.select(s, (F.col("k") * 2).cast("string").alias("child")).unionByName(p.select(s, (F.col("k") * 2 + 1).cast("string").alias("child"))).unionByName(p.select(s, F.lit("1").alias("child")))
    return discovery.sitemap_closure(spark.createDataFrame([("1",)], "url string"), edges)


@query("WITH o AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer) SELECT c_nationkey AS sitemap, c_custkey AS url, pos::INT AS pos FROM o WHERE pos <= 10")
def sitemap_sampling(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = _t(spark, d, "customer").withColumn("pos", F.row_number().over(w)).where("pos <= 10")
    return rows.select(F.col("c_nationkey").alias("sitemap"), F.col("c_custkey").alias("url"), "pos")


@query("SELECT l_suppkey AS sitemap, count(*) AS n, avg((l_returnflag = 'N')::INT) >= 0.5 AS is_product FROM lineitem GROUP BY 1")
def product_sitemap_ratio(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sitemap")).agg(F.count("*").alias("n"), (F.avg((F.col("l_returnflag") == "N").cast("int")) >= 0.5).alias("is_product"))


@query("WITH v AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id, event_type FROM v WHERE n = 1")
def upsert_latest(spark, d):
    return views.latest(_t(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT event_type AS field, bool_or(value < 1) AS any_conflict, count(*) AS n FROM events GROUP BY 1")
def evidence_grouping(spark, d):
    return _t(spark, d, "events").groupBy(F.col("event_type").alias("field")).agg(F.bool_or(F.col("value") < 1).alias("any_conflict"), F.count("*").alias("n"))


def _parsed(spark, d) -> DataFrame:
    from siltstone.functions import urls
    from siltstone.sources.html_pages import parse_pages

    p = _t(spark, d, "pages").select("page_id", "url", "html")
    return parse_pages(p).withColumn("host", urls.hostname(F.col("url"))).withColumn("page_type", discovery.classify(urls.path(F.col("url")))["page_type"])


@query()
def page_blocks(spark, d):
    """Text blocks, counts and hashes of all pages (a stateful tokenizer: beyond SQL)."""
    return _parsed(spark, d).select("page_id", "text", F.sha2("text", 256).alias("text_sha256"), "structural_sha256")


@query()
def page_cleaned(spark, d):
    return _parsed(spark, d).select("page_id", F.sha2("cleaned", 256).alias("cleaned_sha256"), F.length("cleaned").alias("n_chars"))


@query()
def fallback_pages(spark, d):
    """Rules that ask for a browser, over each page's own cleaned markup, whole text and challenge class (beyond SQL)."""
    from siltstone.functions import text
    from siltstone.sources.html_pages import parse_pages

    pages = _t(spark, d, "pages").select("page_id", text.challenge(F.col("html")).isNotNull().alias("blocked"), "html")
    return parse_pages(pages).select("page_id", F.array_join(text.fallback_rules(F.col("cleaned"), F.col("text"), F.col("blocked")), ",").alias("rule_ids"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '<a '))::INT AS n_links, len(regexp_extract_all(html, '<script'))::INT AS n_scripts FROM pages")
def page_metadata(spark, d):
    return _parsed(spark, d).select("page_id", "lang", "n_links", "n_scripts")


@query("WITH l AS (SELECT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"[^>]*>', 1)) AS href FROM pages) SELECT 'navigation' AS source, count(*) AS n_links, count(DISTINCT href) AS n_hrefs FROM l")
def link_provenance_counts(spark, d):
    links = _parsed(spark, d).select(F.explode("links").alias("l")).select("l.*")
    per = links.groupBy("source", "href").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_hrefs"))


@query()
def fact_candidates(spark, d):
    """Candidates of all extractors over all pages."""
    from siltstone.operators.extract import extract

    return extract(_parsed(spark, d))


@query(
    "WITH c AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS company, lower(regexp_extract(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '^([A-Za-z]+)', 1)) AS v FROM pages), v AS (SELECT company, v, count(*) AS n FROM c WHERE v <> '' GROUP BY 1, 2), g AS (SELECT company, count(*) AS k, sum(n) AS n, any_value(v) AS v FROM v GROUP BY 1) "
    "SELECT company, CASE WHEN k = 1 THEN v END AS value, CASE WHEN k = 1 THEN 'accepted' ELSE 'conflicting' END AS status, n::BIGINT AS n_sources FROM g"
)
def language_facts(spark, d):
    """Pages to language facts: parse, extract, reconcile."""
    from siltstone.operators.extract import extract

    c = extract(_parsed(spark, d), ["language"]).withColumn("id", F.col("page_id"))
    return reconcile.scalar(c).select("company", "value", "status", "n_sources")
