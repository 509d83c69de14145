"""Runs of the pipeline as tables: keys, rejection of active runs, page outcomes, summaries, retries, statuses.

Nothing here runs a stage; the functions say what a table of requests, targets or pages amounts to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import rules
from siltstone.functions.canonical import json_text
from siltstone.storage import drop, measured


def idempotency_key(*parts: Column, options: list[Column] = ()) -> Column:
    """A key that is equal for equal requests: the parts in order, and options whose arrays are sets."""
    said = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    packed = F.to_json(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(options)])) if options else F.lit("{}")
    return F.sha2(F.concat_ws("|", *said, F.sha2(packed, 256)), 256)


def as_set(values: Column) -> Column:
    """Array options in an order of their own; a missing one is empty."""
    return F.array_sort(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))))


def json_digest(value: Column, kind: T.DataType) -> Column:
    """SHA-256 of a value's canonical JSON text."""
    return F.sha2(json_text(value, kind), 256)


def _listed(values: Column) -> Column:
    """A list in order, repeats kept; a missing one is empty."""
    return F.array_sort(F.coalesce(values, F.array().cast("array<string>")))


_STRINGS = T.ArrayType(T.StringType())
CRAWL_OPTIONS = T.StructType().add("manual_urls", _STRINGS).add("include_page_types", _STRINGS).add("exclude_page_types", _STRINGS).add("max_pages", T.LongType()).add("browser_policy", T.StringType()).add("force_refresh", T.BooleanType())
EXTRACTION_OPTIONS = T.StructType().add("extractor_ids", _STRINGS).add("page_types", _STRINGS).add("force_refresh", T.BooleanType())
#: Lists of a crawl's settings whose order says nothing.
UNORDERED = ("response_headers_allowlist", "retryable_status_codes", "always_browser_page_types")


def _options(options: dict[str, Column], kind: T.StructType) -> Column:
    """A struct of ``kind`` from the options that are given: lists in order, a missing flag is false."""
    def one(f):
        value = options.get(f.name, F.lit(None).cast(f.dataType))
        return _listed(value) if isinstance(f.dataType, T.ArrayType) else F.coalesce(value, F.lit(False)) if isinstance(f.dataType, T.BooleanType) else value.cast(f.dataType)

    return F.struct(*[one(f).alias(f.name) for f in kind.fields])


def crawl_key(company: Column, discovery_run: Column, config: Column, config_kind: T.StructType, options: dict[str, Column]) -> Column:
    """The key of a crawl request: equal for equal requests, in the bytes that other tools compute.

    ``config`` is a struct of the settings; those in ``UNORDERED`` are put in order. ``options`` may hold what
    ``CRAWL_OPTIONS`` names. Both are hashed as canonical JSON.
    """
    fields = [F.array_sort(config.getField(f.name)).alias(f.name) if f.name in UNORDERED else config.getField(f.name).alias(f.name) for f in config_kind.fields]
    return F.sha2(F.concat_ws("|", company.cast("string"), discovery_run.cast("string"), json_digest(F.struct(*fields), config_kind), json_digest(_options(options, CRAWL_OPTIONS), CRAWL_OPTIONS)), 256)


def extraction_key(company: Column, crawl_run: Column, options: dict[str, Column]) -> Column:
    """The key of an extraction request; ``options`` may hold what ``EXTRACTION_OPTIONS`` names."""
    return F.sha2(F.concat_ws("|", company.cast("string"), crawl_run.cast("string"), json_digest(_options(options, EXTRACTION_OPTIONS), EXTRACTION_OPTIONS)), 256)


def reuse(requests: DataFrame, runs: DataFrame, keys: list[str] = ("company", "key"), run: str = "run_id", created: str = "created_at", status: str = "status") -> DataFrame:
    """Requests with ``outcome`` and ``known_run``: the latest run of the same company and key that is active or done.

    ``rejected``: it is queued or running; ``reused``: it is done, its facts stand for the request; ``new``: there is none. Failed and
    cancelled runs count for nothing. Runs are reduced to one a key before they are joined.
    """
    live = runs.where(F.col(status).isin(rules.ACTIVE_RUNS + rules.DONE_RUNS))
    last = live.groupBy(*keys).agg(F.max_by(F.struct(F.col(run).alias("known_run"), F.col(status).alias("__status")), F.struct(created, run)).alias("__last"))
    known = F.col("__last.__status")
    outcome = F.when(known.isin(rules.ACTIVE_RUNS), "rejected").when(known.isNotNull(), "reused").otherwise("new")
    return requests.join(last, list(keys), "left").select(*[F.col(f"`{c}`") for c in requests.columns], outcome.alias("outcome"), F.col("__last.known_run").alias("known_run"))


def admit(requests: DataFrame, runs: DataFrame, statuses: list[str], key: str = "key", run: str = "run_id", status: str = "status") -> DataFrame:
    """Adds ``blocked_by``: the least run of the same key in one of the statuses; null for a request that may start."""
    live = runs.where(F.col(status).isin(statuses)).groupBy(key).agg(F.min(run).alias("blocked_by"))
    return requests.join(live, key, "left")


def transient_failure(status: Column, error: Column) -> Column:
    """Whether a fetch may be tried again: by its status, or by a timeout or a broken connection."""
    return F.coalesce(status.isin(rules.RETRYABLE_STATUS), F.lit(False)) | F.coalesce(error.isin(rules.RETRYABLE_ERRORS), F.lit(False))


def page_outcome(p: dict[str, Column], challenge_policy: str = "rejected", browser_policy: str = "detect_only") -> Column:
    """(fetch_status, warning) of a target from what was found out about it, the first reason that applies.

    ``p``: robots (allowed, disallowed, unknown), fetch_error, not_modified, http_status, invalid (why the
    body was rejected), challenge (its class), unchanged, browser_required, rendered.
    """
    steps: list[tuple[Column, Column, Column]] = []

    def step(when: Column, status, warning=None) -> None:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        steps.append((F.coalesce(when, F.lit(False)), as_column(status), as_column(warning)))

    step(p["robots"] == "disallowed", "blocked_by_robots")
    step(p["fetch_error"].isNotNull(), "failed", "fetch_failed")
    step(p["not_modified"], "unchanged")
    step(~p["http_status"].between(200, 299), "failed", "http_error_status")
    step(p["invalid"].isNotNull(), "rejected", "validation_rejected")
    if challenge_policy != "browser_required":
        step(p["challenge"].isNotNull(), "failed" if challenge_policy == "failed" else "rejected", "challenge_page_detected")
    step(p["unchanged"], "unchanged")
    if browser_policy != "never":
        if browser_policy != "detect_only":
            step(p["browser_required"] & p["rendered"], "browser_fetched")
        step(p["browser_required"], "browser_required")
    status, warning = F.lit("fetched"), F.lit(None).cast("string")
    for when, s, w in reversed(steps):
        status, warning = F.when(when, s).otherwise(status), F.when(when, w).otherwise(warning)
    warning = F.coalesce(warning, F.when(p["robots"] == "unknown", F.lit("robots_policy_unknown")))
    return F.struct(status.alias("fetch_status"), warning.alias("warning"))


_COUNTED = {
    "pages_fetched": ["fetched", "browser_required", "browser_fetched"], "pages_unchanged": ["unchanged"], "pages_skipped": ["skipped"], "pages_blocked_by_robots": ["blocked_by_robots"],
    "pages_failed": ["failed", "rejected"], "pages_requiring_browser": ["browser_required", "browser_fetched"], "pages_browser_fetched": ["browser_fetched"],
}


def crawl_summary(targets: DataFrame, run: str = "run_id", homepage_failure: str = "failed") -> DataFrame:
    """Per run: counts of its targets by outcome, warnings, bytes, and the run's final status.

    ``targets``: run, page_type, fetch_status, n_warnings, bytes, cancelled.
    """
    lost_home = (F.col("page_type") == "homepage") & F.col("fetch_status").isin(_COUNTED["pages_failed"])
    counts = [F.count_if(F.col("fetch_status").isin(s)).alias(n) for n, s in _COUNTED.items()]
    g = targets.groupBy(run).agg(F.count("*").alias("targets_selected"), *counts, F.sum("n_warnings").alias("warnings"), F.sum("bytes").alias("bytes_downloaded"), F.bool_or("cancelled").alias("cancelled"), F.bool_or(lost_home).alias("lost_home"))
    nothing = (F.col("pages_failed") > 0) & (F.col("pages_fetched") == 0) & (F.col("pages_unchanged") == 0)
    some = (F.col("pages_failed") > 0) | (F.col("warnings") > 0)
    ladder = [("cancelled", F.col("cancelled")), (homepage_failure, F.col("lost_home")), ("failed", nothing), ("completed_with_warnings", some)]
    return g.withColumn("status", _ladder(ladder, "completed")).drop("cancelled", "lost_home")


def _ladder(steps: list[tuple[str, Column]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, when in reversed(steps):
        out = F.when(when, name).otherwise(out)
    return out


def extraction_summary(pages: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: pages considered, processed and skipped, what came of them, and the final status.

    ``pages``: run, fetch_status, n_candidates, n_evidence, n_warnings, failed, cancelled. Pages whose fetch
    status is not eligible are skipped.
    """
    ok = extraction_eligible(F.col("fetch_status"))
    done = ok & ~F.col("failed")
    g = pages.groupBy(run).agg(
        F.count("*").alias("pages_considered"),
        F.count_if(done).alias("pages_processed"),
        F.count_if(~ok).alias("pages_skipped"),
        F.sum(F.when(done, F.col("n_candidates")).otherwise(0)).alias("candidates_created"),
        F.sum(F.when(done, F.col("n_evidence")).otherwise(0)).alias("evidence_created"),
        F.sum("n_warnings").alias("warnings"),
        F.bool_or("cancelled").alias("cancelled"),
        F.bool_or(ok & F.col("failed")).alias("partly"),
    )
    none = (F.col("pages_processed") == 0) & (F.col("pages_considered") > 0)
    ladder = [("cancelled", F.col("cancelled")), ("partial", F.col("partly") | none), ("completed_with_warnings", F.col("warnings") > 0)]
    return g.withColumn("status", _ladder(ladder, "completed")).drop("cancelled", "partly")


def discovery_summary(candidates: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: addresses found, accepted, excluded, from sitemaps and robots files, merged; and the status.

    ``candidates``: run, normalized_url, priority, source, n_warnings.
    """
    per_url = candidates.groupBy(run, "normalized_url").agg(
        F.count("*").alias("n"), F.min("priority").alias("priority"), F.count_if(F.col("source").isin("sitemap", "sitemap_index")).alias("s"), F.count_if(F.col("source") == "robots").alias("r"), F.sum("n_warnings").alias("w")
    )
    g = per_url.groupBy(run).agg(
        F.sum("n").alias("urls_found"), F.count_if(F.col("priority") != "excluded").alias("urls_accepted"), F.count_if(F.col("priority") == "excluded").alias("urls_excluded"),
        F.sum("s").alias("sitemap_urls_found"), F.sum("r").alias("robots_urls_found"), (F.sum("n") - F.count("*")).alias("duplicate_urls_merged"), F.sum("w").alias("warnings"),
    )
    return g.withColumn("status", F.when(F.col("warnings") > 0, "completed_with_warnings").otherwise("completed"))


def import_counts(rows: DataFrame, existing: DataFrame, domain: str = "domain") -> DataFrame:
    """Per batch: created, skipped_existing, skipped_invalid, failed.

    ``rows`` carries ``outcome`` (invalid, duplicate, importable), batch and ``failed``; ``existing`` the known domains.
    """
    known = existing.select(domain).distinct().withColumn("known", F.lit(True))
    new = (F.col("outcome") == "importable") & F.col("known").isNull()
    return rows.join(known, domain, "left").groupBy("batch").agg(
        F.count_if(new & ~F.col("failed")).alias("created"),
        F.count_if((F.col("outcome") == "duplicate") | (F.col("outcome") == "importable") & F.col("known").isNotNull()).alias("skipped_existing"),
        F.count_if(F.col("outcome") == "invalid").alias("skipped_invalid"),
        F.count_if(new & F.col("failed")).alias("failed"),
    )


def extraction_eligible(fetch_status: Column) -> Column:
    """Whether a page has content to extract from."""
    return F.coalesce(fetch_status.isin("fetched", "unchanged", "browser_fetched"), F.lit(False))


def retry_subset(targets: DataFrame, with_blocked: bool = False) -> DataFrame:
    """The targets that a retry takes up again."""
    return targets.where(F.col("fetch_status").isin(["failed", "rejected"] + ["blocked_by_robots"] * with_blocked))


def skip_after_cancel(targets: DataFrame, run: str = "run_id", order: str = "ord", at: str = "cancelled_at") -> DataFrame:
    """Targets from the place on at which their run was cancelled are skipped; ``at`` is null for runs that were not."""
    late = F.col(at).isNotNull() & (F.col(order) >= F.col(at))
    return targets.withColumn("fetch_status", F.when(late, "skipped").otherwise(F.col("fetch_status"))).withColumn("cancelled", F.col(at).isNotNull())


def advance(current: Column, wanted: Column, allowed: dict[str, list[str]]) -> Column:
    """The wanted state where the table allows the step from the current one; else the current one stays."""
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    return F.when(F.coalesce(F.array_contains(table[current], wanted), F.lit(False)), wanted).otherwise(current)


def stage_end(run_status: Column, done: str) -> Column:
    """The company's state that a stage's end asks for."""
    return F.when(run_status.isin("completed", "completed_with_warnings", "partial"), done).otherwise("failed")


def finalised(status: Column, error: Column) -> Column:
    """(status, error) of a run that is stored: a cancelled one counts as failed, for that reason."""
    cancelled = status == "cancelled"
    return F.struct(F.when(cancelled, "failed").otherwise(status).alias("status"), F.when(cancelled, "cancelled").otherwise(error).alias("error"))


def overlay(defaults: dict[str, object], options: dict[str, Column]) -> Column:
    """The settings of a run: its own where given."""
    return F.struct(*[F.coalesce(options[k], F.lit(v)).alias(k) if k in options else F.lit(v).alias(k) for k, v in defaults.items()])


def with_versions(runs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Adds the versions of all rule sets as a map."""
    return runs.withColumn("versions", F.create_map(*[F.lit(x) for p in sorted(versions.items()) for x in p]))


def jobs(streams: dict[str, DataFrame], table: dict[str, str]) -> DataFrame:
    """(kind, run_id, company, status, queued_at) of all streams, states renamed; an unknown one fails the query."""
    from siltstone.operators.views import job_status

    parts = [s.select(F.lit(kind).alias("kind"), "run_id", "company", job_status(F.col("status"), table).alias("status"), "queued_at") for kind, s in streams.items()]
    return reduce(DataFrame.unionByName, parts)


def content(pages: DataFrame) -> DataFrame:
    """Adds ``content``: the page's own, inline or stored, else that of the page it is unchanged from; pages with none go.

    ``pages``: page_id, inline, stored, unchanged_from.
    """
    own = F.coalesce("inline", "stored")
    before = pages.select(F.col("page_id").alias("unchanged_from"), own.alias("before"))
    return pages.withColumn("own", own).join(before, "unchanged_from", "left").withColumn("content", F.coalesce("own", "before")).drop("own", "before").where("content is not null")


def storage_mode(body: Column, most: int = 250_000) -> Column:
    """Where a body of that size is kept."""
    return F.when(body.isNull(), "none").when(F.octet_length(body) <= most, "inline").otherwise("external")


def store_bodies(pages: DataFrame, body: str = "body") -> DataFrame:
    """(digest, body, n_pages): bodies under their SHA-256, each stored once, read back and checked.

    ``body`` is a string or binary column; null ones are not stored. Equal bodies are put together before they move. The stored table must have as many rows as were
    written, and every body its digest; else the function fails, and nothing is returned.
    """
    keyed = pages.where(F.col(body).isNotNull()).select(F.sha2(F.col(body).cast("binary"), 256).alias("digest"), F.col(body).alias("body"))
    stored, written = measured(keyed.groupBy("digest").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("n_pages")), "bodies", F.count(F.lit(1)).alias("n"))
    found = stored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.sha2(F.col("body").cast("binary"), 256) != F.col("digest")).alias("bad")).first()
    if found["n"] != written["n"] or found["bad"]:
        drop(stored)
        raise ValueError(f"of {written['n']} bodies {found['n']} were stored, {found['bad']} of them damaged")
    return stored
