"""Crawling: target choice, robots rules, pacing, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import rules


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """Of each (run, url) the shallowest, then the better sourced, then the first."""
    w = Window.partitionBy("run", "url").orderBy("depth", (~F.col("preferred")).cast("int"), "ord")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def select_targets(candidates: DataFrame, pages: int = rules.CRAWL_PAGES, caps: dict[str, int] | None = None, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Targets of each run, with ``position``.

    ``candidates``: run, url, ord, page_type, priority, depth, preferred. Priority 1 and included URLs
    always stay; the rest fills up by priority, type, depth, source and URL under the caps of their
    categories (collections and categories share one). Caps are window ranks under a fixed limit, so of a run of
    any size only the first ``pages`` of each category leave a task.
    """
    caps = caps or rules.CRAWL_CAPS
    order = F.coalesce(_map({t: i for i, t in enumerate(rules.CRAWL_ORDER)})[F.col("page_type")], F.lit(len(rules.CRAWL_ORDER)))
    known = dedupe_candidates(candidates).withColumn("type_order", order)
    known = known.where(~F.col("url").isin(list(exclude))) if exclude else known
    wanted = F.col("url").isin(list(include)) if include else F.lit(False)
    known = known.withColumn("always", wanted | ((F.col("priority") == 1) & ~F.col("page_type").isin(rules.CRAWL_DENIED)))
    known = known.where(F.col("always") | (~F.col("page_type").isin(rules.CRAWL_DENIED) & (F.col("priority") < 4)))
    category = F.when(F.col("page_type").isin("collection", "category"), "collection").when(F.col("page_type").isin("product", "unknown"), F.col("page_type"))
    cap = F.coalesce(_map({k: v for k, v in caps.items() if k != "category"})[F.col("category")], F.lit(1 << 30))
    fill = ["priority", "type_order", "depth", (~F.col("preferred")).cast("int"), "url"]
    pool = known.where(~F.col("always")).withColumn("category", category).withColumn("cap", cap)
    pool = pool.withColumn("_c", F.row_number().over(Window.partitionBy("run", F.coalesce("category", F.lit("-"))).orderBy(*fill))).where((F.col("_c") <= F.lit(pages)) & (F.col("_c") <= F.col("cap")))
    fixed = known.where("always")
    room = fixed.groupBy("run").agg(F.count("*").alias("fixed"))
    pool = pool.join(room, "run", "left").withColumn("_t", F.row_number().over(Window.partitionBy("run").orderBy(*fill)))
    pool = pool.where((F.col("_t") <= F.lit(pages)) & (F.col("_t") <= F.lit(pages) - F.coalesce("fixed", F.lit(0))))
    both = fixed.select("run", "url", "page_type", "priority", "depth", "type_order").unionByName(pool.select("run", "url", "page_type", "priority", "depth", "type_order"))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("run").orderBy("type_order", "priority", "url"))).drop("type_order")


def robots_sitemaps(files: DataFrame, text: str = "text") -> DataFrame:
    """(origin, sitemap, line): what robots files name as sitemaps, wherever they do."""
    lines = files.select("origin", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line", "l"))
    found = F.regexp_extract("l", r"(?i)^\s*sitemap\s*:\s*([^\s#]+)", 1)
    return lines.select("origin", found.alias("sitemap"), "line").where("sitemap <> ''")


def robots_delays(files: DataFrame, agent: str, text: str = "text") -> DataFrame:
    """(origin, delay) in seconds, for the agent itself or else for all. Of several lines of an agent the last number counts; what is no number counts for nothing."""
    from siltstone.operators.filters import matched_delay

    rows = robots_rules(files, text).where("kind = 'crawl-delay'")
    said = F.trim("pattern")
    number = F.when(said.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), said.cast("double"))
    return matched_delay(rows.select("origin", "agent", number.alias("delay"), "line").where("delay is not null"), agent)


def latest_before(targets: DataFrame, pages: DataFrame, columns: list[str], keys: list[str] = ("company", "url"), order: str = "fetched_at") -> DataFrame:
    """Targets with columns of the latest page of their company and address."""
    last = pages.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])
    return targets.join(last, list(keys), "left")


def robots_rules(files: DataFrame, text: str = "text") -> DataFrame:
    """(origin, agent, kind, pattern, line) of robots files (origin, text).

    Comments go; agent lines in a row share a group until a rule is seen.
    """
    lines = files.select("origin", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line", "_l"))
    lines = lines.withColumn("_l", F.trim(F.regexp_replace("_l", "#.*$", "")))
    lines = lines.select("origin", "line", F.lower(F.trim(F.substring_index("_l", ":", 1))).alias("field"), F.trim(F.regexp_extract("_l", r"^[^:]*:(.*)$", 1)).alias("value"))
    lines = lines.where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("origin").orderBy("line")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    lines = lines.withColumn("grp", F.sum(starts.cast("int")).over(w))
    agents = lines.where("field = 'user-agent'").select("origin", "grp", F.lower("value").alias("agent"))
    found = lines.where("field <> 'user-agent'").select("origin", "grp", "line", F.col("field").alias("kind"), F.col("value").alias("pattern"))
    return agents.join(found, ["origin", "grp"]).drop("grp")


def evaluate_robots(paths: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """(origin, path, outcome, matched_rule): longest pattern, allow on ties; unknown without a group."""
    groups = robots.groupBy("origin").agg(F.bool_or(F.col("agent") == agent.lower()).alias("own"), F.bool_or(F.col("agent") == "*").alias("any"))
    use = F.when(F.col("own"), agent.lower()).when(F.col("any"), "*")
    known = paths.join(groups, "origin", "left").withColumn("use", use)
    live = robots.where(F.col("kind").isin("allow", "disallow") & (F.col("pattern") != "")).select(F.col("origin").alias("_o"), F.col("agent").alias("_a"), "kind", "pattern")
    on = (F.col("origin") == F.col("_o")) & (F.col("use") == F.col("_a")) & F.col("path").startswith(F.col("pattern"))
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").alias("allow"), "pattern"))).alias("m")
    out = known.join(live, on, "left").groupBy("origin", "path", "use").agg(best)
    outcome = F.when(F.col("use").isNull(), "unknown").when(F.col("m").isNull() | F.col("m.allow"), "allowed").otherwise("disallowed")
    rule = F.when(F.col("m").isNotNull(), F.concat(F.when(F.col("m.allow"), "Allow: ").otherwise("Disallow: "), F.col("m.pattern")))
    return out.select("origin", "path", outcome.alias("outcome"), rule.alias("matched_rule"))


def pacing(requests: DataFrame, default: float = 1.0, least: float = 0.5) -> DataFrame:
    """Adds ``starts_at``: seconds after a host's first request, each a delay behind the one before."""
    delay = F.greatest(F.coalesce(F.greatest(F.lit(default), F.col("crawl_delay")), F.lit(default)), F.lit(least))
    w = Window.partitionBy("host").orderBy("ord")
    later = F.when(F.row_number().over(w) > 1, delay).otherwise(F.lit(0.0))
    return requests.withColumn("_d", later).withColumn("starts_at", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def changes(pages: DataFrame) -> DataFrame:
    """Adds ``unchanged_from``: the version before, if its raw or structural hash is the same.

    ``pages``: company, url, fetched_at, page_id, raw_hash, structural_hash.
    """
    w = Window.partitionBy("company", "url").orderBy("fetched_at", "page_id")
    before = F.lag(F.struct("page_id", "raw_hash", "structural_hash")).over(w)
    rows = pages.withColumn("_b", before)
    same = F.coalesce(F.col("_b.raw_hash") == F.col("raw_hash"), F.lit(False)) | F.coalesce(F.col("_b.structural_hash") == F.col("structural_hash"), F.lit(False))
    return rows.withColumn("unchanged_from", F.when(same, F.col("_b.page_id"))).drop("_b")
