"""Discovered URLs: page types, priorities, links and their merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import rules, urls
from siltstone.storage import drop, materialize


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def path_rule(path: Column) -> Column:
    """``struct(page_type, confidence, rule_id)`` from the path alone; null if nothing fits."""
    low = F.lower(path)
    segment = F.regexp_replace(F.element_at(F.split(F.regexp_replace(low, "/+$", ""), "/"), -1), r"\.[a-z0-9]+$", "")
    slugs = {s: name for name, words, _, _ in reversed(rules.PAGE_TYPES) for s in words}
    kind = _map(slugs)[segment]

    def out(page_type, confidence, rule):
        return F.struct(page_type.alias("page_type"), F.lit(confidence).alias("confidence"), rule.alias("rule_id"))

    chain = F.when(low.isin("", "/"), out(F.lit("homepage"), 100, F.lit("path:homepage:/")))
    chain = chain.when(kind.isNotNull(), out(kind, 95, F.concat(F.lit("path:"), kind, F.lit(":/"), segment)))
    for name, prefixes in rules.PATH_PREFIXES:
        for p in prefixes:
            chain = chain.when(low.startswith(p), out(F.lit(name), 90, F.lit(f"prefix:{name}_prefix:{p}")))
    return chain


def anchor_rules(anchors: Column) -> Column:
    """Array of ``struct(confidence, order, page_type, rule_id)`` from link texts, best first."""

    def has_any(words):
        def hit(text):
            out = F.lower(text).contains(words[0])
            for w in words[1:]:
                out = out | F.lower(text).contains(w)
            return out

        return hit

    found = []
    for order, (name, _, words, _) in enumerate(rules.PAGE_TYPES):
        n = F.size(F.filter(anchors, has_any(words)))
        confidence = F.least(F.lit(60), F.lit(45) + (n - 1) * 5)
        found.append(F.when(n > 0, F.struct((-confidence).alias("rank"), F.lit(order).alias("order"), F.lit(name).alias("page_type"), F.lit(f"anchor:{name}").alias("rule_id"))))
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def classify(path: Column, anchors: Column | None = None, sitemap_context: Column | None = None) -> Column:
    """``struct(page_type, confidence, rule_id)``: path, then prefix, then link texts, then sitemap."""
    found = path_rule(path)
    if anchors is not None:
        best = F.get(anchor_rules(anchors), F.lit(0))
        found = F.coalesce(found, F.when(best.isNotNull(), F.struct(best["page_type"].alias("page_type"), (-best["rank"]).alias("confidence"), best["rule_id"].alias("rule_id"))))
    if sitemap_context is not None:
        found = F.coalesce(found, F.when(sitemap_context == "product", F.struct(F.lit("product").alias("page_type"), F.lit(70).alias("confidence"), F.lit("sitemap_context:product").alias("rule_id"))))
    return F.coalesce(found, F.struct(F.lit("unknown").alias("page_type"), F.lit(0).alias("confidence"), F.lit("unmatched").alias("rule_id")))


def priority(page_type: Column, url: Column, same_domain: Column, overrides: dict[str, int] | None = None) -> Column:
    """1 to 3, or 4 for excluded: off-domain, excluded extension, override, default."""
    table = _map(rules.PRIORITY | (overrides or {}))
    return F.when(~same_domain, 4).when(urls.excluded_extension(url), 4).otherwise(F.coalesce(table[page_type], F.lit(3)))


def href_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(all columns but the markup, ord, href, anchor): links by pattern, in page order."""
    both = F.regexp_extract_all(html, F.lit(r"(?s)<a href=\"([^\"]*)\"[^>]*>(.*?)</a>"), F.lit(0))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(both).alias("ord", "_a"))
    return rows.select(
        *[c for c in rows.columns if c != "_a"],
        F.regexp_extract("_a", r"<a href=\"([^\"]*)\"", 1).alias("href"),
        F.trim(F.regexp_replace(F.regexp_replace("_a", "<[^>]+>", " "), r"\s+", " ")).alias("anchor"),
    )


def page_candidates(parsed: DataFrame, url: str = "url") -> DataFrame:
    """(page_id, source_url, ord, href, normalized_url, source, anchor) of what parsed pages link to: anchors, then the canonical address, then alternates.

    Addresses are made absolute against the page; those that are rejected are left out.
    """
    def entry(href, anchor, source):
        return F.struct(href.alias("href"), anchor.alias("anchor"), source.alias("source"))

    none = F.lit(None).cast("string")
    anchors = F.transform("links", lambda x: entry(x["href"], F.nullif(x["anchor"], F.lit("")), F.when(x["source"] == "html_link", "body_link").otherwise(x["source"])))
    canonical = F.when(F.col("canonical").isNotNull(), F.array(entry(F.col("canonical"), none, F.lit("canonical")))).otherwise(F.array().cast("array<struct<href:string,anchor:string,source:string>>"))
    alternates = F.transform("alternates", lambda x: entry(x, none, F.lit("alternate")))
    rows = parsed.select("page_id", F.col(url).alias("source_url"), F.posexplode(F.concat(anchors, canonical, alternates)).alias("ord", "x"))
    rows = rows.select("page_id", "source_url", "ord", "x.href", "x.source", "x.anchor")
    absolute = urls.with_resolved(rows, "source_url", "href", "absolute").withColumn("normalized_url", urls.normalize(F.col("absolute")))
    return absolute.where("normalized_url is not null").select("page_id", "source_url", "ord", "href", "normalized_url", "source", "anchor")


def reconcile_urls(candidates: DataFrame) -> DataFrame:
    """One row per (run, url): first best type, least priority and depth, ordered distinct sources and anchors.

    ``candidates``: run, url, ord, page_type, confidence, priority, depth, source, anchor, same_domain.
    """
    def ordered(c):
        # Distinct values first: a home page that every page links to has few anchors, but very many links.
        distinct = candidates.where(F.col(c).isNotNull()).groupBy("run", "url", c).agg(F.min("ord").alias("ord"))
        return distinct.groupBy("run", "url").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda s: s[c]).alias(f"{c}s"))

    rows = candidates.groupBy("run", "url").agg(
        F.max_by("page_type", F.struct("confidence", (-F.col("ord")).alias("o"))).alias("page_type"),
        F.max("confidence").alias("confidence"),
        F.min("priority").alias("priority"),
        F.min("depth").alias("depth"),
        F.bool_or("same_domain").alias("same_domain"),
        F.count("*").alias("merged"),
        F.min("ord").alias("first_ord"),
    )
    none = F.array().cast("array<string>")
    for c in ("source", "anchor"):
        rows = rows.join(ordered(c), ["run", "url"], "left").withColumn(f"{c}s", F.coalesce(f"{c}s", none))
    return rows


def fan_out(urls: DataFrame) -> DataFrame:
    """A candidate for each source and anchor of an address (``run``, ``url``, ``ord``, ``sources``, ``anchors``); without anchors, one without."""
    by_source = urls.select(*[c for c in urls.columns if c != "sources"], F.posexplode_outer("sources").alias("nth_source", "source"))
    return by_source.select(*[c for c in by_source.columns if c != "anchors"], F.posexplode_outer("anchors").alias("nth_anchor", "anchor")).select(
        *[c for c in urls.columns if c not in ("sources", "anchors")], "source", "anchor", F.coalesce("nth_source", F.lit(0)).alias("nth_source"), F.coalesce("nth_anchor", F.lit(0)).alias("nth_anchor")
    )


def in_phases(*streams: DataFrame) -> DataFrame:
    """Candidates of several streams in a fixed order: that of the streams (``phase``), then their own (``ord``)."""
    out = streams[0].withColumn("phase", F.lit(0))
    for k, s in enumerate(streams[1:], 1):
        out = out.unionByName(s.withColumn("phase", F.lit(k)), allowMissingColumns=True)
    return out


def with_discovered(targets: DataFrame, urls: DataFrame, columns: list[str], url: str = "url", order: str = "ord") -> DataFrame:
    """Targets with columns of the first discovered address of the same normal form; null where there is none."""
    first = urls.groupBy(url).agg(*[F.min_by(c, order).alias(c) for c in columns])
    return targets.join(first, url, "left")


def first_candidates(candidates: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` candidates of each run, before merging."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")


def sitemap_search(roots: DataFrame, edges: DataFrame, depth: int = 5, files: int = 50, order: str | None = None) -> DataFrame:
    """(run, url, depth, position) of the sitemap files that each run reads, breadth first: ``files`` of a run at most.

    ``roots``: run, url, ord; ``edges``: parent, child, ord (the places in a file). Files are read in the order in which they
    were met: by the place of the file that names them, then by their place in it; with ``order`` set to ``url``, by depth
    and address. A file is read once a run, cycles end, and what lies deeper than ``depth`` is not read.

    Each level is stored: it joins the edges once with the level above, leaves out what the run has read, and keeps the
    first files by a ranked window under a fixed limit, so a run with very many files leaves few rows in a task. The loop ends where a level is empty.
    """
    def place(key):
        return F.col("url") if order == "url" else key

    first = roots.groupBy("run", "url").agg(F.min(F.struct(F.lit(0).alias("at"), F.col("ord"))).alias("key"))
    levels: list[DataFrame] = []
    counts = None
    for d in range(depth + 1):
        ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy(place(F.col("key")), "url"))).where(F.col("n") <= files)
        if counts is not None:
            ranked = ranked.join(counts, "run", "left").withColumn("n", F.col("n") + F.coalesce("read", F.lit(0))).where(F.col("n") <= files)
        level = materialize(ranked.select("run", "url", F.lit(d).alias("depth"), F.col("n").cast("int").alias("position")), "sitemaps")
        if level.isEmpty():
            drop(level)
            break
        levels.append(level)
        seen = reduce(DataFrame.unionByName, levels)
        counts = seen.groupBy("run").agg(F.max("position").alias("read"))
        met = edges.join(level.select("run", F.col("url").alias("parent"), F.col("position").alias("at")), "parent")
        first = met.groupBy("run", F.col("child").alias("url")).agg(F.min(F.struct("at", "ord")).alias("key")).join(seen.select("run", "url"), ["run", "url"], "left_anti")
    return seen if levels else first.select("run", "url", F.lit(0).alias("depth"), F.lit(0).alias("position"))


def sitemap_closure(roots: DataFrame, edges: DataFrame, depth: int = 5, files: int = 50) -> DataFrame:
    """(url, depth) of sitemap files reached from the roots, by depth and address: at most ``files`` of them."""
    found = sitemap_search(roots.select(F.lit(0).alias("run"), "url", F.lit(0).alias("ord")), edges.select("parent", "child", F.lit(0).alias("ord")), depth, files, order="url")
    return found.select("url", "depth").orderBy("depth", "url")
