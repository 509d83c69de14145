"""Fact candidates from parsed pages: each extractor is a projection; all share one schema.

Input: page_id, host, page_type and the columns of the page pass. An extractor gives company, field, value,
confidence, source and page_id, and may give more (``MORE``); ``extract`` adds the evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import rules, text, urls
from siltstone.operators import facts, matches, shops
from siltstone.storage import materialize


def _candidates(pages: DataFrame, field: str, value, confidence, source: str, keep=None) -> DataFrame:
    rows = pages.select(F.col("host").alias("company"), F.lit(field).alias("field"), value.alias("value"), confidence.cast("int").alias("confidence"), F.lit(source).alias("source"), "page_id")
    rows = rows.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    return rows if keep is None else rows.where(keep)


def _entities(pages: DataFrame) -> DataFrame:
    e = pages.select("host", "page_id", "page_type", F.explode("structured").alias("e"))
    one = F.get_json_object("e", "$.@type")
    several = F.array_join(F.from_json(one, "array<string>"), " ")
    return e.withColumn("types", F.lower(F.coalesce(F.when(one.startswith("["), several).otherwise(one), F.lit(""))))


def _several(pages: DataFrame, options: list[tuple[str, F.Column, object, str]]) -> DataFrame:
    """Candidates of (field, value, confidence, source), all in one pass over the pages."""
    made = [F.struct(F.lit(f).alias("f"), v.alias("v"), (c if isinstance(c, F.Column) else F.lit(c)).cast("int").alias("c"), F.lit(s).alias("s")) for f, v, c, s in options]
    hit = pages.select("host", "page_id", F.explode(F.array(*made)).alias("x")).where(F.col("x.v").isNotNull() & (F.trim("x.v") != ""))
    return hit.select(F.col("host").alias("company"), F.col("x.f").alias("field"), F.col("x.v").alias("value"), F.col("x.c").alias("confidence"), F.col("x.s").alias("source"), "page_id")


def _plain(markup) -> F.Column:
    """Text of markup: tags are spaces, white space is collapsed."""
    return text.collapse(F.regexp_replace(markup, "<[^>]+>", " "))


def _inside(tag: str) -> F.Column:
    """Plain text of the first element of a name; empty if there is none."""
    return _plain(F.regexp_extract("cleaned", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))


def company_name(pages: DataFrame) -> DataFrame:
    e = _entities(pages)
    org = e.where(F.col("types").contains("organization"))
    site = e.where(F.col("types").contains("website"))
    name = F.get_json_object("e", "$.name")
    title = F.trim(F.regexp_extract("title", r"^(.*?)\s*[|–—-]\s", 1))
    return reduce(
        DataFrame.unionByName,
        [
            _candidates(org, "identity.company_name", name, F.lit(92), "json_ld"),
            _candidates(site, "identity.company_name", name, F.lit(85), "json_ld"),
            _candidates(pages, "identity.company_name", F.col("site_name"), F.lit(78), "open_graph"),
            _candidates(pages.where("page_type = 'homepage'"), "identity.company_name", title, F.lit(55), "meta_tag"),
            _candidates(pages.where("page_type in ('homepage', 'about')"), "identity.company_name", F.col("logo_alt"), F.lit(50), "html_element"),
            _candidates(pages.where("page_type = 'about'"), "identity.company_name", _inside("h1"), F.lit(50), "html_element"),
            _candidates(pages, "identity.company_name", urls.fallback_name(F.col("host")), F.lit(20), "deterministic_inference"),
        ],
    )


def language(pages: DataFrame) -> DataFrame:
    def primary(tag):
        return F.lower(F.regexp_extract(tag, "^([A-Za-z]+)", 1))

    return _several(pages, [("identity.language", primary(F.col("lang")), 70, "html_element"), ("identity.language", primary(F.trim("content_language")), 60, "meta_tag")])


def country(pages: DataFrame) -> DataFrame:
    """Countries and cities: structured addresses, the address of a contact page, the footer; the domain for countries."""
    e = _entities(pages)
    place = F.coalesce(F.get_json_object("e", "$.address.addressCountry.name"), F.get_json_object("e", "$.address.addressCountry"))
    city = F.get_json_object("e", "$.address.addressLocality")
    trust = F.when(F.col("types").rlike("store|localbusiness"), 88).otherwise(90)
    structured = _several(e, [("identity.country", place, trust, "json_ld"), ("identity.city", F.when(~city.rlike(r"^[\[{]"), city), trust, "json_ld")])
    names = F.create_map(*[F.lit(x) for pair in rules.COUNTRY_NAMES.items() for x in pair])
    said = pages.withColumn("address", F.when(F.col("page_type") == "contact", _inside("address"))).withColumn("footer", _inside("footer"))
    options = [("identity.country", urls.tld_country(F.col("host")), 25, "deterministic_inference")]
    for column, confidence in (("address", 75), ("footer", 60)):
        options.append(("identity.country", names[F.lower(F.regexp_extract(column, rf"(?U)\b({rules.COUNTRY_WORDS})\b", 1))], confidence, "html_element"))
        options.append(("identity.city", F.regexp_extract(column, f"(?U){rules.CITY}", 1), confidence, "html_element"))
    return structured.unionByName(_several(said, options))


def business_model(pages: DataFrame) -> DataFrame:
    """Statements of a business model. The patterns run only over texts that have a part of what they need."""
    pages = pages.withColumn("low", F.lower("text"))

    def may(field):
        return reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in rules.BUSINESS_PARTS[field]])

    found = [F.when(may(field) & F.col("text").rlike(f"(?iU){'|'.join(ps)}"), F.struct(F.lit(field).alias("f"), F.lit(str(value).lower()).alias("v"), F.lit(c).alias("c"))) for field, value, c, ps in rules.BUSINESS_RULES]
    hit = pages.select("host", "page_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return hit.select(F.col("host").alias("company"), F.col("x.f").alias("field"), F.col("x.v").alias("value"), F.col("x.c").cast("int").alias("confidence"), F.lit("html_element").alias("source"), "page_id")


def contacts(pages: DataFrame) -> DataFrame:
    """E-mail addresses and telephone numbers, each once a page: of links before structured data before text, and there the first.

    The value is the normal form; the fragment is the contact as it is written.
    """
    def linked(scheme):
        return F.transform(F.filter("links", lambda x: F.lower(x["href"]).startswith(f"{scheme}:")), lambda x: F.substring(x["href"], len(scheme) + 2, 1 << 20))

    def stated(key):
        """Plain values of a key of the structured data."""
        return F.transform(F.filter(F.transform("structured", lambda e: F.get_json_object(e, f"$.{key}")), lambda v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]")), lambda v: F.trim(v))

    def bare(v):
        return F.regexp_replace(v, "[^0-9+]", "")

    def ranked(field, normal, *sources):
        made = [_numbered(values, k, normal) for k, (values, _, _) in enumerate(sources)]
        rows = pages.select("host", "page_id", F.explode(F.concat(*made)).alias("x")).where("x.value <> ''")
        first = rows.groupBy("host", "page_id", F.col("x.value").alias("value")).agg(F.min(F.struct("x.rank", "x.nth", "x.raw")).alias("x"))
        confidence = F.element_at(F.array(*[F.lit(c) for _, c, _ in sources]), F.col("x.rank") + 1)
        source = F.element_at(F.array(*[F.lit(s) for _, _, s in sources]), F.col("x.rank") + 1)
        return first.select(F.col("host").alias("company"), F.lit(field).alias("field"), "value", confidence.cast("int").alias("confidence"), source.alias("source"), "page_id", F.col("x.raw").alias("fragment"), F.col("value").alias("dedup_key"))

    mails = F.transform(linked("mailto"), lambda v: F.trim(F.substring_index(v, "?", 1)))
    said = F.filter(F.regexp_extract_all("text", F.lit(text.PHONE), F.lit(0)), lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(7, 15))
    written = F.regexp_extract_all("text", F.lit(text.EMAIL), F.lit(0))
    none = F.array().cast("array<string>")
    return ranked("organisation.emails", F.lower, (mails, 82, "link"), (stated("email"), 85, "json_ld"), (F.coalesce(written, none), 70, "html_element")).unionByName(
        ranked("organisation.phone_numbers", bare, (linked("tel"), 80, "link"), (stated("telephone"), 85, "json_ld"), (F.coalesce(said, none), 65, "html_element"))
    )


def _numbered(values, rank: int, normal) -> F.Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), normal(F.trim(v)).alias("value"), F.trim(v).alias("raw")))


def technology(pages: DataFrame) -> DataFrame:
    low, generator = F.lower("cleaned"), F.lower("generator")
    found = []
    for name, field, hosts, words, marks, confidence in rules.TECHNOLOGIES:
        host = F.lit(False)
        for h in hosts:
            host = host | F.array_join("script_hosts", " ").contains(h)
        word, mark = F.lit(False), F.lit(False)
        for w in words:
            word = word | F.coalesce(generator.contains(w), F.lit(False))
        for m in marks:
            mark = mark | low.contains(m)
        source = F.when(host, "script_marker").when(word, "meta_tag").when(mark, "html_element")
        found.append(F.when(source.isNotNull(), F.struct(F.lit(field).alias("f"), F.lit(name).alias("v"), F.lit(confidence).alias("c"), source.alias("s"))))
    hit = pages.select("host", "page_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return hit.select(F.col("host").alias("company"), F.col("x.f").alias("field"), F.col("x.v").alias("value"), F.col("x.c").cast("int").alias("confidence"), F.col("x.s").alias("source"), "page_id")


def trading_name(pages: DataFrame) -> DataFrame:
    e = _entities(pages)
    footer = F.regexp_replace(F.regexp_extract("cleaned", r"(?is)<footer[^>]*>(.*?)</footer>", 1), "<[^>]+>", " ")

    def said(column):
        # The pattern runs only where a part of its first word is found.
        return F.when(F.contains(F.lower(column), F.lit("trad")), F.trim(F.regexp_extract(column, f"(?iU){rules.TRADING_AS}", 1))).otherwise(F.when(column.isNotNull(), ""))

    return reduce(
        DataFrame.unionByName,
        [
            _candidates(e, "identity.trading_name", F.get_json_object("e", "$.alternateName"), F.lit(80), "json_ld"),
            _candidates(pages, "identity.trading_name", said(footer), F.lit(75), "html_element"),
            _candidates(pages.where(F.coalesce(said(footer), F.lit("")) == ""), "identity.trading_name", said(F.col("text")), F.lit(60), "html_element"),
        ],
    )


def brands(pages: DataFrame) -> DataFrame:
    e = _entities(pages).where("page_type in ('product', 'brands')")
    name = F.coalesce(F.get_json_object("e", "$.brand.name"), F.get_json_object("e", "$.brand"))
    linked = pages.select("host", "page_id", F.explode("links").alias("l")).where(F.col("l.href").rlike("(?i)/brands?/[^/]+"))
    return _candidates(e, "business.brands", name, F.lit(70), "json_ld").unionByName(_candidates(linked, "business.brands", F.col("l.anchor"), F.lit(70), "link"))


def persons(pages: DataFrame) -> DataFrame:
    """(host, page_id, url, nth, name, role_title, role_category, email, phone, source) of the people that pages name.

    People of the structured data come first, with what is said of them there; then members of team blocks: the first heading
    is the name, the first element of a role or title class what they do. Those without a name are left out.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")

    def blank(v):
        return F.coalesce(v, F.lit(""))

    def stated(e):
        said = lambda key: F.get_json_object(e, f"$.{key}")
        return F.struct(F.trim(said("name")).alias("name"), blank(said("jobTitle")).alias("role_title"), said("email").alias("email"), said("telephone").alias("phone"), F.lit("json_ld").alias("source"))

    def is_person(e):
        one = F.get_json_object(e, "$.@type")
        return F.coalesce(F.lower(one) == "person", F.lit(False)) | F.coalesce(F.exists(F.from_json(F.when(one.startswith("["), one), "array<string>"), lambda x: F.lower(x) == "person"), F.lit(False))

    def member(block):
        name, role = F.regexp_extract(block, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1), F.regexp_extract(block, rules.ROLE_BLOCK, 1)
        none = F.lit(None).cast("string")
        return F.struct(_plain(name).alias("name"), _plain(role).alias("role_title"), none.alias("email"), none.alias("phone"), F.lit("team_block").alias("source"))

    found = F.concat(F.transform(F.filter("structured", is_person), stated), F.transform(F.regexp_extract_all("cleaned", F.lit(rules.TEAM_BLOCK), F.lit(1)), member))
    rows = pages.select("host", "page_id", url.alias("url"), F.posexplode(found).alias("nth", "p")).where("p.name <> ''")
    return rows.select("host", "page_id", "url", "nth", "p.name", "p.role_title", text.role(F.col("p.role_title")).alias("role_category"), "p.email", "p.phone", "p.source")


def people(pages: DataFrame) -> DataFrame:
    """People with their attributes, and the same people as contacts to turn to, ranked by their roles (``sort_key``)."""
    rows = persons(pages).withColumn("priority", text.contact_priority(F.col("role_category")))
    whole = {"ignoreNullFields": "false"}
    attributes = F.to_json(F.struct("name", "role_title", "role_category", "email", "phone", F.col("url").alias("source_url")), whole)
    contact = F.to_json(F.struct("name", "role_title", "role_category", "priority", F.col("url").alias("source_url")), whole)
    fragment = F.regexp_replace(F.concat("name", F.lit(" — "), "role_title"), "^[ —]+|[ —]+$", "")
    structured = F.col("source") == "json_ld"
    none = F.lit(None).cast("int")

    def one(field, value, confidence, source, order):
        return F.struct(F.lit(field).alias("field"), value.alias("value"), confidence.cast("int").alias("confidence"), source.alias("source"), order.alias("sort_key"))

    both = F.array(
        one("organisation.people", attributes, F.when(structured, 80).otherwise(68), F.when(structured, "json_ld").otherwise("html_element"), none),
        one("organisation.recommended_contact_candidates", contact, F.lit(55), F.lit("deterministic_inference"), F.col("priority")),
    )
    key = F.concat_ws("|", F.lower("name"), "role_category")
    return rows.select(F.col("host").alias("company"), "page_id", fragment.alias("fragment"), key.alias("dedup_key"), F.explode(both).alias("x")).select("company", "x.field", "x.value", "x.confidence", "x.source", "page_id", "fragment", "dedup_key", "x.sort_key")


def stated(pages: DataFrame, of: list[matches.Rule]) -> DataFrame:
    """Candidates of all matches of pattern rules, in one pass over the texts: each with its place, its words and what stands around them.

    Every match of each pattern counts by itself. A statement of growth comes with the date nearby, the date of publication and the one in effect. The
    date is looked for in the statement with 200 characters of the text on both sides, where what must stand nearby is, too. The publication date is that of
    ``article:published_time``, else the day of ``fetched_at`` if the pages have such a column; the date in effect is the one nearby, else that of publication.
    """
    kept = [c for c in ("host", "page_id", "page_type", "published", "fetched_at") if c in pages.columns]
    rows = matches.pattern_matches(pages.select(*kept, "text"), of)
    published = text.date(F.regexp_replace("published", r"^(\d{4}-\d{2}-\d{2})T.*", "$1"))
    if "fetched_at" in kept:
        published = F.coalesce(published, F.col("fetched_at").try_cast("date"))
    event = text.date(F.concat_ws(" ", "prefix", "fragment", "suffix"))
    dated = F.to_json(F.struct(F.lower("fragment").alias("statement"), event.alias("event_date"), published.alias("publication_date"), F.coalesce(event, published).alias("effective_date")))
    grown = F.col("rule").isin([r.name for r in matches.GROWTH])
    locator = F.concat(F.lit("text["), F.col("start"), F.lit(":"), F.col("end"), F.lit("]"))
    return rows.select(
        F.col("host").alias("company"), "field", F.when(grown, dated).otherwise(F.col("said")).alias("value"), "confidence", F.lit("html_element").alias("source"), "page_id", "fragment", "prefix", "suffix",
        locator.alias("place"), F.when(grown, F.concat_ws("|", "rule", F.lower("fragment"))).alias("dedup_key"),
    )


#: The pattern rules by the name of their extractor: all that are asked for share one pass.
PATTERNS = {"business_model": matches.BUSINESS, "wording": matches.WORDING, "growth": matches.GROWTH}


def ai_signals(pages: DataFrame) -> DataFrame:
    words = "|".join(rules.AI_WORDS)
    said = F.regexp_extract(F.lower("text"), f"({words})", 1)
    return _several(pages, [("technology.ai_signals", F.nullif(said, F.lit("")), 55, "html_element")])


#: What candidates carry beside the common columns, and what stands for it where an extractor has none.
MORE = ["fragment", "prefix", "suffix", "place", "dedup_key", "sort_key"]


def _full(rows: DataFrame) -> DataFrame:
    """Candidates with all columns: the fragment of one that has none is its value."""
    def one(c):
        if c in rows.columns:
            return F.col(c)
        return F.col("value") if c == "fragment" else F.lit(None).cast("int" if c == "sort_key" else "string")

    return rows.select("company", "field", "value", F.col("confidence").cast("int").alias("confidence"), "source", "page_id", *[one(c).alias(c) for c in MORE])


EXTRACTORS = {
    "operations": shops.operations, "catalogue": shops.catalogue, "trading_name": trading_name, "brands": brands, "people": people, "wording": ai_signals, "company_name": company_name,
    "language": language, "country": country, "contacts": contacts, "technology": technology,
}


def extractor_of(field) -> F.Column:
    """The id of the extractor whose candidates are of a field."""
    exact = {"identity.city": "identity.country_city", "identity.country": "identity.country_city"} | {x[1]: x[1] for x in rules.EXTRACTORS}
    groups = {i.split(".")[0]: i for _, i, _, _, _ in rules.EXTRACTORS if not i.startswith(("identity.", "business.brands"))}
    table = F.create_map(*[F.lit(x) for p in exact.items() for x in p])
    by_group = F.create_map(*[F.lit(x) for p in groups.items() for x in p])
    return F.coalesce(table[field], by_group[F.substring_index(field, ".", 1)])


def extract(pages: DataFrame, only: list[str] | None = None) -> DataFrame:
    """All candidates with their evidence: company, field, value, confidence, source, page_id, extractor_id, dedup_key, sort_key, place, evidence_id, excerpt, prefix, suffix, truncated.

    An extractor sees only pages of the types it is for. The pages are written to the shared folder, since all extractors share
    one pass over them. The id of an evidence depends on page, field, locator and fragment alone; candidates of pattern rules have the matched words
    as fragment and their ``place`` in the text, others what is written on the page.
    """
    pages = materialize(pages, "parsed")
    types = {name: kinds for name, _, _, kinds, _ in rules.EXTRACTORS}

    def seen(name):
        return pages.where(F.col("page_type").isin(types[name])) if types.get(name) else pages

    parts = [_full(f(seen(name))) for name, f in EXTRACTORS.items() if only is None or name in only]
    patterns = [rule for name, of in PATTERNS.items() if only is None or name in only for rule in of]
    if patterns:
        parts.append(_full(stated(pages, patterns)))
    drafts = reduce(DataFrame.unionByName, parts).withColumn("locator", F.lit(None).cast("string")).withColumn("extractor_id", extractor_of(F.col("field")))
    return facts.with_evidence(drafts).drop("fragment", "locator")
