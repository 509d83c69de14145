"""Fact candidates on places and catalogues: locations and their counts, products, collections, variants.

Input: parsed pages, as for ``extract``. Pages may bring counts of their sitemaps and samples
(``sitemap_products``, ``sitemap_collections``, ``known_products``, ``median_variants``, ``variant_sample``);
columns that are missing count as unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import rules, text

SCHEMA = ["company", "field", "value", "confidence", "source", "page_id", "dedup_key", "exact", "method", "sample_size"]


def address_line(entity: Column) -> Column:
    """The parts of a structured address as one lower-case line; an address that is a text stays one."""
    parts = [F.get_json_object(entity, f"$.address.{p}") for p in rules.ADDRESS_PARTS]
    plain = F.get_json_object(entity, "$.address")
    return F.lower(text.collapse(F.concat_ws(" ", *parts, F.when(~plain.rlike(r"^\s*[\[{]"), plain))))


def location_type(name: Column, kinds: Column, page: Column) -> Column:
    """What a place is: by its own name, its type, the page's wording; a shop otherwise."""
    low = F.lower(F.coalesce(name, F.lit("")))
    said = lambda w: F.coalesce(page.rlike(rf"(?i)\b{w}\b"), F.lit(False))
    return (
        F.when(low.contains("warehouse"), "warehouse")
        .when(low.contains("showroom"), "showroom")
        .when(low.contains("office") | (kinds == "corporation"), "office")
        .when(said("warehouse"), "warehouse")
        .when(said("showroom"), "showroom")
        .otherwise("retail_store")
    )


def _rows(rows: DataFrame, field: Column, value: Column, confidence: Column, source: str, dedup_key: Column | None = None, exact: bool | None = None, method: Column | None = None, sample: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        F.col("host").alias("company"), field.alias("field"), value.cast("string").alias("value"), confidence.cast("int").alias("confidence"), F.lit(source).alias("source"), "page_id",
        (dedup_key if dedup_key is not None else none.cast("string")).alias("dedup_key"), F.lit(exact).cast("boolean").alias("exact"),
        (method if method is not None else none).cast("string").alias("method"), (sample if sample is not None else none).cast("long").alias("sample_size"),
    )


def _types(entity: Column) -> Column:
    """The types of an entity, lower-case, as an array."""
    one = F.get_json_object(entity, "$.@type")
    return F.transform(F.when(one.startswith("["), F.from_json(one, "array<string>")).otherwise(F.array(F.coalesce(one, F.lit("")))), F.lower)


def operations(pages: DataFrame) -> DataFrame:
    """Locations, their counts by type on store-locator and contact pages, and the places of a returns page."""
    e = pages.select("host", "page_id", "page_type", "text", F.explode("structured").alias("e")).withColumn("kinds", _types(F.col("e"))).where(F.arrays_overlap("kinds", F.array(F.lit("store"), F.lit("localbusiness"))))
    name = F.coalesce(F.get_json_object("e", "$.name"), F.lit(""))
    stockist = F.col("text").rlike("(?i)" + "|".join(rules.STOCKIST_WORDING))
    places = e.select(
        "host", "page_id", "page_type", "e", name.alias("name"), F.when(stockist, "stockist").otherwise("owned").alias("ownership"), location_type(name, F.element_at("kinds", 1), F.col("text")).alias("location_type"), address_line(F.col("e")).alias("line")
    )

    def given(path):
        return F.get_json_object("e", f"$.{path}")

    value = F.to_json(
        F.struct(
            "location_type", "ownership", "name", given("address.streetAddress").alias("address_line"), given("address.addressLocality").alias("city"), given("address.addressRegion").alias("region"),
            given("address.postalCode").alias("postal_code"), given("address.addressCountry").alias("country"), given("telephone").alias("phone"), given("geo.latitude").alias("latitude"), given("geo.longitude").alias("longitude"),
        )
    )
    key = F.coalesce(text.blank_to_null(F.col("line")), F.lower(text.collapse(F.col("name"))))
    located = _rows(places, F.lit("operations.locations"), value, F.when(F.col("ownership") == "owned", 82).otherwise(70), "json_ld", key)
    counted = places.where("ownership = 'owned' and page_type in ('store_locator', 'contact')").groupBy("host", "page_id", "location_type").agg(F.count("*").alias("n"))
    counts = _rows(counted, F.concat(F.lit("operations."), "location_type", F.lit("_count")), F.col("n"), F.lit(78), "json_ld", exact=True, method=F.lit("exact"))
    returned = places.where("page_type = 'returns'").groupBy("host", "page_id").agg(F.count("*").alias("n"))
    returns = _rows(returned, F.lit("operations.returns_location_count"), F.col("n"), F.lit(70), "json_ld", exact=True, method=F.lit("exact"))
    return reduce(DataFrame.unionByName, [located, counts, returns])


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def catalogue(pages: DataFrame) -> DataFrame:
    """Numbers of products, articles and collections, each from the best source of its page, and marks of variants."""
    for c in ("sitemap_products", "sitemap_collections", "known_products", "median_variants", "variant_sample"):
        if c not in pages.columns:
            pages = pages.withColumn(c, F.lit(None).cast("double" if c == "median_variants" else "long"))
    hrefs = F.transform("links", lambda x: x["href"])
    products = F.size(F.array_distinct(F.filter(hrefs, lambda h: h.contains("/products/") | h.contains("/product/"))))
    collections = F.size(F.array_distinct(F.filter(hrefs, lambda h: h.rlike("/(collections|categor(?:y|ies))/"))))
    stated = F.filter(F.transform("structured", lambda e: F.get_json_object(e, "$.numberOfItems")), lambda v: v.rlike(r"^-?\d+$"))
    p = pages.withColumn("products", products).withColumn("collections", collections).withColumn("stated", F.get(stated, 0).cast("long"))
    p = p.withColumn("last_page", F.regexp_extract("text", r"(?i)page\s+\d+\s+of\s+(\d+)", 1))
    lists = F.col("page_type").isin("collection", "category")
    from_sitemap, from_markup = F.col("sitemap_products").isNotNull(), lists & F.col("stated").isNotNull()
    some = lists & ~from_sitemap & ~from_markup & (F.col("products") > 0)
    paged = some & (F.col("last_page") != "")
    offers = F.exists("structured", lambda e: F.coalesce(F.size(F.from_json(F.get_json_object(e, "$.offers"), "array<string>")) > 1, F.lit(False)))
    selector = F.col("cleaned").rlike(rules.VARIANT_SELECT)
    variants = p.where("page_type = 'product'").withColumn("selector", selector).withColumn("offers", offers)
    sku = (F.coalesce("known_products", F.lit(0)) != 0) & (F.coalesce("median_variants", F.lit(0)) != 0) & (F.coalesce("variant_sample", F.lit(0)) >= rules.LEAST_VARIANT_SAMPLE)
    count, estimate = F.lit("catalogue.product_count"), F.lit("catalogue.product_count_estimate")
    parts = [
        _rows(p.where(from_sitemap), count, F.col("sitemap_products"), F.lit(90), "sitemap_summary", exact=True, method=F.lit("exact")),
        _rows(p.where(~from_sitemap & from_markup), count, F.col("stated"), F.lit(82), "json_ld", exact=True, method=F.lit("exact")),
        _rows(p.where(paged), estimate, F.col("last_page").cast("long") * F.col("products"), F.lit(60), "deterministic_inference", exact=False, method=F.lit("pagination_derived"), sample=F.col("products")),
        _rows(p.where(some & ~paged), estimate, F.col("products"), F.lit(40), "deterministic_inference", exact=False, method=F.lit("sampled_collection"), sample=F.col("products")),
        _rows(p.where(sku), F.lit("catalogue.sku_count_estimate"), half_even(F.col("known_products") * F.col("median_variants")), F.lit(55), "deterministic_inference", exact=False, method=F.lit("product_count_x_median_variants"), sample=F.col("variant_sample")),
        _rows(p.where("sitemap_collections is not null"), F.lit("catalogue.collection_count"), F.col("sitemap_collections"), F.lit(88), "sitemap_summary", exact=True, method=F.lit("exact")),
        _rows(p.where("sitemap_collections is null and collections > 0"), F.lit("catalogue.collection_count"), F.col("collections"), F.lit(50), "deterministic_inference", exact=False, method=F.lit("counted_navigation_links"), sample=F.col("collections")),
        _rows(variants.where("selector"), F.lit("catalogue.variant_evidence"), F.lit("true"), F.lit(68), "html_element"),
        _rows(variants.where("not selector and offers"), F.lit("catalogue.variant_evidence"), F.lit("true"), F.lit(68), "json_ld"),
        _rows(p.where(F.col("cleaned").rlike(rules.CUSTOM_INPUT)), F.lit("catalogue.customization_evidence"), F.lit("true"), F.lit(75), "form"),
    ]
    return reduce(DataFrame.unionByName, parts)
