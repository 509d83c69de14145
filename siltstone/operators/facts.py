"""Facts as they are kept: array merging, choice of strategy, assembly, and what new facts do to old ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import canonical, rules
from siltstone.operators import reconcile

#: The rule that an array strategy is recorded under.
ARRAY_RULES = {
    "set_union": "reconciliation.array_set_union_deduplicated",
    "structured_entity_merge": "reconciliation.structured_entities_merged_deduplicated",
    "time_series": "reconciliation.time_series_signal_appended",
}
_COMMON = ["company", "field", "value", "confidence", "status", "state", "rule", "n_sources"]


def normal(value: Column) -> Column:
    """The form in which values are compared."""
    return F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))


def value_key(value: Column, kind: Column, apart: bool = False) -> Column:
    """The typed key under which equal values meet, from a value's text and its kind (string, enum, integer, float, boolean, else JSON).

    Texts are trimmed and folded. Numbers and booleans share one tag and one form, so ``1``, ``1.0`` and ``true`` are one value, as
    they are in the engine whose results these are; with ``apart`` each kind has a tag of its own. A text is never a number: ``"1"`` and ``1`` differ.
    """
    figure = value.try_cast("double")
    whole = value.try_cast("decimal(38,0)")
    number = F.when(value.rlike(r"^\s*[+-]?\d{1,37}\s*$"), whole.cast("string")).when((figure == F.floor(figure)) & (F.abs(figure) < 1e15), figure.cast("long").cast("string")).otherwise(canonical.number(figure))
    flag = F.lower(F.trim(value))
    tag = (lambda own: F.lit(f"{own}:")) if apart else (lambda own: F.lit("number:"))
    return (
        F.when(kind.isin("string", "enum"), F.concat(F.lit("text:"), normal(value)))
        .when(kind == "integer", F.concat(tag("integer"), number))
        .when(kind == "float", F.concat(tag("float"), number))
        .when(kind == "boolean", F.concat(tag("boolean"), F.when(flag == "true", "1").when(flag == "false", "0")))
        .otherwise(F.concat(F.lit("json:"), value))
    )


def group_maps(facts: DataFrame, total: int = 52) -> DataFrame:
    """One row a company: a map for each group of fields, short name to what is known, and how well it is.

    ``facts``: company, field, ord, value, state, confidence, evidence (an array), verified_at. The group is the field's name up to its first
    dot; fields of no group of ``rules.GROUPS`` count for nothing. Of several facts of a field the last by ``ord`` is shown, while
    ``quality`` counts all: accepted, conflicting and stale ones, the whole mean confidence of the accepted, the fields
    shown, and all there are. A company has at most as many map entries as there are fields.
    """
    rows = facts.withColumn("group", F.substring_index("field", ".", 1)).where(F.col("group").isin(rules.GROUPS))
    rows = rows.withColumn("short", F.when(F.instr("field", ".") > 0, F.regexp_replace("field", r"^[^.]*\.", "")).otherwise(""))
    accepted = ~F.col("state").isin("stale", "conflicting")
    shown = F.struct("value", F.col("state").alias("verification_state"), "confidence", F.col("evidence").alias("evidence_ids"), F.col("verified_at").alias("last_verified_at"))
    per_field = rows.groupBy("company", "group", "short").agg(
        F.max_by(shown, "ord").alias("shown"), F.count_if(accepted).alias("a"), F.count_if(F.col("state") == "conflicting").alias("c"), F.count_if(F.col("state") == "stale").alias("s"), F.sum(F.when(accepted, F.col("confidence")).otherwise(0)).alias("sum")
    )
    entry = F.struct("short", "shown")
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("group") == g, entry)), lambda x, y: F.when(x["short"] < y["short"], -1).when(x["short"] > y["short"], 1).otherwise(0))).alias(g) for g in rules.GROUPS]
    mean = F.when(F.sum("a") > 0, F.floor(F.sum("sum") / F.sum("a"))).otherwise(0).cast("long")
    quality = F.struct(
        F.sum("a").alias("facts_accepted"), F.sum("c").alias("facts_conflicting"), F.sum("s").alias("facts_stale"), mean.alias("average_confidence"), F.count(F.lit(1)).alias("fields_covered"), F.lit(total).cast("long").alias("fields_total")
    )
    return per_field.groupBy("company").agg(*maps, quality.alias("quality"))


def arrays(candidates: DataFrame, rule: str = ARRAY_RULES["set_union"], threshold: int = 70) -> DataFrame:
    """One fact per (company, field): its items by ``dedup_key``, else by value.

    ``candidates``: company, field, id, value, confidence, dedup_key, sort_key, evidence (an array). An item
    has the value of its most confident candidate (of equal ones the first), all evidence in the order of
    ids, the number of its candidates and their least sort key; items go by sort key, then by first id.
    The result has ``items`` beside the common columns; ``value`` is the JSON of the items' values.
    """
    live = candidates.where(F.col("confidence") >= threshold).withColumn("key", normal(F.coalesce("dedup_key", "value")))
    merged = live.groupBy("company", "field", "key").agg(
        F.max_by("value", F.struct("confidence", (-F.col("id")).alias("first"))).alias("value"),
        F.max("confidence").alias("confidence"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "evidence"))), lambda x: x["evidence"])).alias("evidence"),
        F.count("*").alias("source_count"),
        F.min(F.coalesce("sort_key", F.lit(0))).alias("sort_key"),
        F.min("id").alias("first"),
    )
    item = F.struct("sort_key", "first", "value", "confidence", "evidence", "source_count")
    facts = merged.groupBy("company", "field").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("confidence").alias("confidence"), F.sum("source_count").alias("n_sources"))
    return facts.select(
        "company",
        "field",
        F.to_json(F.transform("items", lambda x: x["value"])).alias("value"),
        "confidence",
        F.lit("accepted").alias("status"),
        F.lit("verified").alias("state"),
        F.lit(rule).alias("rule"),
        "n_sources",
        F.transform("items", lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"), x["evidence"].alias("evidence"), x["source_count"].alias("source_count"), x["sort_key"].alias("sort_key"))).alias("items"),
    )


def by_strategy(candidates: DataFrame, catalogue: DataFrame, threshold: int = 70) -> DataFrame:
    """Facts of all fields, each by the strategy that the catalogue (field, strategy) names.

    A field that the catalogue lacks has no fact; an unknown strategy fails the query. The catalogue is a
    table of fields: small, and independent of the candidates.
    """
    known = ["scalar_preferred", "scalar_conflict_preserving", "boolean_positive_only", "boolean_explicit", "numeric_exact_or_estimate", *ARRAY_RULES]
    checked = F.when(F.col("strategy").isin(known), F.col("strategy")).otherwise(F.raise_error(F.concat(F.lit("unsupported strategy: "), F.col("strategy"))))
    rows = candidates.join(F.broadcast(catalogue.select("field", checked.alias("strategy"))), "field")

    def of(*names: str) -> DataFrame:
        return rows.where(F.col("strategy").isin(list(names))).drop("strategy")

    positive = of("boolean_positive_only").where("value = 'true'")
    parts = [
        reconcile.scalar(of("scalar_preferred", "scalar_conflict_preserving"), threshold),
        reconcile.boolean(positive, threshold),
        reconcile.boolean(of("boolean_explicit"), threshold),
        reconcile.numeric(of("numeric_exact_or_estimate"), threshold),
        *(arrays(of(name), rule, threshold) for name, rule in ARRAY_RULES.items()),
    ]
    return reduce(DataFrame.unionByName, [p.select(*[F.col(c).cast("long") if c in ("confidence", "n_sources") else F.col(c) for c in _COMMON]) for p in parts])


def against_existing(facts: DataFrame, existing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """New facts with ``supersedes``: whether the current fact of their company and field goes stale.

    A changed value supersedes, and so does a conflict, unless the old fact was one too. Arrays never do,
    nor does a fact that stays unknown.
    """
    old = existing.where(F.col("status").isin("accepted", "conflicting")).select("company", "field", F.col("value").alias("old_value"), F.col("status").alias("old_status"))
    kinds = catalogue.select("field", F.col("strategy").isin(list(ARRAY_RULES)).alias("is_array"))
    both = facts.join(old, ["company", "field"], "left").join(F.broadcast(kinds), "field", "left")
    changed = ~normal(F.col("value")).eqNullSafe(normal(F.col("old_value")))
    goes = F.when(F.col("status") == "conflicting", F.col("old_status") != "conflicting").otherwise((F.col("status") == "accepted") & changed)
    return both.withColumn("supersedes", F.col("old_status").isNotNull() & ~F.coalesce("is_array", F.lit(False)) & goes).drop("old_value", "old_status", "is_array")


def current_facts(facts: DataFrame, existing: DataFrame) -> DataFrame:
    """The current facts after a run: new ones replace those of their company and field, superseded ones stay as stale.

    ``facts`` comes from ``against_existing``; unknown facts change nothing.
    """
    new = facts.where(F.col("status") != "unknown")
    keys = new.select("company", "field", "supersedes")
    old = existing.join(keys, ["company", "field"], "left")
    live = F.col("status").isin("accepted", "conflicting")
    kept = old.where(~live | F.col("supersedes").isNull() | F.col("supersedes"))
    stale = live & F.coalesce("supersedes", F.lit(False))
    kept = kept.withColumns({c: F.when(stale, "stale").otherwise(F.col(c)) for c in ("status", "state")})
    return kept.select(existing.columns).unionByName(new.select(existing.columns))


def assembled(candidates: DataFrame) -> DataFrame:
    """Per (company, field): first and last sight, versions of the extractors, evidence of the selected candidates and what qualifies them.

    ``candidates``: company, field, id, observed_at, extractor, version, evidence (an array), selected,
    estimation_method, sample_size, exact. Of several versions or qualifiers the last by id counts.
    """
    versions = candidates.groupBy("company", "field", "extractor").agg(F.max_by("version", "id").alias("version"))
    versions = versions.groupBy("company", "field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extractor", "version")))).alias("versions"))
    chosen = F.col("selected")

    def last(c):
        return F.max_by(c, F.when(chosen & F.col(c).isNotNull(), F.col("id"))).alias(c)

    facts = candidates.groupBy("company", "field").agg(
        F.min("observed_at").alias("first_observed_at"),
        F.max("observed_at").alias("last_observed_at"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(chosen, F.struct("id", "evidence")))), lambda x: x["evidence"])).alias("evidence"),
        last("estimation_method"),
        last("sample_size"),
        last("exact"),
    )
    return facts.join(versions, ["company", "field"])


def evidence_id(page: Column, field: Column, locator: Column, fragment: Column) -> Column:
    """The same id for the same fragment at the same place, whenever it is seen."""
    return F.sha2(F.concat_ws("|", page.cast("string"), field, F.coalesce(locator, F.lit("")), F.sha2(fragment, 256)), 256)


def with_evidence(drafts: DataFrame, most: int = 300, around: int = 120) -> DataFrame:
    """Drafts (page_id, field, value, locator, fragment) with their evidence; one without a fragment is dropped.

    The excerpt is the fragment with e-mail addresses redacted, but for facts on contacts, cut at ``most``
    characters; ``truncated`` says so. Drafts may bring ``prefix`` and ``suffix``, which are redacted alike and cut at ``around``.
    """
    from siltstone.functions import text

    plain, field = text.collapse(F.col("fragment")), F.col("field")
    open_ = field.isin("organisation.emails", "organisation.people", "organisation.recommended_contact_candidates")
    rows = drafts.where(F.coalesce(plain, F.lit("")) != "").withColumn("shown", F.when(open_, plain).otherwise(text.redact_emails(plain)))

    def said(c):
        return text.excerpt(F.when(open_, F.col(c)).otherwise(text.redact_emails(F.col(c))), around).alias(c) if c in ("prefix", "suffix") else F.col(c)

    return rows.select(*[said(c) for c in drafts.columns], evidence_id(F.col("page_id"), field, F.col("locator"), F.col("fragment")).alias("evidence_id"), text.excerpt(F.col("shown"), most).alias("excerpt"), (F.char_length("shown") > most).alias("truncated"))
