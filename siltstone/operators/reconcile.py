"""Facts from candidates: rule-based merging by (company, field), conflicts kept.

``candidates``: company, field, id, value (string), source, confidence. All results carry company,
field, value, confidence, status, state, rule, n_sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import rules


def _priority():
    table = F.create_map(*[F.lit(x) for p in rules.SOURCE_PRIORITY.items() for x in p])
    return F.coalesce(table[F.col("source")], F.lit(0))


def scalar(candidates: DataFrame, threshold: int = 70, gap: int = rules.PRIORITY_GAP) -> DataFrame:
    """Manual entries win; one value is accepted; of several, one that is better sourced by ``gap``, else a conflict."""
    rows = candidates.withColumn("prio", _priority()).withColumn("key", F.lower(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")))
    order = F.struct("confidence", (-F.col("id")).alias("first"))
    manual = rows.where("source = 'manual'").groupBy("company", "field").agg(F.max_by("value", order).alias("m_value"), F.max("confidence").alias("m_conf"))
    live = rows.where((F.col("source") != "manual") & (F.col("confidence") >= threshold))
    values = live.groupBy("company", "field", "key").agg(
        F.max("prio").alias("prio"), F.max("confidence").alias("conf"), F.count("*").alias("n"), F.min("id").alias("first"), F.max_by("value", order).alias("value"), F.max_by("source", order).alias("source")
    )
    w = Window.partitionBy("company", "field").orderBy(F.desc("prio"), F.desc("conf"), "first")
    every = Window.partitionBy("company", "field")
    ranked = values.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("prio").over(w)).withColumn("all_n", F.sum("n").over(every)).withColumn("top", F.max("conf").over(every))
    best = ranked.where("rank = 1")
    one, wins = F.col("next").isNull(), F.col("prio") - F.col("next") >= gap
    auto = best.select(
        "company",
        "field",
        F.when(one | wins, F.col("value")).alias("a_value"),
        F.when(one | wins, F.col("conf")).otherwise(F.col("top")).alias("a_conf"),
        F.when(one | wins, "accepted").otherwise("conflicting").alias("a_status"),
        F.when(one, F.when(F.col("n") > 1, "verified").when(F.col("source") == "deterministic_inference", "inferred").otherwise("measured")).when(wins, "verified").otherwise("conflicting").alias("a_state"),
        F.when(one, "reconciliation.highest_confidence_scalar_selected").when(wins, "reconciliation.json_ld_overrides_title_inference").otherwise("reconciliation.conflicting_strong_sources_preserved").alias("a_rule"),
        F.when(one | wins, F.col("n")).otherwise(F.col("all_n")).alias("a_n"),
    )
    groups = rows.select("company", "field").distinct().join(manual, ["company", "field"], "left").join(auto, ["company", "field"], "left")
    by_hand = F.col("m_conf").isNotNull()
    return groups.select(
        "company",
        "field",
        F.when(by_hand, F.col("m_value")).otherwise(F.col("a_value")).alias("value"),
        F.when(by_hand, F.col("m_conf")).otherwise(F.col("a_conf")).alias("confidence"),
        F.when(by_hand, "accepted").otherwise(F.coalesce("a_status", F.lit("unknown"))).alias("status"),
        F.when(by_hand, "verified").otherwise(F.coalesce("a_state", F.lit("unknown"))).alias("state"),
        F.when(by_hand, "reconciliation.manual_overrides_automated").otherwise(F.coalesce("a_rule", F.lit("reconciliation.below_threshold_remains_unknown"))).alias("rule"),
        F.when(by_hand, F.lit(1)).otherwise(F.coalesce("a_n", F.lit(0))).cast("long").alias("n_sources"),
    )


def boolean(candidates: DataFrame, threshold: int = 70) -> DataFrame:
    """True and false both stated: a conflict; else true, else an explicit false, else unknown."""
    ok = F.col("confidence") >= threshold
    yes, no = ok & (F.col("value") == "true"), ok & (F.col("value") == "false")
    g = candidates.groupBy("company", "field").agg(
        F.count_if(yes).alias("t"), F.count_if(no).alias("f"), F.max(F.when(yes, F.col("confidence"))).alias("tc"), F.max(F.when(no, F.col("confidence"))).alias("fc")
    )
    both, t, f = (F.col("t") > 0) & (F.col("f") > 0), F.col("t") > 0, F.col("f") > 0
    n = F.when(both, F.col("t") + F.col("f")).when(t, F.col("t")).otherwise(F.col("f"))
    return g.select(
        "company",
        "field",
        F.when(both, F.lit(None).cast("string")).when(t, "true").when(f, "false").alias("value"),
        F.when(both, F.greatest("tc", "fc")).when(t, F.col("tc")).otherwise(F.col("fc")).alias("confidence"),
        F.when(both, "conflicting").when(t | f, "accepted").otherwise("unknown").alias("status"),
        F.when(both, "conflicting").when(t | f, "verified").otherwise("unknown").alias("state"),
        F.when(both, "reconciliation.conflicting_strong_sources_preserved").when(t, "reconciliation.boolean_true_or_unknown_only").when(f, "reconciliation.boolean_false_requires_explicit_evidence").otherwise("reconciliation.below_threshold_remains_unknown").alias("rule"),
        n.cast("long").alias("n_sources"),
    )


def numeric(candidates: DataFrame, threshold: int = 70) -> DataFrame:
    """Exact values first: one is accepted, several conflict; else the best estimate. Adds ``exact`` to the candidates."""
    ok = candidates.where(F.col("confidence") >= threshold)
    order = F.struct("confidence", (-F.col("id")).alias("first"))
    g = ok.groupBy("company", "field").agg(
        F.count_if("exact").alias("e"),
        F.count_distinct(F.when(F.col("exact"), F.col("value"))).alias("ev"),
        F.max(F.when(F.col("exact"), F.col("confidence"))).alias("ec"),
        F.max_by(F.when(F.col("exact"), F.col("value")), F.when(F.col("exact"), order)).alias("evalue"),
        F.max_by(F.when(~F.col("exact"), F.col("value")), F.when(~F.col("exact"), order)).alias("est"),
        F.max(F.when(~F.col("exact"), F.col("confidence"))).alias("estc"),
    )
    one, many = F.col("ev") == 1, F.col("ev") > 1
    return g.select(
        "company",
        "field",
        F.when(one, F.col("evalue")).when(many, F.lit(None).cast("string")).otherwise(F.col("est")).alias("value"),
        F.when(one | many, F.col("ec")).otherwise(F.col("estc")).alias("confidence"),
        F.when(many, "conflicting").otherwise("accepted").alias("status"),
        F.when(one, "measured").when(many, "conflicting").otherwise("inferred").alias("state"),
        F.when(one, "reconciliation.exact_value_beats_estimate").when(many, "reconciliation.competing_exact_counts_conflict").otherwise("reconciliation.highest_confidence_scalar_selected").alias("rule"),
        F.when(one | many, F.col("e")).otherwise(F.lit(1)).cast("long").alias("n_sources"),
    )


def union(candidates: DataFrame, threshold: int = 70) -> DataFrame:
    """Arrays: one item per value, its best confidence and sources, in order of first appearance."""
    live = candidates.where(F.col("confidence") >= threshold).withColumn("key", F.lower(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")))
    items = live.groupBy("company", "field", "key").agg(F.max_by("value", F.struct("confidence", (-F.col("id")).alias("f"))).alias("value"), F.max("confidence").alias("confidence"), F.count("*").alias("n"), F.min("id").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "value", "confidence", "n")))
    return items.groupBy("company", "field").agg(ordered.alias("items"), F.max("confidence").alias("confidence"), F.sum("n").alias("n_sources"))


def supersedes(new_value, old_value):
    """Whether a new value replaces an old fact."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return old_value.isNotNull() & ~norm(new_value).eqNullSafe(norm(old_value))


def projection(facts: DataFrame, total: int = 52) -> DataFrame:
    """Per company: counts by state, whole mean confidence, and how many fields are covered."""
    g = facts.groupBy("company").agg(
        F.count_if(~F.col("state").isin("stale", "conflicting")).alias("facts_accepted"),
        F.count_if(F.col("state") == "conflicting").alias("facts_conflicting"),
        F.count_if(F.col("state") == "stale").alias("facts_stale"),
        F.floor(F.coalesce(F.avg(F.when(~F.col("state").isin("stale", "conflicting"), F.col("confidence"))), F.lit(0))).alias("average_confidence"),
        F.count_distinct("field").alias("fields_covered"),
    )
    return g.withColumn("fields_total", F.lit(total))
