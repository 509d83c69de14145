"""Which extractor runs on which page, and the record of what ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import rules


def _catalogue(extractors: list[tuple], only: list[str]) -> Column:
    """The extractors as an array of structs, by falling rank, then by id."""
    rows = sorted((x for x in extractors if not only or x[1] in only), key=lambda x: (-x[4], x[1]))
    made = [F.struct(F.lit(i).alias("extractor_id"), F.lit(v).alias("version"), F.array(*[F.lit(t) for t in types]).cast("array<string>").alias("page_types"), F.lit(r).alias("rank")) for _, i, v, types, r in rows]
    return F.array(*made) if made else F.array().cast("array<struct<extractor_id:string,version:string,page_types:array<string>,rank:int>>")


def runs_on(page_type: Column, extractors: list[tuple] = rules.EXTRACTORS, only: list[str] = ()) -> Column:
    """The extractors that support a page type: those for it, and those for all types; ``only`` names the ids that may run at all."""
    return F.filter(_catalogue(extractors, list(only)), lambda x: (F.size(x["page_types"]) == 0) | F.coalesce(F.array_contains(x["page_types"], page_type), F.lit(False)))


def executions(pages: DataFrame, candidates: DataFrame, failures: DataFrame | None = None, extractors: list[tuple] = rules.EXTRACTORS, only: list[str] = (), page_types: list[str] = ()) -> DataFrame:
    """The record: (page_id, extractor_id, version, status, candidates_produced) for each eligible page and extractor that supports it.

    ``pages``: page_id, page_type, fetch_status, has_content. Pages of other types than ``page_types`` (none: all), without content or with a
    fetch status that is not eligible are seen by no extractor. ``candidates`` (page_id, extractor_id) are counted before they are
    joined, whatever a page holds; ``failures`` (page_id, extractor_id) had an error, and what they gave does not count.
    """
    from siltstone.operators.runs import extraction_eligible

    seen = pages.where(extraction_eligible(F.col("fetch_status")) & F.col("has_content"))
    if page_types:
        seen = seen.where(F.col("page_type").isin(list(page_types)))
    asked = seen.select("page_id", F.explode(runs_on(F.col("page_type"), extractors, only)).alias("x")).select("page_id", "x.extractor_id", "x.version")
    found = candidates.groupBy("page_id", "extractor_id").agg(F.count(F.lit(1)).alias("n"))
    rows = asked.join(found, ["page_id", "extractor_id"], "left")
    failed = F.lit(False)
    if failures is not None:
        rows = rows.join(failures.select("page_id", "extractor_id").distinct().withColumn("failed", F.lit(True)), ["page_id", "extractor_id"], "left")
        failed = F.coalesce("failed", F.lit(False))
    return rows.select("page_id", "extractor_id", "version", F.when(failed, "failed").otherwise("succeeded").alias("status"), F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("candidates_produced"))
