"""Read views: lists, pages, jobs, queues; and state machines over event tables."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import addresses, rules, text, urls
from siltstone.storage import materialize


def page(rows: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    """One page of rows in a total order; sizes are 1 to 200."""
    size = max(1, min(200, size))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def job_status(status: Column, table: dict[str, str]) -> Column:
    """Run states as job states; an unknown one fails the query."""
    known = F.create_map(*[F.lit(x) for p in table.items() for x in p])[status]
    return F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(status, F.lit("null"))))).otherwise(known)


def by_queue_time(jobs: DataFrame, at: str = "queued_at", tie: str = "run_id") -> list[Column]:
    """The order of a list of jobs: the latest queued first, those without a time last, ties by id."""
    return [F.desc_nulls_last(at), F.asc(tie)]


def queue_stats(jobs: DataFrame, states: list[str], failed: str, most: int = 50) -> DataFrame:
    """Per queue: jobs by state and the first failed ids, at most ``most``."""
    ids = F.slice(F.array_sort(F.collect_list("id")), 1, most)
    counts = jobs.groupBy("queue").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    first = jobs.where(F.col("state") == failed).withColumn("_n", F.row_number().over(Window.partitionBy("queue").orderBy("id"))).where(F.col("_n") <= most)
    return counts.join(first.groupBy("queue").agg(ids.alias("failed_ids")), "queue", "left")


def transitions(events: DataFrame, allowed: dict[str, list[str]], key: str, order: list[str], state: str) -> DataFrame:
    """Adds ``before`` and ``valid``: staying is valid, and so is what the table allows."""
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    rows = events.withColumn("before", before)
    ok = F.col("before").isNull() | (F.col("before") == F.col(state)) | F.coalesce(F.array_contains(table[F.col("before")], F.col(state)), F.lit(False))
    return rows.withColumn("valid", ok)


def import_rows(rows: DataFrame, domain: str = "domain", order: str = "row_number", batch: str = "batch") -> DataFrame:
    """Adds ``outcome``: invalid without a domain, duplicate behind the first of its domain, else importable.

    ``order`` is unique within a batch. Domains are aggregated and joined back, so that neither rows without
    one nor a very frequent one end up in one task.
    """
    first = rows.where(F.col(domain).isNotNull()).groupBy(batch, domain).agg(F.min(order).alias("_first"))
    both = rows.join(first, [batch, domain], "left")
    outcome = F.when(F.col(domain).isNull(), "invalid").when(F.col(order) > F.col("_first"), "duplicate").otherwise("importable")
    return both.withColumn("outcome", outcome).select(*rows.columns, "outcome")


def checked_rows(rows: DataFrame, website: str = "website") -> DataFrame:
    """Rows of a pasted list, checked: normalized_domain, platform, country, city, validation_status and errors (field, message).

    ``rows`` has website, platform, country and city. Blank values are none, unknown platforms too. A row without a website or with one
    whose host is not taken has an error and no domain; hosts beyond ASCII are encoded, and a leading ``www`` goes. Only such hosts pass through Python.
    """
    value = text.blank_to_null(F.col(website))
    full = F.when(value.contains("://"), value).otherwise(F.concat(F.lit("http://"), value))
    named = addresses.with_ascii_host(rows.withColumn("__full", full), "__full", "__ascii").withColumn("__host", urls.hostname(F.col("__ascii")))
    why = F.when(F.col("__full").isNull(), "missing website").otherwise(urls.website_error(F.col("__host")))
    none = F.array().cast("array<struct<field:string,message:string>>")
    errors = F.when(F.col("__why").isNotNull(), F.array(F.struct(F.lit("website").alias("field"), F.col("__why").alias("message")))).otherwise(none)
    cleaned = {"platform": text.platform(F.col("platform"), rules.PLATFORMS), "country": text.blank_to_null(F.col("country")), "city": text.blank_to_null(F.col("city"))}
    return named.withColumn("__why", why).select(
        *[cleaned[c].alias(c) if c in cleaned else F.col(f"`{c}`") for c in rows.columns], F.when(F.col("__why").isNull(), F.regexp_replace("__host", r"^www\.(?=.)", "")).alias("normalized_domain"),
        F.when(F.col("__why").isNull(), "valid").otherwise("invalid").alias("validation_status"), errors.alias("errors"),
    )


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their places 1, 2, ... in an order over all of them, however many: no task holds more than a range of it.

    The rows are sorted by ranges and written to the shared folder; a row's place is its place in its range and the sizes of the ranges before.
    The driver sees a number for each range. Rows that are equal in ``order`` have any order among them.
    """
    at = F.col("__at")
    sorted_rows = materialize(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    sizes = sorted((r["part"], r["n"]) for r in sorted_rows.groupBy(F.shiftright(at, 33).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = list(zip([p for p, _ in sizes], accumulate([0, *(n for _, n in sizes)])))
    known = rows.sparkSession.createDataFrame(before, "__part int, __before long")
    met = sorted_rows.withColumn("__part", F.shiftright(at, 33).cast("int")).join(F.broadcast(known), "__part")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__before") + at.bitwiseAND((1 << 33) - 1) + 1).alias(name))
