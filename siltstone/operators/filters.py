"""Filters of the read side: each takes the caller's choices and leaves out what was not chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(rows: DataFrame, *tests: Column | None) -> DataFrame:
    for t in tests:
        if t is not None:
            rows = rows.where(t)
    return rows


def _is(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def discovered_urls(rows: DataFrame, run_id=None, priority=None, page_type=None, source=None) -> DataFrame:
    """Without a priority, excluded addresses stay out."""
    return _all(rows, _is("run_id", run_id), F.col("priority") != "excluded" if priority is None else F.col("priority") == priority, _is("page_type", page_type), None if source is None else F.array_contains("sources", source))


def pages(rows: DataFrame, status=None, page_type=None, priority=None, mode=None, browser_required: bool | None = None, with_failed: bool = False) -> DataFrame:
    """Without a status, failed pages stay out unless asked for."""
    chosen = F.col("fetch_status") == status if status is not None else None if with_failed else F.col("fetch_status") != "failed"
    reason = None if browser_required is None else F.col("fallback_reason").isNotNull() == browser_required
    return _all(rows, chosen, _is("page_type", page_type), _is("priority", priority), _is("fetch_mode", mode), reason)


def facts(rows: DataFrame, hidden: list[str] = ("superseded", "stale"), state=None, least_confidence: int | None = None) -> DataFrame:
    """Facts of other statuses than the hidden ones."""
    return _all(rows, ~F.col("status").isin(list(hidden)), _is("state", state), None if least_confidence is None else F.col("confidence") >= least_confidence)


def evidence(rows: DataFrame, kind=None, strength=None, status=None, page_id=None, field=None) -> DataFrame:
    return _all(rows, _is("kind", kind), _is("strength", strength), _is("status", status), _is("page_id", page_id), _is("field", field))


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle in one of the columns, read as one text, in any case."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.strip().lower())))


def by_score(rows: DataFrame, score: str = "score", tie: str = "id", scored_first: bool = True) -> list[Column]:
    """The order of a list: best score first; rows without one last, or as if they had -1."""
    return [F.desc_nulls_last(score) if scored_first else F.coalesce(F.col(score), F.lit(-1)).desc(), F.asc(tie)]


def with_total(page: DataFrame, rows: DataFrame) -> DataFrame:
    """A page with the number of all rows beside it."""
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def safe_identifier(value: Column) -> Column:
    """Whether a value may be part of a path."""
    return F.coalesce(value.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def seconds(value: Column) -> Column:
    """A Retry-After or crawl-delay value as whole seconds; null if it is none."""
    return F.when(F.trim(value).rlike(r"^\d{1,9}$"), F.trim(value).cast("bigint"))


def matched_delay(delays: DataFrame, agent: str) -> DataFrame:
    """(origin, delay): the delay for the agent itself, else that for all; ``delays`` has origin, agent, delay, and may have line: then the last of an agent counts, else the greatest."""
    if "line" in delays.columns:
        delays = delays.groupBy("origin", F.lower("agent").alias("agent")).agg(F.max_by("delay", "line").alias("delay"))
    own = F.max(F.when(F.lower("agent") == agent.lower(), F.col("delay")))
    every = F.max(F.when(F.col("agent") == "*", F.col("delay")))
    return delays.groupBy("origin").agg(F.coalesce(own, every).alias("delay"))


def has_type(value: Column, kind: Column) -> Column:
    """Whether a JSON value is of the declared type: boolean, integer, number, string, array, object."""
    v = F.trim(value)
    tests = {"boolean": v.isin("true", "false"), "integer": v.rlike(r"^-?\d+$"), "number": v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "string": v.rlike(r'^".*"$'), "array": v.rlike(r"(?s)^\[.*\]$"), "object": v.rlike(r"(?s)^\{.*\}$")}
    out = F.lit(False)
    for name, t in tests.items():
        out = F.when(kind == name, t).otherwise(out)
    return F.coalesce(out, F.lit(False))
