"""Text, page and score functions as column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import rules
from siltstone.functions.binding import let

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9\s().-]{7,}[0-9]"


def collapse(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), r"^ | $", "")


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), F.lit(""))


def platform(value: Column, known: list[str]) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(known), low)


def redact_emails(value: Column) -> Column:
    return F.regexp_replace(value, EMAIL, "[redacted-email]")


def emails(value: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit(EMAIL), F.lit(0)), F.lower))


def phones(value: Column) -> Column:
    """Numbers of 7 to 15 digits, reduced to digits and a leading plus."""
    bare = F.transform(F.regexp_extract_all(value, F.lit(PHONE), F.lit(0)), lambda p: F.regexp_replace(p, "[^0-9+]", ""))
    return F.array_distinct(F.filter(bare, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(7, 15)))


def excerpt(value: Column, most: int = 300) -> Column:
    return F.substring(value, 1, most)


def date(value: Column) -> Column:
    """The first ISO date, even if it is invalid (then null); else the first ``Month D, YYYY``."""
    iso = F.regexp_extract(value, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    long = F.regexp_replace(F.regexp_extract(value, rf"\b((?:{months})\s+\d{{1,2}},?\s+\d{{4}})\b", 1), r",|\s+", " ")
    long = F.regexp_replace(long, " +", " ")
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).when(long != "", F.try_to_date(long, "MMMM d yyyy"))


def role(value: Column) -> Column:
    chain = F.lit("unknown")
    for name, pattern in reversed(rules.ROLES):
        chain = F.when(value.rlike(f"(?i){pattern}"), name).otherwise(chain)
    return chain


def contact_priority(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.CONTACT_PRIORITY.items() for x in pair])
    return F.coalesce(table[category], F.lit(9))


def challenge(html: Column) -> Column:
    """The class of a blocked or challenge page; null for others."""
    low, chain = F.lower(html), F.lit(None).cast("string")
    for name, phrases in reversed(rules.CHALLENGES):
        hit = low.contains(phrases[0])
        for p in phrases[1:]:
            hit = hit | low.contains(p)
        chain = F.when(hit, name).otherwise(chain)
    return chain


def binary_signature(body: Column) -> Column:
    """What a body is that starts with a known binary mark; null for others."""
    head, chain = F.hex(F.substring(body, 1, 8)), F.lit(None).cast("string")
    for mark, name in reversed(rules.BINARY_SIGNATURES):
        chain = F.when(head.startswith(mark), name).otherwise(chain)
    return chain


def page_content_type(value: Column) -> Column:
    """False for types that are no pages; true if missing or unknown."""
    low = F.lower(value)
    page = low.contains("html") | low.contains("text/") | low.contains("xml")
    bad = F.lit(False)
    for mark in rules.REJECTED_CONTENT_TYPES:
        bad = bad | low.contains(mark)
    return F.coalesce(page | ~bad, F.lit(True))


def charset_of(body: Column, content_type: Column) -> Column:
    """The charset of the header, else of a byte-order mark, else UTF-8; one that nothing here reads counts as UTF-8."""
    head = F.hex(F.substring(body, 1, 3))
    named = F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([^\"';\s]+)", 1))
    table = rules.CHARSETS | {c: "ISO-8859-1" if c in ("latin-1", "latin1", "iso-8859-1") else c for c in rules.BYTE_CHARSETS + rules.BATCH_CHARSETS}
    known = F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.nullif(named, F.lit(""))], F.when(named != "", "UTF-8"))
    mark = F.when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE")
    asked = F.coalesce(known, mark, F.lit("UTF-8"))
    return F.when(asked == "UTF-16", F.coalesce(mark, F.lit("UTF-16LE"))).otherwise(asked)


def _one_byte(part: Column, charset: Column) -> Column:
    """Text of one byte a character; a byte that the charset lacks is U+FFFD."""
    high = bytes(range(128, 256))
    tables = F.create_map(*[F.lit(x) for name in ["ISO-8859-1", *rules.BYTE_CHARSETS] for x in (name, high.decode(name, "replace"))])
    return F.call_function("translate", F.decode(part, "ISO-8859-1"), F.lit(high.decode("latin-1")), tables[charset])


_HIGH, _LOW = "D[89AB][0-9A-F]{2} ", "D[C-F][0-9A-F]{2} "


def _utf16(part: Column, charset: Column) -> Column:
    """(text, replaced, late): halves without their other half are U+FFFD, and so is an odd byte at the end.

    Works on hex digits in units of four with a blank behind each, so patterns meet whole units alone.
    """
    raw = F.hex(part)
    lone = f"{_HIGH}(?!{_LOW})|(?<!{_HIGH}){_LOW}"

    def read(units):
        odd = F.octet_length(part) % 2 == 1
        own = odd & ~units.rlike(f"{_HIGH}..$")  # an odd byte behind half a pair belongs to it
        fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(units, lone, "FFFD "), "(?<= |^)..$", ""), " ", "")
        bad_at = F.coalesce(F.floor((F.nullif(F.regexp_instr(units, F.lit(lone)), F.lit(0)) - 1) / 5) * 2, F.when(odd, F.octet_length(part).cast("long") - 1))
        return F.struct(F.decode(F.unhex(F.concat(fixed, F.when(own, "FFFD").otherwise(""))), "UTF-16BE").alias("text"), bad_at.isNotNull().alias("replaced"), F.coalesce(bad_at >= F.octet_length(part) - 8, F.lit(False)).alias("late"))

    return let(F.regexp_replace(F.when(charset == "UTF-16LE", F.regexp_replace(raw, "(..)(..)", "$2$1")).otherwise(raw), "(....)", "$1 "), read)


def _decoded(part: Column, charset: Column) -> Column:
    """(text, replaced, late) of what the JVM decodes: whether bytes were replaced, and whether the first of these are among the last eight."""
    near = F.greatest(F.octet_length(part) - 8, F.lit(0))

    def flagged(text):
        first = F.instr(text, "\ufffd")
        return F.struct(text.alias("text"), (first > 0).alias("replaced"), (first > near).alias("late"))

    # Malformed only behind ``near``: what comes before is whole, up to the end of the character that lies across.
    sound = reduce(lambda a, b: a | b, [F.is_valid_utf8(F.substr(part, F.lit(1), near + k).cast("string")) for k in range(4)])
    valid = F.is_valid_utf8(part.cast("string"))
    utf8 = F.struct(F.make_valid_utf8(part.cast("string")).alias("text"), (~valid).alias("replaced"), (~valid & sound).alias("late"))
    return F.when(charset == "UTF-8", utf8).when(charset.startswith("UTF-16"), _utf16(part, charset)).otherwise(let(_one_byte(part, charset), flagged))


def body_error(body: Column, content_type: Column) -> Column:
    """Why a body is no page: empty, binary, or of an unwanted type; null if it is one."""
    return F.when(F.coalesce(F.octet_length(body), F.lit(0)) == 0, "empty body").when(binary_signature(body).isNotNull(), F.concat(F.lit("binary: "), binary_signature(body))).when(~page_content_type(content_type), "content type")


def decode_body(body: Column, content_type: Column, most: int = 5 << 20) -> Column:
    """(html, charset, replaced, truncated, error) of a response body.

    The charset is ``charset_of``. Bytes that are none of its characters are replaced by U+FFFD, and ``replaced`` says
    so; no body fails. Only the first ``most`` bytes are read: ``truncated`` marks longer bodies, and those whose first
    malformed bytes are among the last eight, as if cut. An empty, binary or unwanted body has an error and
    no text. ``BATCH_CHARSETS`` are read as UTF-8 here; ``decoded`` reads them, too.
    """
    def named(p):
        charset = charset_of(p["body"], p["kind"])
        charset = F.when(charset.isin(rules.BATCH_CHARSETS), "UTF-8").otherwise(charset)
        return F.struct(charset.alias("charset"), body_error(p["body"], p["kind"]).alias("error"), F.substring(p["body"], 1, most).alias("part"), F.coalesce(F.octet_length(p["body"]) > most, F.lit(False)).alias("longer"))

    def read(p):
        found = F.when(p["error"].isNull(), _decoded(p["part"], p["charset"]))
        return let(F.struct(p.alias("p"), found.alias("found")), lambda x: F.struct(
            F.regexp_replace(x["found"]["text"], "^\ufeff", "").alias("html"), x["p"]["charset"].alias("charset"), F.coalesce(x["found"]["replaced"], F.lit(False)).alias("replaced"),
            (x["p"]["longer"] | F.coalesce(x["found"]["late"], F.lit(False))).alias("truncated"), x["p"]["error"].alias("error"),
        ))

    return let(let(F.struct(body.alias("body"), content_type.alias("kind")), named), read)


@F.pandas_udf(T.StructType().add("html", T.StringType()).add("replaced", T.BooleanType()).add("late", T.BooleanType()))
def _in_batches(bodies: pd.Series, charsets: pd.Series) -> pd.DataFrame:
    def one(body, charset):
        try:
            return body.decode(charset), False, False
        except UnicodeDecodeError as e:
            return body.decode(charset, "replace"), True, e.start >= len(body) - 8

    return pd.DataFrame([one(b, c) for b, c in zip(bodies, charsets)], columns=["html", "replaced", "late"])


def decoded(pages: DataFrame, body: str, content_type: str, out: str = "decoded", most: int = 5 << 20) -> DataFrame:
    """``pages`` with ``out``, as ``decode_body`` has it, and with East Asian charsets read as what they are.

    Only bodies in ``BATCH_CHARSETS`` pass through Python. ``pages`` is read twice.
    """
    charset = charset_of(F.col(body), F.col(content_type))
    rare = F.coalesce(charset.isin(rules.BATCH_CHARSETS), F.lit(False))
    error, longer = body_error(F.col(body), F.col(content_type)), F.coalesce(F.octet_length(body) > most, F.lit(False))
    other = pages.where(rare).withColumn("__d", _in_batches(F.substring(body, 1, most), charset))
    made = F.struct(F.when(error.isNull(), F.col("__d.html")).alias("html"), charset.alias("charset"), (error.isNull() & F.col("__d.replaced")).alias("replaced"), (longer | error.isNull() & F.col("__d.late")).alias("truncated"), error.alias("error"))
    return pages.where(~rare).withColumn(out, decode_body(F.col(body), F.col(content_type), most)).unionByName(other.withColumn(out, made).drop("__d"))


def content_hashes(raw: Column, cleaned: Column, text: Column, structure: Column) -> Column:
    """The four hashes that tell what of a page has changed."""
    return F.struct(F.sha2(raw, 256).alias("raw_sha256"), F.sha2(cleaned, 256).alias("cleaned_sha256"), F.sha2(collapse(text), 256).alias("text_sha256"), structure.alias("structural_sha256"))


def fallback_rules(html: Column, text: Column, blocked: Column) -> Column:
    """Ids of the rules that ask for a browser, the strongest first."""
    n = F.length(F.trim(text))
    shell = n <= 50
    found = F.array(
        F.when(blocked, "browser:challenge-page"),
        F.when(shell & (html.contains("__NEXT_DATA__") | html.contains('id="__next"')), "browser:nextjs-shell"),
        F.when(shell & html.contains("data-reactroot"), "browser:react-shell"),
        F.when(shell & html.contains("v-cloak"), "browser:vue-shell"),
        F.when((n == 0) & (html.contains('id="root"') | html.contains('id="app"')), "browser:empty-shell"),
        F.when((F.size(F.split(html, "<script")) - 1 >= 3) & (n <= 300), "browser:script-heavy"),
    )
    return F.filter(found, lambda r: r.isNotNull())


def confidence(authority, reliability, relevance, directness, agreeing, fresh_days, inferred, conflict) -> Column:
    """Weighted score of whole numbers, rounded half to even, with its boosts, caps and penalties."""
    hundredths = authority * 40 + reliability * 25 + relevance * 20 + directness * 15
    whole, rest = F.floor(hundredths / 100), hundredths % 100
    score = whole + F.when((rest > 50) | ((rest == 50) & (whole % 2 == 1)), 1).otherwise(0)
    score = score + F.least(F.lit(15), (agreeing - 1) * 8)
    score = F.when(inferred, F.least(score, F.lit(74))).otherwise(score)
    score = F.when(conflict, F.least(score, F.lit(60))).otherwise(score)
    score = score - F.least(F.lit(25), F.floor(fresh_days / 30) * 3)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def stale_days(field: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.STALE_DAYS.items() for x in pair])
    kind = F.when(field == "identity.platform", "platform").when(field.isin(rules.CONTACT_FIELDS), "contact").when(field == "growth.hiring", "careers").otherwise(F.substring_index(field, ".", 1))
    return F.coalesce(table[kind], F.lit(rules.STALE_DAYS["identity"]))


def stale(field: Column, age_days: Column, divisor: int = 1) -> Column:
    """Whether a fact of that age in whole days needs to be looked at again; ``divisor`` shortens the windows."""
    return age_days > F.floor(stale_days(field) / divisor)


def penalised(confidence: Column, is_stale: Column, penalty: int = 30) -> Column:
    """The confidence of a fact, less the penalty for a stale one, and never below zero."""
    return F.when(is_stale, F.greatest(F.lit(0), confidence - penalty)).otherwise(confidence)


def backoff(attempt: Column, base: float, most: float, jitter: Column) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(most)) * (F.lit(0.5) + F.lit(0.5) * jitter)
