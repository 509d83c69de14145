"""Host addresses: IP literals as 128-bit numbers, private and reserved ranges, and names beyond ASCII."""

from __future__ import annotations

import ipaddress
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltstone.functions import rules
from siltstone.functions.binding import let

_OCTET = r"(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_FOUR, _SIX = "4" + "0" * 24, "6"  # what stands before the digits of an address of either family


def _hex4(host: Column) -> Column:
    """The 8 hex digits of an IPv4 address."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.regexp_extract(host, _IPV4, k).try_cast("long")), 2, "0")) for k in (1, 2, 3, 4)])


def _groups(half: Column) -> Column:
    return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))


def _padded(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda g: F.lpad(g, 4, "0")), "")


def _number6(bare: Column) -> Column:
    """The number of an IPv6 literal in small letters without brackets and zone; null for other texts."""
    tail = F.regexp_extract(bare, r":([^:]*\.[^:]*)$", 1)
    digits = _hex4(tail)
    plain = F.when(tail == "", bare).when(tail.rlike(_IPV4), F.concat(F.regexp_extract(bare, r"^(.*:)[^:]*$", 1), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4)))

    def wide(p):
        n = F.size(p["head"]) + F.size(p["rest"])
        fits = F.when(p["halves"] == 1, n == 8).otherwise((p["halves"] == 2) & (n <= 7))
        fine = F.forall(F.concat(p["head"], p["rest"]), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fits & fine, F.concat(F.lit(_SIX), _padded(p["head"]), F.repeat(F.lit("0"), (F.lit(8) - n) * 4), _padded(p["rest"])))

    def parted(halves):
        return F.struct(F.size(halves).alias("halves"), _groups(F.get(halves, F.lit(0))).alias("head"), _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("rest"))

    return let(let(F.split(plain, "::", -1), parted), wide)


def ip_number(host: Column) -> Column:
    """An IP literal as its family and 32 hex digits, which sort as their numbers; null for other hosts.

    IPv6 may stand in brackets, with ``::``, a zone and an IPv4 tail. Octets above 255 or with leading zeros make no
    address, nor do more than four digits of a group or too many groups.
    """
    bare = F.regexp_replace(F.regexp_replace(F.lower(host), r"^\[|\]$", ""), r"%[^%]+$", "")
    return F.when(host.rlike(_IPV4), F.concat(F.lit(_FOUR), _hex4(host))).when(host.contains(":"), let(bare, _number6))


@lru_cache(maxsize=1)
def inner_ranges() -> list[tuple[str, str]]:
    """The ranges (first, last) of ``rules.INNER_NETWORKS`` but for ``rules.OUTER_NETWORKS``, disjoint and in order."""

    def span(text):
        net = ipaddress.ip_network(text)
        base = net.version << 128
        return base + int(net[0]), base + int(net[-1])

    cuts = sorted(span(x) for x in rules.OUTER_NETWORKS)
    merged: list[list[int]] = []
    for a, b in sorted(span(x) for x in rules.INNER_NETWORKS):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        for c, e in cuts:
            if a <= c and e <= b:
                if a < c:
                    out.append((a, c - 1))
                a = e + 1
        if a <= b:
            out.append((a, b))
    return [(f"{a:x}", f"{b:x}") for a, b in out]


def is_inner(number: Column) -> Column:
    """Whether an address (of ``ip_number``) is private, local, reserved or a group's."""
    ranges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in inner_ranges()])
    return F.when(number.isNotNull(), let(number, lambda n: F.exists(ranges, lambda r: (n >= r["a"]) & (n <= r["b"]))))


def in_ranges(points: DataFrame, ranges: DataFrame, number: str = "number", first: str = "first", last: str = "last") -> DataFrame:
    """``points`` with the other columns of the range that holds their number; null where none does.

    ``ranges`` are disjoint; both ends are numbers of ``ip_number``. Each range is known by the highest bytes it covers, so the
    join is one on equal bytes, of which a point has one: any number of ranges will do, and Spark may split a byte that many points share.
    """
    def top(c):
        return F.conv(F.substring(c, 1, 3), 16, 10).cast("int")

    others = [c for c in ranges.columns if c not in (first, last)]
    by_byte = ranges.withColumn("__top", F.explode(F.sequence(top(F.col(first)), top(F.col(last)))))
    right = by_byte.select("__top", F.col(first).alias("__first"), F.col(last).alias("__last"), *others)
    left = points.withColumn("__at", top(F.col(number)))
    on = (F.col("__at") == F.col("__top")) & F.col(number).between(F.col("__first"), F.col("__last"))
    return left.join(right, on, "left").drop("__at", "__top", "__first", "__last")


def _ascii_label(label: str) -> str | None:
    if label.isascii():
        return label
    try:
        return label.encode("idna").decode("ascii")
    except UnicodeError:
        return None


@F.pandas_udf(StringType())
def ascii_host(hosts: pd.Series) -> pd.Series:
    """Hosts with every label beyond ASCII folded and in Punycode; null where a label has no such form."""
    known: dict = {}

    def one(host):
        if host not in known:
            labels = [_ascii_label(x) for x in host.split(".")]
            known[host] = None if None in labels or any(not x.isascii() or "." in x for x in labels) else ".".join(labels)
        return known[host]

    return hosts.map(one, na_action="ignore")


def with_ascii_host(df: DataFrame, url: str, out: str) -> DataFrame:
    """``df`` with ``out``: the URL, its host in ASCII. A host without such a form stays, and is rejected later.

    Only rows with a host beyond ASCII pass through Python; the others never leave the JVM. ``df`` is read twice.
    """
    split = r"(?is)^(\s*[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?)([^/?#:]*)(.*)$"
    foreign = F.coalesce(F.regexp_extract(url, split, 2).rlike(r"[^\x00-\x7F]"), F.lit(False))
    named = df.where(foreign).withColumn("__p", F.struct(*[F.regexp_extract(url, split, k).alias(c) for k, c in ((1, "before"), (2, "host"), (3, "behind"))]))
    host = F.coalesce(ascii_host(F.lower(F.regexp_replace("__p.host", r"\.+$", ""))), F.col("__p.host"))
    named = named.withColumn(out, F.concat("__p.before", host, "__p.behind")).drop("__p")
    return df.where(~foreign).withColumn(out, F.col(url)).unionByName(named)
