"""URL and domain functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import rules
from siltstone.functions.addresses import ip_number, is_inner
from siltstone.functions.binding import let

_LABELS = r"^(?!-)[a-z0-9-]{1,63}(?<!-)(\.(?!-)[a-z0-9-]{1,63}(?<!-))*$"


def _authority(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def _behind(text: Column, n: Column | int) -> Column:
    """What stands behind the first ``n`` characters."""
    return F.substr(text, n + 1 if isinstance(n, Column) else F.lit(n + 1))


def _clean(url: Column) -> Column:
    """Without blanks and control characters around it, and without line breaks and tabs."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    return F.when(url.rlike(r"[\x00-\x20]"), bare).otherwise(url)


def parts(url: Column) -> Column:
    """``struct(value, scheme, authority, path, query, fragment)`` of a URL or a relative reference; what is missing or empty is null, but for the path."""
    def third(p):
        slashes, none = p["rest"].startswith("//"), F.lit("")
        authority = F.when(slashes, F.substring_index(_behind(p["rest"], 2), "/", 1)).otherwise(none)
        path = F.when(slashes, _behind(p["rest"], F.length(authority) + 2)).otherwise(p["rest"])
        return F.struct(p["value"].alias("value"), F.nullif(F.lower(p["scheme"]), none).alias("scheme"), F.nullif(authority, none).alias("authority"), path.alias("path"), F.nullif(p["query"], none).alias("query"), F.nullif(p["fragment"], none).alias("fragment"))

    def second(p):
        head = F.substring_index(p["head"], "?", 1)
        scheme = F.when(head.contains(":"), F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).otherwise("")
        rest = F.when(scheme != "", _behind(head, F.length(scheme) + 1)).otherwise(head)
        return F.struct(p["value"].alias("value"), scheme.alias("scheme"), rest.alias("rest"), _behind(p["head"], F.length(head) + 1).alias("query"), p["fragment"].alias("fragment"))

    def first(value):
        head = F.substring_index(value, "#", 1)
        return F.struct(value.alias("value"), head.alias("head"), _behind(value, F.length(head) + 1).alias("fragment"))

    return let(let(let(_clean(url), first), second), third)


def _folded(path: Column, relative: Column) -> Column:
    """A path without dot segments. Segments are taken from left to right; ``..`` takes back one, if there is one.

    In a relative path that was put behind its folder, empty segments inside count for nothing.
    """
    def step(done, segment):
        back = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == "..", back).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    def fold(segments):
        folded = F.aggregate(segments, F.array().cast("array<string>"), step)
        closed = F.element_at(segments, -1).isin(".", "..")
        return F.array_join(F.when(closed, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")

    def packed(every):
        inner = F.filter(F.slice(every, 2, F.greatest(F.size(every) - 2, F.lit(0))), lambda x: x != "")
        return F.when(relative, F.concat(F.slice(every, 1, 1), inner, F.slice(every, -1, 1))).otherwise(every)

    odd = path.startswith(".") | path.contains("/.") | relative & path.contains("//")
    return F.when(odd, let(let(F.split(path, "/", -1), packed), fold)).otherwise(path)


def _merged(base: Column, path: Column) -> Column:
    """A path against that of its base: taken from the folder of ``base`` if it is relative, and without dot segments. What stands behind a ``;`` in the last segment is no part of it."""
    def whole(p):
        relative = ~p["path"].startswith("/")
        folder = F.substr(base, F.lit(1), F.length(base) - F.length(F.substring_index(base, "/", -1)))
        joined = F.when(relative, F.concat(F.when(folder == "", "/").otherwise(folder), p["path"])).otherwise(p["path"])
        return let(let(joined, lambda x: _folded(x, relative)), lambda x: F.concat(F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x)), p["last"]))

    last = F.substring_index(path, "/", -1)
    params = F.when(last.contains(";"), _behind(last, F.instr(last, ";") - 1)).otherwise("")
    return let(let(params, lambda x: F.struct(x.alias("last"), F.substr(path, F.lit(1), F.length(path) - F.length(x)).alias("path"))), whole)


def _resolved(base: Column, ref: Column, base_url: Column) -> Column:
    """A reference against its base, both as ``parts``."""
    def whole(authority, path, query):
        rooted = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
        return F.concat(base["scheme"], F.lit("://"), authority, rooted, F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""), F.when(ref["fragment"].isNotNull(), F.concat(F.lit("#"), ref["fragment"])).otherwise(""))

    return (
        F.when(ref["value"] == "", base_url)
        .when(ref["scheme"].isNotNull() & (ref["scheme"] != base["scheme"]), ref["value"])
        .when(ref["authority"].isNotNull(), whole(ref["authority"], ref["path"], ref["query"]))
        .when(ref["path"] == "", whole(base["authority"], base["path"], F.coalesce(ref["query"], base["query"])))
        .otherwise(whole(base["authority"], _merged(base["path"], ref["path"]), ref["query"]))
    )


def resolve(base: Column, ref: Column) -> Column:
    """The absolute form of a link on the page ``base``; a null on either side is null.

    A reference with a scheme of its own stays as it is, unless the scheme is the base's; one that is empty is the
    base. Empty queries and fragments are dropped. Each side is parsed once.
    """
    return let(F.struct(parts(base).alias("b"), parts(ref).alias("r")), lambda p: _resolved(p["b"], p["r"], base))


def with_resolved(df: DataFrame, base: str, ref: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``resolve`` of two of its columns."""
    return df.withColumn(out, resolve(F.col(base), F.col(ref)))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def hostname(url: Column) -> Column:
    """Lower-case host without credentials, port and trailing dots; empty if there is none."""
    host = F.regexp_replace(F.regexp_replace(_authority(url), "^.*@", ""), r"^(\[[^\]]*\]|[^:]*).*$", "$1")
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def path(url: Column) -> Column:
    """Path with single slashes and without a slash at its end; ``/`` if empty."""
    raw = F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    once = F.regexp_replace(raw, "/{2,}", "/")
    cut = F.regexp_replace(once, "/+$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def _known(url: Column) -> Column:
    """What rejection and normal form ask of a URL, each computed once."""
    return F.struct(F.trim(url).alias("value"), F.lower(F.trim(url)).alias("low"), scheme(url).alias("scheme"), _authority(url).alias("authority"), hostname(url).alias("host"), path(url).alias("path"), query(url).alias("query"))


def _rejection(u: Column) -> Column:
    host = u["host"]
    port = F.regexp_extract(F.regexp_replace(u["authority"], "^.*@", ""), r":([^:\]]*)$", 1)
    chain = F.when(F.coalesce(u["value"], F.lit("")) == "", "empty URL")
    for bad in ("javascript", "mailto", "tel", "data", "file", "ftp"):
        chain = chain.when(u["low"].startswith(f"{bad}:"), f"disallowed scheme: {bad}")
    address = F.when(host.startswith("[") | host.rlike(r"^[0-9.]+$"), ip_number(host))
    inner = "private/internal IP addresses are not allowed"
    return (
        chain.when(~u["scheme"].isin("http", "https"), F.concat(F.lit("unsupported scheme: "), F.when(u["scheme"] == "", "(none)").otherwise(u["scheme"])))
        .when(u["authority"].contains("@"), "credentials in URL are not allowed")
        .when(host == "", "malformed URL: missing host")
        .when((host == "localhost") | host.endswith(".localhost"), "localhost is not allowed")
        .when(host.startswith("[") | host.rlike(r"^[0-9.]+$"), let(address, lambda n: F.when(n.isNotNull(), F.when(is_inner(n), inner).otherwise("IP address literals are not allowed")).when(host.startswith("["), "malformed URL").otherwise(_name_rejection(host, port))))
        .otherwise(_name_rejection(host, port))
    )


def _name_rejection(host: Column, port: Column) -> Column:
    return (
        F.when(F.length(host) > 253, "malformed URL: host too long")
        .when(~host.contains("."), "malformed URL: host has no domain suffix")
        .when(F.substring_index(host, ".", -1).isin(rules.RESERVED_SUFFIXES), "private/internal hostnames are not allowed")
        .when(~host.rlike(_LABELS), "malformed URL: invalid host label")
        .when((port != "") & ~port.rlike(r"^\d{1,5}$"), "malformed URL")
    )


def rejection(url: Column) -> Column:
    """Why an absolute URL is not taken; null if it is. The first reason in order counts."""
    return let(_known(url), _rejection)


def normalize(url: Column, retain_query: bool = False) -> Column:
    """The canonical form of an absolute URL; null if it is rejected."""
    def form(u):
        port = F.regexp_extract(u["authority"], r":(\d+)$", 1)
        default = F.when(u["scheme"] == "http", "80").otherwise("443")
        authority = F.concat(u["host"], F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise(""))
        out = F.concat(u["scheme"], F.lit("://"), authority, u["path"])
        if retain_query:
            pairs = F.array_sort(F.filter(F.split(u["query"], "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(rules.TRACKING_PARAMS)))
            out = F.concat(out, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))
        return F.when(_rejection(u).isNull(), out)

    return let(_known(url), form)


def website(value: Column) -> Column:
    """Host of a bare or full address, without a leading ``www``; null if it is not a public host."""
    full = F.when(F.trim(value).rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), F.trim(value)).otherwise(F.concat(F.lit("https://"), F.trim(value)))
    return F.when(rejection(full).isNull() & (F.trim(value) != ""), F.regexp_replace(hostname(full), r"^www\.(?=.)", ""))


def website_error(host: Column) -> Column:
    """Why the host of a typed website is not taken; null if it is. Any scheme will do, and what stands around the host."""
    address = F.when(host.startswith("[") | host.rlike(r"^[0-9.]+$"), ip_number(host))
    return (
        F.when(host == "", "malformed host")
        .when((host == "localhost") | host.endswith(".localhost"), "localhost is not allowed")
        .when(address.isNotNull(), "IP addresses are not allowed")
        .when(F.length(host) > 253, "malformed host")
        .when(~host.contains(".") | F.substring_index(host, ".", -1).isin(rules.RESERVED_SUFFIXES), "private/internal hostnames are not allowed")
        .when(~host.rlike(_LABELS), "malformed host")
    )


def company_domain(value: Column) -> Column:
    """Lower-case host of whatever was typed, unchecked; null if nothing is left."""
    v = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z][a-z0-9+.-]*://", "")
    v = F.regexp_replace(F.regexp_replace(v, "[/?#:].*$", ""), r"^www\.", "")
    return F.nullif(F.regexp_replace(v, r"\.+$", ""), F.lit(""))


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three behind a compound suffix."""
    low = F.lower(host)
    two, three = F.substring_index(low, ".", -2), F.substring_index(low, ".", -3)
    return F.when(two.isin(rules.COMPOUND_SUFFIXES), three).otherwise(two)


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or hosts of one registrable domain; false for missing ones."""
    return F.coalesce((a != "") & (b != "") & (registrable_domain(a) == registrable_domain(b)), F.lit(False))


def redact_query(url: Column) -> Column:
    """The URL without parameters that carry personal tokens; order and fragment stay."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(rules.REDACTED_PARAMS))
    head, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(query(url) == "", url).otherwise(F.concat(head, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), tail))


def robots_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(_authority(url)), F.lit("/robots.txt"))


def excluded_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([^?#]*)", 1)).rlike(rf"\.({'|'.join(rules.EXCLUDED_EXTENSIONS)})$")


def fallback_name(host: Column) -> Column:
    """A name from the second last label."""
    label = F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    return F.initcap(F.regexp_replace(label, "[-_]+", " "))


def tld_country(host: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.TLD_COUNTRIES.items() for x in pair])
    return F.when(host.contains("."), table[F.lower(F.substring_index(host, ".", -1))])
