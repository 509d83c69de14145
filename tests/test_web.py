"""URLs, hosts, bodies, sitemaps and as-of joins against the standard library or brute force."""

import codecs
import ipaddress
import json
import random
from datetime import datetime, timedelta
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import addresses, canonical, text, urls
from siltstone.operators import asof, discovery

#: Section 5.4 of RFC 3986 over http://a/b/c/d;p?q: normal and abnormal references and what they come to.
EXAMPLES = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"),
    ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"), (";x", "http://a/b/c/;x"), ("g;x", "http://a/b/c/g;x"), ("g;x?y#s", "http://a/b/c/g;x?y#s"),
    ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../", "http://a/"),
    ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("../../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"),
    ("g..", "http://a/b/c/g.."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"),
    ("g;x=1/./y", "http://a/b/c/g;x=1/y"), ("g;x=1/../y", "http://a/b/c/y"), ("g?y/./x", "http://a/b/c/g?y/./x"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("g#s/./x", "http://a/b/c/g#s/./x"),
    ("g#s/../x", "http://a/b/c/g#s/../x"), ("http:g", "http://a/b/c/g"),
]


def test_references(spark):
    r = random.Random(1)
    segments = ["..", ".", "a", "b;p", "", "c.d", "..;x", "é"]

    def path(most):
        return "/".join(r.choice(segments) for _ in range(r.randrange(most)))

    rows = [("http://a/b/c/d;p?q", ref, want) for ref, want in EXAMPLES]
    bases = ["http://a", "http://a/", "https://h.co/b//c", "http://h/x/../y/", "http://h.co?q=1", "http://h.co/a/b/#f"]
    pairs = [(b, ref) for b in bases for ref in [x for x, _ in EXAMPLES] + ["//", "///x", " ../x\n", "a\tb"]]
    pairs += [(f"http://h.co/{path(6)}", ("/" if r.random() < 0.3 else "") + path(7) + r.choice(["", "?q=/../x", "#f"])) for _ in range(400)]
    rows += [(b, ref, urljoin(b, ref.strip())) for b, ref in pairs] + [(None, "a", None), ("http://a/", None, None)]
    df = spark.createDataFrame(rows, "base string, ref string, want string")
    got = urls.with_resolved(df, "base", "ref", "got").withColumn("alone", urls.resolve(F.col("base"), F.col("ref")))
    assert [x for x in got.collect() if not x["got"] == x["alone"] == x["want"]] == []


def inner(a):
    return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified


def test_ip_literals(spark):
    r = random.Random(2)
    hosts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "::", "::1", "[::1]", "1::", "fe80::1%eth0", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:7", "12345::", ":::", "1::2::3", "::1.2.3.256"]
    hosts += ["1:2:3:4:5:6:1.2.3.4", "a.co", "192.0.0.9", "192.0.0.8", "2001:1::1", "2001:1::3", "10.0.0.1", ":1", "1:", "", "1.2.3", "100.64.0.1", "fec0::1", "2001:20::", "2001:1f:ffff::"]
    for _ in range(300):
        hosts.append(str(ipaddress.ip_address(r.getrandbits(32))))
        a = ipaddress.IPv6Address(r.getrandbits(128) & r.choice([2**128 - 1, 2**112 - 1]) | (r.choice([0, 0x2001, 0xFE80, 0xFC00, 0x2600]) << 112))
        hosts.append(r.choice([str(a), a.exploded, f"[{a}]", str(a).upper()]))
    df = spark.createDataFrame([(h,) for h in hosts] + [(None,)], "host string").withColumn("number", addresses.ip_number(F.col("host"))).withColumn("inner", addresses.is_inner(F.col("number")))
    ranges = spark.createDataFrame(addresses.inner_ranges(), "first string, last string").withColumn("found", F.lit(True))
    seen = 0
    for x in addresses.in_ranges(df, ranges).collect():
        try:
            a = ipaddress.ip_address((x["host"] or "").strip("[]"))
        except ValueError:
            assert (x["number"], x["inner"], x["found"]) == (None, None, None), x
            continue
        seen += 1
        assert x["number"] == f"{a.version}{int(a):032x}" and x["inner"] == inner(a) and bool(x["found"]) == inner(a), x
    assert seen > 600


def test_rejected_addresses(spark):
    rows = [("http://10.0.0.1/", "private/internal IP addresses are not allowed"), ("http://8.8.8.8/", "IP address literals are not allowed"), ("http://[::1]:80/", "private/internal IP addresses are not allowed"),
            ("http://[2606:4700::1]/x", "IP address literals are not allowed"), ("http://[::g]/", "malformed URL"), ("http://100.64.0.1/", "IP address literals are not allowed"), ("http://999.1.1.1/", None)]
    df = spark.createDataFrame(rows, "url string, why string")
    assert [(x["url"], x["got"]) for x in df.withColumn("got", urls.rejection(F.col("url"))).collect()] == rows


def test_hosts_beyond_ascii(spark):
    r = random.Random(3)
    labels = ["münchen", "Bücher", "faß", "日本語", "пример", "a-b", "ελλάδα", "xn--mnchen-3ya", "ÅNGSTRÖM", "ii̇", "-ü", "ü" * 70, "‍x", "مثال"]
    rows = [(f"http://{'.'.join(r.choice(labels) for _ in range(r.randrange(1, 4)))}.de:8080/p?é#f",) for _ in range(200)] + [(None,), ("no url",), ("http://user:pw@bücher.de/x",), ("HTTP://日本。jp/",)]
    df = spark.createDataFrame(rows, "u string")

    def want(u):
        head, _, rest = (u or "").partition("://")
        host = rest.split("/")[0].split("@")[-1].split(":")[0]
        if u is None or host.isascii():
            return u
        try:
            made = [x if x.isascii() else x.encode("idna").decode() for x in host.lower().split(".")]
        except UnicodeError:
            return u
        return u if any("." in x for x in made) else u.replace(host, ".".join(made), 1)

    got = addresses.with_ascii_host(df, "u", "v").collect()
    assert len(got) == len(rows) and [x for x in got if x["v"] != want(x["u"])] == []
    plan = addresses.with_ascii_host(df, "u", "v")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def reference_decoding(body, header):
    """(text, replaced, late) as a strict decoding, then one that replaces."""
    import re

    m = re.search(r"charset=([\w-]+)", header or "", re.I)
    name = m[1] if m else "utf-8-sig" if body.startswith(b"\xef\xbb\xbf") else "utf-16" if body[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"
    try:
        codecs.lookup(name)
    except LookupError:
        name = "utf-8"
    try:
        return body.decode(name), False, False
    except UnicodeDecodeError as e:
        return body.decode(name, "replace"), True, e.start >= len(body) - 8


@pytest.mark.parametrize("seed", range(2))
def test_decoding(spark, seed):
    r = random.Random(seed)
    said = "Grüße an alle, 日本語 and 😀 ends. Привет"
    rows = [(b, None) for b in (b"\xff\xfea", b"\xff\xfe\x00\xd8", b"\xff\xfe\x00\xd8x", b"\xfe\xff\xdc\x00\x00a", b"\xff\xfe", b"\xef\xbb\xbfab\xc3", b"\xe2\x82", b"ab\xf0\x9f\x98", b"\xff\xfe\x3d\xd8\x3d\xd8\x00\xde")]
    for name in ["utf-8", "utf-16", "utf-16le", "utf-16-be", "windows-1252", "cp1251", "iso-8859-7", "iso-8859-15", "koi8-r", "us-ascii", "latin-1", "shift_jis", "gb18030", "euc-kr", "no-such-charset"]:
        known = name if name != "no-such-charset" else "utf-8"
        whole = said.encode(known, "ignore")
        rows.append((whole, f"text/html; charset={name}"))
        for _ in range(12):
            b = bytearray(whole)
            for _ in range(r.randrange(4)):
                b[r.randrange(len(b))] = r.randrange(256)
            b = bytes(b[: r.randrange(1, len(b) + 1)])
            rows.append((b, f"text/html; Charset={name}"))
            rows.append((bytes(r.randrange(256) for _ in range(r.randrange(1, 20))), f"text/html; charset={name}"))
    signs = (b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"%PDF", b"PK", b"MZ", b"\x7fELF")
    rows = [(i, b, h) for i, (b, h) in enumerate(rows) if not b.startswith(signs)]
    df = spark.createDataFrame(rows, "k int, body binary, kind string")
    for x in text.decoded(df, "body", "kind").collect():
        html, replaced, late = reference_decoding(bytes(x["body"]), x["kind"])
        d = x["decoded"]
        assert d["error"] is None
        assert (d["html"], d["replaced"], d["truncated"]) == (html.removeprefix("﻿"), replaced, late), (x, html)


def test_canonical_json(spark):
    r = random.Random(4)
    kind = T.StructType().add("zeta", T.StringType()).add("a", T.ArrayType(T.StringType())).add("n", T.LongType()).add("x", T.DoubleType()).add("b", T.BooleanType()).add("m", T.MapType(T.StringType(), T.DoubleType())).add("s", T.StructType().add("y", T.IntegerType()).add("B", T.ArrayType(T.DoubleType())))
    odd = ["", "plain", 'q"b\\', "tab\tnl\ncr\rbs\bff\f", "\x00\x1f\x7f", "é ü", "😀 x", " ", "/slash", "~}|{ ", "日本", None]
    numbers = [0.0, -0.0, 1.0, 10.0, 0.5, 1e16, 1e15, 123456789012345680.0, 1e22, 1.5e300, 0.0001, 0.00001, 1.25e-7, -3.75, 100.0, 12345.678, 1e-300, float("inf"), float("-inf"), None]
    rows = [({"zeta": r.choice(odd), "a": [r.choice(odd) for _ in range(r.randrange(4))] if r.random() < 0.9 else None, "n": r.choice([0, -5, 2**53 + 1, None]), "x": v, "b": r.choice([True, False, None]),
              "m": {k: r.choice(numbers) for k in r.sample(["k", "é", "A"], r.randrange(3))}, "s": r.choice([None, {"y": 1, "B": [v, 2.0]}])},) for v in numbers * 6]
    df = spark.createDataFrame(rows, T.StructType().add("v", kind))
    got = df.select("v", canonical.json_text(F.col("v"), kind).alias("j")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["j"] == json.dumps(x["v"].asDict(recursive=True), sort_keys=True)


def test_as_of(spark):
    r = random.Random(5)
    t0 = datetime(2024, 1, 1)
    times = [t0 + timedelta(hours=r.randrange(200), seconds=r.choice([0, 0, 1])) for _ in range(60)]
    right = [(r.choice(["a", "a", "a", "b", None]), r.choice([*times, None]), i, f"v{i}") for i in range(150)]
    left = [(i, r.choice(["a", "a", "b", "c", None]), r.choice([*times, None, t0 - timedelta(days=9), t0 + timedelta(days=99)]), i % 3) for i in range(150)]
    lf = spark.createDataFrame(left, "id int, k string, at timestamp, rank int")
    rf = spark.createDataFrame(right, "k string, seen timestamp, page int, v string")
    for inclusive in (False, True):
        for seconds in (3600, 86_400 * 30):
            got = {x["id"]: (x["page"], x["v"]) for x in asof.latest_before(lf, rf, ["k"], ["page", "v"], "at", "seen", "page", seconds, inclusive).collect()}
            for i, k, at, _ in left:
                found = [(t, n, v) for kk, t, n, v in right if k is not None and kk == k and t is not None and at is not None and (t < at or inclusive and t == at)]
                assert got[i] == (max(found)[1:] if found else (None, None))
            assert len(got) == len(left)
    assert asof.latest_before(lf.limit(0), rf, ["k"], ["v"], "at", "seen", "page").count() == 0
    assert asof.latest_before(lf, rf.limit(0), ["k"], ["v"], "at", "seen", "page").where("v is null").count() == len(left)


def brute_sitemaps(roots, edges, depth, files):
    children = {}
    for parent, child, n in sorted(edges, key=lambda e: (e[0], e[2], e[1])):
        children.setdefault(parent, []).append(child)
    out = set()
    for run in {r for r, _, _ in roots}:
        queue = [(u, 0) for _, u, _ in sorted((r for r in roots if r[0] == run), key=lambda r: (r[2], r[1]))]
        seen = []
        while queue and len(seen) < files:
            u, d = queue.pop(0)
            if u in seen or d > depth:
                continue
            seen.append(u)
            out.add((run, u, d, len(seen)))
            queue += [(c, d + 1) for c in children.get(u, [])]
    return out


def test_sitemap_search(spark):
    r = random.Random(6)
    edges = [(f"u{r.randrange(60)}", f"u{r.randrange(60)}", i) for i in range(200)]
    roots = [(run, f"u{r.randrange(60)}", n) for run in range(6) for n in range(3)] + [(9, "none", 0)]
    rf, ef = spark.createDataFrame(roots, "run int, url string, ord int"), spark.createDataFrame(edges, "parent string, child string, ord int")
    for depth, files in ((5, 50), (2, 50), (5, 7), (0, 2)):
        assert set(map(tuple, discovery.sitemap_search(rf, ef, depth, files).select("run", "url", "depth", "position").collect())) == brute_sitemaps(roots, edges, depth, files)
    assert discovery.sitemap_search(rf.limit(0), ef).count() == 0
