"""Centroids, resampling and licence scans against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from siltstone.llm import centroids, licenses, resample
from siltstone.llm.oracle import ORACLE_SQL
from siltstone.llm.queries import QUERIES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_importance_resampling"])
def test_against_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(ORACLE_SQL[name])
    order = [[x[0] for x in found.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


# Centroids


def brute_clusters(rows, k, dim, scale, rounds, seed):
    """[(key, cluster, distance)] and centroids in Python's integers."""
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v):
            kept.append((key, [math.floor(scale * x) for x in v]))
    start = sorted((hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest(), v) for key, v in kept)[:k]
    cents = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(cents)]
    out = []
    for key, v in kept:
        d, i = near(v)
        out.append((key, i, d if d < 2**63 else None))
    return out, cents


def check_clusters(spark, rows, kind="double", k=5, dim=3, scale=64, rounds=3):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got, cents = centroids.cluster(df, k=k, dim=dim, scale=scale, rounds=rounds)
    wanted, cents_wanted = brute_clusters(rows, k, dim, scale, rounds, 1)
    assert cents == cents_wanted
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    return got


def test_clusters_with_ties_and_odd_rows(spark):
    r = random.Random(5)
    grid = [(i, [r.choice((0.0, 1.0, -1.0, 0.5)) for _ in range(3)]) for i in range(300)]  # many equal distances
    odd = [(None, [0.5, 0.5, 0.5]), (None, [0.25, 0.5, 0.5]), (7, None), (8, []), (9, [1.0, 2.0]), (10, [1.0, None, 2.0]), (11, [float("nan"), 0.0, 0.0]), (12, [float("inf"), 0.0, 0.0]), (13, [-0.0, -0.001, 0.001]), (3, grid[3][1]), (3, [9.0, 9.0, 9.0])]
    got = check_clusters(spark, grid + odd)
    total = {c: s for c, s in Counter(dict(got.groupBy("cluster").agg({"distance": "sum"}).collect())).items()}
    for row in centroids.inertia(got).collect():
        assert row["cluster_inertia"] == total[row["cluster"]] and row["inertia"] == sum(total.values())


def test_clusters_of_any_size_of_number(spark):
    """Components at which float32, float64 and 64-bit distances all give way."""
    r = random.Random(6)
    rows = [(i, [r.choice((1, -1)) * r.random() * 10.0 ** r.choice((0, 3, 6, 9, 15, 30, 200)) for _ in range(3)]) for i in range(200)]
    got = check_clusters(spark, rows)
    assert {x["inertia"] for x in centroids.inertia(got).collect()} == {None}
    near = [(i, [2.0**20 + i % 7 * 2.0**-6, 2.0**20 + i % 3 * 2.0**-6, 2.0**20]) for i in range(150)]  # told apart by no float32
    check_clusters(spark, near)
    check_clusters(spark, [(i, [float(i % 4), 1.0, 2.0]) for i in range(40)], kind="float")
    ints = spark.createDataFrame([(i, [i, 0, 1]) for i in range(9)], "vec_id long, embedding array<int>")
    assert centroids.cluster(ints, k=2, dim=3, scale=1)[0].count() == 9


def test_few_or_no_vectors(spark):
    check_clusters(spark, [(1, [0.0, 1.0, 2.0]), (2, [3.0, 1.0, 2.0])])
    check_clusters(spark, [(1, [0.5, 1.0, 2.0])] * 4)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, cluster string")
    got, cents = centroids.cluster(empty, dim=3)
    assert got.count() == 0 and cents == [] and centroids.inertia(got).count() == 0


def test_screen_keeps_the_nearest():
    """The nearest centroid is never screened out, however close the others are."""
    rng = np.random.default_rng(3)
    for spread in (1, 100, 10_000, 3_000_000):
        cents = [[int(x) for x in 10_000_000 + rng.integers(-spread, spread + 1, 64)] for _ in range(12)]
        x = (10_000_000 + rng.integers(-spread, spread + 1, (500, 64))).astype(np.float64)
        screen = centroids.Screen(cents)
        exact = np.array([[sum((int(a) - b) ** 2 for a, b in zip(v, c)) for c in cents] for v in x], dtype=object)
        assert screen.shortlist(x)[np.arange(len(x)), exact.argmin(axis=1)].all()
        _, cluster, distance = screen.nearest(x)
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    wide = centroids.Screen([[int(v) for v in rng.integers(-40, 41, 64)] for _ in range(16)])
    assert wide.shortlist(rng.integers(-40, 41, (2000, 64)).astype(np.float64)).sum(axis=1).mean() < 1.2  # the screen decides nearly all


# Resampling


def brute_scores(docs, target, n, buckets, percent, least, seed):
    def features(text):
        w = words(text)
        return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(f for _, x in docs for f in features(x)), Counter(f for x in target for f in features(x))
    ns, nt = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = {b: math.floor(1000 * math.log((float(t[b] + 1) * ns) / (float(s[b] + 1) * nt))) for b in range(buckets)}
    rows = []
    for key, x in docs:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    take = len(fit) * percent // 100
    rank = {id(r): k + 1 for k, r in enumerate(fit[:take])}
    return sorted(((*r, rank.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling(spark, monkeypatch, n):
    r = random.Random(n)
    vocabulary = ["red", "Green", "bläu", "x1", "word", "日本", "and"]
    texts = [" ".join(r.choice(vocabulary) + r.choice(["", ",", "!\n"]) for _ in range(r.randrange(0, 40))) for _ in range(120)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, texts[1] + " a b c d e f g"), (5, texts[5]), (5, texts[9]), (200, ""), (201, "...")]
    target = [texts[0], texts[7], None, ""]
    monkeypatch.setattr(resample, "STRETCH", 64)  # several stretches a text, tries that are emptied
    monkeypatch.setattr(resample, "NODES", 20)
    df = spark.createDataFrame([(a, b, 1, "s") for a, b in docs], "doc_id long, text string, score int, `a.b` string").repartition(3)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.importance(df, aim, n=n, buckets=50, percent=30, least=5)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_scores(docs, target, n, 50, 30, 5, 2024)
    drawn = resample.resample(df, aim, n=n, buckets=50, percent=30, least=5)
    assert sorted(x["rank"] for x in drawn.collect()) == list(range(1, drawn.count() + 1))
    assert drawn.select("document.*").columns == df.columns and drawn.where("document.`a.b` = 's'").count() == drawn.count()


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.importance(docs.limit(0), docs).count() == 0
    row = resample.importance(docs, docs.limit(0), least=1, percent=100).first()
    assert (row["n_features"], row["rank"]) == (3, 1) and row["weight"] < 0
    assert resample.importance(docs, docs, least=9).first()["rank"] is None


def test_stretches_lose_nothing(monkeypatch):
    monkeypatch.setattr(resample, "STRETCH", 10)
    text = b"one two  three " * 9 + b"a" * 35
    assert [w for p in resample.stretches(text) for w in p.split()] == text.split()


# Licences


def pattern(markup):
    """An independent reading: one regular expression over words with a blank behind each."""

    def literal(text):
        return "".join(re.escape(w.decode()) + " " for w in words(text))

    out = []
    for part in re.split(r"(<<.*?>>)", markup, flags=re.S):
        if part == "<<beginOptional>>":
            out.append("(?:")
        elif part == "<<endOptional>>":
            out.append(")?")
        elif part.startswith("<<var"):
            said = re.search(r'match="([^"]*)"', part)[1]
            count = re.fullmatch(r"\.\{(\d+),(\d+)\}", said)
            out.append(f"(?:\\S+ ){{{count[1]},{count[2]}}}" if count else "(?:" + "|".join(literal(x) for x in said.split("|")) + ")")
        else:
            out.append(literal(part))
    return re.compile("".join(out))


def brute_places(text, templates, phrases):
    """{(label, phrase, first, ends)}: all ends of all matches, from each place."""
    w = [x.decode() for x in words(text)]
    found = set()
    for is_phrase, rules in ((True, phrases), (False, templates)):
        for label, markup in rules:
            p = pattern(markup)
            for i in range(len(w)):
                ends = [j for j in range(i + 1, min(len(w), i + 400) + 1) if p.fullmatch("".join(x + " " for x in w[i:j]))]
                if ends:
                    found.add((label, is_phrase, i, max(ends)))
    return found


RULES = [
    ("x", 'grant <<beginOptional>>hereby <<beginOptional>>and now<<endOptional>> freely<<endOptional>> to <<var;name="n";original="o";match=".{1,3}">> the right'),
    ("y", 'made by <<var;name="n";original="o";match=".{0,2}">> for <<var;name="n";original="o";match="us|all of us|">> here'),
    ("z", "a a <<beginOptional>>here of<<endOptional>>"),
]


def test_template_automata(spark):
    r = random.Random(4)
    vocabulary = "grant hereby and now freely to the right made by for us all of here a b".split()
    texts = [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(150)]
    texts += ["Grant to Some, one the right", "grant hereby freely to x y z the right", "grant hereby and now freely to the the right", "grant to w x y z the right", "made by FOR here", "made by a b for all of us here", "a a a a here of", "", None, "...", "made by for"]
    df = spark.createDataFrame([(i, t, "v") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = licenses.scan(df, RULES, [("p", "to the"), ("q", "a a")]).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "licenses"}
    seen = set()
    for row in got:
        found = row["licenses"]["places"]
        wanted = brute_places(row["text"], RULES, [("p", "to the"), ("q", "a a")])
        assert {(p["label"], p["phrase"], p["first"], p["end"]) for p in found} == wanted and len(found) == len(wanted)
        covered = {k for _, _, a, b in wanted for k in range(a, b)}
        n = len(words(row["text"]))
        assert row["licenses"]["n_words"] == n and row["licenses"]["score"] == pytest.approx(len(covered) / n if n else 0)
        seen |= {x[0] for x in wanted}
    assert seen == {"x", "y", "z", "p", "q"}


def test_shipped_templates():
    """Each template accepts its own wording (optional parts in, replaceable ones as in the original), with other words around, and no text that lacks a word."""
    from siltstone.llm.license_templates import TEMPLATES

    for label, markup in TEMPLATES:
        plain = re.sub(r'<<var;name="[^"]*";original="([^"]*)";match="[^"]*">>', r" \1 ", markup).replace("<<beginOptional>>", " ").replace("<<endOptional>>", " ")
        t = licenses.Template(label, markup)
        w = words(plain)

        def accepted(some):
            text = b" some " + b" ".join(some) + b" more \n "
            return [n for _, _, n in licenses.places(text, [t])]

        assert accepted(w) == [len(w)], label
        assert accepted(words(re.sub("<<beginOptional>>.*?<<endOptional>>", " ", re.sub(r'<<var;name="[^"]*";original="([^"]*)";match="[^"]*">>', r" \1 ", markup), flags=re.S))), label
        mandatory = [i for i, x in enumerate(w) if i == 0 or i == len(t.lead.split()) - 1]
        for i in mandatory:
            assert not accepted(w[:i] + w[i + 1 :]), (label, w[i])


def test_broken_markup():
    for bad in ("<<endOptional>> x", "x <<beginOptional>> y", 'x <<var;name="a">> y', "", '<<var;name="a";original="b";match=".{1,2}">> x'):
        with pytest.raises(ValueError):
            licenses.Template("l", bad)


def test_op13(spark, small):
    from siltstone.llm.license_templates import PHRASES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op13_license_scan"](spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    labelled = 0
    for r in got:
        w = words(texts[r["doc_id"]])
        found = sorted((i, label) for label, phrase in PHRASES for i in range(len(w)) if w[i : i + len(words(phrase))] == words(phrase))
        base = sorted({x for _, x in found})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
        labelled += r["labels"] != ""
    assert labelled
