"""The operators against brute force on small fixtures, and their defined cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

WORD1 = re.compile("[^\x20\x09-\x0d]+")
WORD9 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, ord string, n string, id string"


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def make(spark, rows, schema=SCHEMA):
    """Documents with extra columns whose names clash with inner ones."""
    width = schema.count(",") + 1
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * (width - 5)) for i, t in rows], schema)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, nulls, empty, repeated and very long texts."""
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeioérst") for _ in range(r.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(vocab) for _ in range(n))

    passage = prose(60)
    rows = [(0, None), (1, ""), (2, "   "), (3, "one two"), (4, "One TWO"), (5, "one two three"), (6, prose(30_000))]
    base = prose(120)
    for k in range(10, 40):
        words = base.split()
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((k, " ".join(words)))
    rows += [(k, base) for k in range(40, 50)]
    rows += [(k, f"{prose(50)} {passage} {prose(20)}") for k in range(50, 70)]
    rows += [(k, prose(r.randint(1, 200))) for k in range(70, 110)]
    rows.append((110, "日本語テスト " * 30 + "x"))
    rows.append((70, rows[-30][1]))
    return rows


EMPTY = []


def test_words_across_rows():
    from siltstone.llm.textbytes import Words, lut

    w = Words(pa.array(["ab cd", None, "", "ef", " gh"]), lut(lambda b: b > 32))
    assert w.counts.tolist() == [2, 0, 0, 1, 1]
    assert len(set(w.hashes.tolist())) == 4
    again = Words(pa.array(["x", "ef gh AB cd"]), lut(lambda b: b > 32))
    assert again.hashes.tolist()[1:] == [w.hashes[2], w.hashes[3], w.hashes[0], w.hashes[1]]


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = WORD1.findall(fold(t))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def test_near_duplicates(spark, corpus):
    from siltstone.llm.neardup import link

    got = link(make(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert {tuple(r) for r in got} == brute_components(corpus)
    assert link(make(spark, EMPTY)).count() == 0


def test_densified_bands_agree_with_similarity():
    from siltstone.llm.neardup import BANDS, bands

    rng = np.random.default_rng(0)
    assert len(bands(np.array([5], np.uint64))) == BANDS
    missed = 0
    for n in (8, 40, 400):
        for _ in range(60):
            both = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
            cut = max(1, n // 8)
            a, b = np.sort(both[cut:]), np.sort(both[: n - cut])
            missed += not (bands(a) == bands(b)).any()
    assert missed == 0


def test_components_of_chain_and_star(spark):
    from siltstone.llm.components import connected_components

    edges = [(k, k + 1) for k in range(100, 130)] + [(1, k) for k in range(2, 30)] + [(7, 7)]
    got = {(r["node"], r["root"]) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 100) for k in range(100, 131)} | {(k, 1) for k in range(1, 30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, corpus):
    from siltstone.llm.sharding import shard

    got = shard(make(spark, corpus)).collect()
    assert len(got) == len(corpus)
    sizes = Counter(r["shard"] for r in got)
    assert set(range(16)) >= set(sizes) and max(sizes.values()) - min(sizes.get(k, 0) for k in range(16)) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    assert shard(make(spark, EMPTY)).count() == 0


def test_sharding_of_a_hot_key(spark, monkeypatch):
    from siltstone.llm import sharding

    monkeypatch.setattr(sharding, "CHUNK", 7)
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 5, id) as doc_id", "if(id % 6 = 0, 'same', string(id)) as text")
    for slack in (0.0, 0.25):
        got = sharding.shard(docs, 16, slack=slack).collect()
        sizes = Counter(r["shard"] for r in got)
        assert len(got) == 3000 and (slack or max(sizes.values()) - min(sizes[k] for k in range(16)) <= 1)
        for k in sizes:
            assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
        expected = Counter((r["doc_id"], len(r["text"]) + 1, zlib.crc32(r["text"].encode())) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected


def test_sharding_moves_little(spark):
    from siltstone.llm.sharding import shard

    docs = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    # The law of the query: counts as even as can be, and still few rows move.
    a, b = ({r["doc_id"]: r["shard"] for r in shard(docs, n).collect()} for n in (16, 17))
    assert sum(a[k] != b[k] for k in a) < 4000 * 0.25
    a = {r["doc_id"]: r["shard"] for r in shard(docs, 8, slack=0.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in shard(docs, 9, slack=0.25).collect()}
    assert max(Counter(a.values()).values()) <= 4000 / 8 * 1.25 + 1
    assert sum(a[k] != b[k] for k in a) < 4000 * 0.35


@pytest.mark.parametrize("crowd", [4000, 2])
def test_repeated_strings(spark, corpus, crowd, monkeypatch):
    from siltstone.llm import repeats

    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = sorted({i: t for i, t in corpus}.items())
    got = {r["doc_id"]: r for r in repeats.cut_repeats(make(spark, rows)).collect()}
    seen = set()
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            s = data[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) == (len(data), sum(gone), spans, kept)
    assert repeats.cut_repeats(make(spark, EMPTY)).count() == 0


def test_repeated_strings_with_shared_keys(spark):
    from siltstone.llm.repeats import cut_repeats

    r = random.Random(1)
    text = "".join(r.choice("abcdef ") for _ in range(300))
    got = cut_repeats(make(spark, [(5, text), (5, text), (None, text)])).collect()
    assert sorted(x["n_removed"] for x in got) == [0, 300, 300]
    assert [x["n_removed"] for x in cut_repeats(make(spark, [(1, "b" * 300)])).collect()] == [299]


def test_suffix_array():
    from siltstone.llm import suffixes

    rng = np.random.default_rng(1)
    for n, k, wide in itertools.product((1, 2, 9, 60, 300), (1, 2, 5, 200), (3, 4096)):
        suffixes.WIDEST = wide
        t = rng.integers(0, k, n)
        sa = suffixes.suffix_array(t)
        assert sa.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        shared = suffixes.common_prefixes(t, sa, 50)
        for a, b in itertools.pairwise(sa.tolist()):
            x = next((i for i in range(50) if a + i >= n or b + i >= n or t[a + i] != t[b + i]), 50)
            assert shared[b] == x
    suffixes.WIDEST = 4096


def test_decontamination(spark, corpus):
    from siltstone.llm.decontaminate import contamination

    texts = dict(corpus)
    items = [(1, " ".join(texts[50].split()[45:80])), (2, "One, two!"), (3, None), (4, "..."), (12, texts[10]), (7, " ".join(texts[50].split()[45:80]))]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, uid string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in contamination(make(spark, corpus), table).collect())
    wins = {}
    for i, t in items:
        w = WORD9.findall(fold(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    expected = Counter()
    for i, t in corpus:
        w, hit, names = WORD9.findall(fold(t)), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit.update(range(k, k + size))
                    names |= wins[tuple(w[k : k + size])]
        expected[(i, len(w), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert got == expected
    assert contamination(make(spark, EMPTY), table).count() == 0
    assert contamination(make(spark, corpus[:3]), table.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    from siltstone.llm.decontaminate import build_index, item_terms, phrase_matches, windows

    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "red green blue"), (2, "green red blue"), (3, "red red blue")], "doc_id long, text string")
    terms = item_terms(items)
    index = build_index(docs, terms)
    uid = {r["uid"]: r["id"] for r in index.collect()}
    assert {uid[r["uid"]] for r in phrase_matches(index, windows(terms)).collect()} == {1}
    assert {uid[r["uid"]] for r in phrase_matches(index, windows(terms), slop=2).collect()} == {1, 2}


def test_proximity_with_foreign_words(spark):
    """Against brute force, with words inside the matches that no item has."""
    from siltstone.llm.decontaminate import build_index, item_terms, phrase_matches, windows

    rng = random.Random(5)
    item = [f"w{k}" for k in range(13)]
    rows = [(1, [*item[:6], "foreign", *item[6:]]), (2, item), (3, [*item[:6], "foreign", "words", *item[6:]]), (4, item[:12])]
    for i in range(5, 45):
        words = list(item)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = [rng.choice(["foreign", "w3", "other"])]
        rows.append((i, ["before"] * rng.randrange(3) + words))
    items = spark.createDataFrame([(1, " ".join(item)), (2, "w3 w9 short")], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    terms = item_terms(items)
    often = Counter(w for _, words in rows for w in words)
    for slop in (0, 1, 2):
        index = build_index(docs, terms, slop=slop)
        ids = {r["uid"]: r["id"] for r in index.collect()}
        got = Counter((ids[r["uid"]], r["place"], r["length"]) for r in phrase_matches(index, windows(terms), slop).collect())
        expected = Counter()
        for window in (item, ["w3", "w9", "short"]):
            at = min(range(len(window)), key=lambda o: (often[window[o]], o))
            for i, words in rows:
                for p in (k - at for k, w in enumerate(words) if w == window[at]):
                    if p >= -slop and all(w in words[max(0, p + o - slop) : max(0, p + o + slop + 1)] for o, w in enumerate(window)):
                        expected[(i, p, len(window))] += 1
        assert got == expected
        assert slop == 0 or any(i == 1 for i, _, _ in got)


def test_search(spark, corpus, monkeypatch):
    import math

    from siltstone.llm import search

    monkeypatch.setattr(search, "SHARD_DOCS", 40)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rows = sorted({i: t for i, t in corpus}.items())
    docs = make(spark, rows)
    bags = {i: Counter(WORD9.findall(fold(t))) for i, t in rows}
    n, length = len(bags), {i: sum(b.values()) for i, b in bags.items()}
    mean = sum(length.values()) / n
    df = Counter(t for b in bags.values() for t in b)
    got = search.top_k(docs, docs.where("doc_id % 20 == 0"), 5).collect()
    for q in [i for i in bags if i % 20 == 0]:
        scores = []
        for i, b in bags.items():
            s = sum(m * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for t, m in bags[q].items() if t in b)
            if s > 0:
                scores.append((-round(s, 6), i))
        assert [r["doc_id"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [i for _, i in sorted(scores)[:5]]


def test_search_copies_and_shards(spark, monkeypatch):
    """Copies are one document of an index, shards are sized by postings, many blocks and ties between near copies."""
    import math
    import random

    from siltstone.llm import search

    for name, value in {"SHARD_POSTINGS": 150, "BLOCK": 4, "TOGETHER": 3, "EXPANDED": 40, "QUERY_ENTRIES": 60, "SPREAD": 2, "SAMPLE": 30}.items():
        monkeypatch.setattr(search, name, value)
    rng = random.Random(3)
    words = [[f"{c}{i}" for i in range(60)] for c in "xyz"]
    texts = [" ".join(rng.choices(words[i % 3], weights=[1 / (j + 1) for j in range(60)], k=rng.choice((3, 12, 40)))) for i in range(70)]
    texts += ["x1 x2 x3 same"] * 30 + [f"y1 y2 y3 near{i}" for i in range(30)] + ["", None]
    rows = list(zip(rng.sample(range(400), len(texts)), texts, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bags = {i: Counter(WORD9.findall(fold(t or ""))) for i, t in rows}
    n, length = len(bags), {i: sum(b.values()) for i, b in bags.items()}
    mean, df = sum(length.values()) / n, Counter(t for b in bags.values() for t in b)
    made = []
    build = search.build_shards
    monkeypatch.setattr(search, "build_shards", lambda *a: made.append(t := build(*a)) or made.append((t.count(), t.agg({"shard": "max"}).first()[0], sum(len(r["bags"]) for r in t.select("bags").collect()))) or t)
    got = {}
    for r in search.top_k(docs, docs.where("doc_id % 3 = 0"), 4).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert made[1][0] > 5 and made[1][2] == len({frozenset(b.items()) for b in bags.values() if b})
    for q in [i for i in bags if i % 3 == 0]:
        scores = []
        for i, b in bags.items():
            s = sum(m * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for t, m in bags[q].items() if t in b)
            if s > 0:
                scores.append((-round(s, 6), i))
        assert [(i, d) for i, d, _ in sorted(got.get(q, []))] == [(j + 1, d) for j, (_, d) in enumerate(sorted(scores)[:4])]


def test_search_of_a_shard(monkeypatch):
    """A shard's best, for queries near and far, with dense rows for some terms, all or none, equal all scores; what is tried first is at most the k-th of them."""
    import numpy as np

    from siltstone.llm import search

    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(7)
    names = np.unique(rng.integers(-(2**63), 2**63 - 1, 400))
    rates = np.minimum(1, 6 / np.arange(1, len(names) + 1))
    counts = rng.poisson(rates * rng.choice([0.3, 1, 9], (90, 1)), (90, len(names)))
    counts[:, 0] += counts.sum(axis=1) == 0
    counts[5] = counts[17]
    lists = [np.flatnonzero(c) for c in counts]
    n, average, k = counts.sum(axis=1), counts.sum() / len(counts), 4
    made = search.Index.sort(n, np.array([len(x) for x in lists]), np.concatenate([names[x] for x in lists]), np.concatenate([c[x] for c, x in zip(counts, lists, strict=True)]))
    weight = np.log1p(1 / np.linspace(0.5, 0.01, len(names)))
    asked = [*lists[:40], np.array([], np.int64)]
    loads = [*(counts[i][x] * weight[x] for i, x in enumerate(lists[:40])), np.zeros(0)]
    vocabulary, which = np.unique(np.concatenate([names[x] for x in asked] + [names[:1] + 1]), return_inverse=True)
    query = vocabulary, which[:-1], np.concatenate(loads), np.array([len(x) for x in asked])
    impact = counts * 2.2 / (counts + 1.2 * (0.25 + 0.75 * n / average)[:, None])
    scores = np.array([np.round(impact[:, x] @ w, 6) for x, w in zip(asked, loads, strict=True)])
    kth = np.sort(scores, axis=1)[:, -k]
    for denser, together, near in ((350, 512, True), (350, 7, False), (0, 512, True), (1e9, 3, False)):
        monkeypatch.setattr(search, "DENSER", denser)
        monkeypatch.setattr(search, "TOGETHER", together)
        index = search.Index(*made, average)
        place = np.argsort(n, kind="stable")
        floors, rough = np.zeros(len(asked)), np.zeros((len(asked), k))
        index.search(*query, floors, k, rough=rough)
        assert np.all(floors <= kth) and np.allclose(floors, kth, atol=1e-2)
        for start in (np.zeros(len(asked)), floors):
            got = index.search(*query, start, k, near)
            for q in range(len(asked)):
                best = sorted((-s, int(d)) for d, s in enumerate(scores[q]) if s > 0)[:k]
                mine = sorted((-s, int(place[d])) for d, s in zip(got[1][got[0] == q], got[2][got[0] == q], strict=True))
                assert [d for _, d in mine] == [d for _, d in best] and np.allclose([s for s, _ in mine], [s for s, _ in best], atol=2e-6)


def test_byte_bpe(spark, corpus):
    import base64

    import public_tokenizers as P
    import tiktoken

    from siltstone.llm.bpe import encode_decode

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["it's  'LL \n\t x", "é́🙂 日本", "\x1c\x85\xa0a", "a" * 300, "  lead", "trail  ", "<|endoftext|>"]
    rows = corpus + [(200 + k, t) for k, t in enumerate(odd)]
    got = encode_decode(make(spark, rows), path, P.PATTERN).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_text"]) for r in got) == Counter((i, tuple(true.encode_ordinary(t or "")), t or "") for i, t in rows)
    r = next(r for r in got if r["doc_id"] == 201)
    assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    assert encode_decode(make(spark, EMPTY), path, P.PATTERN).count() == 0


def test_streaming_decode():
    from siltstone.llm.bpe import Utf8Machine

    machine = Utf8Machine({k: bytes((k,)) for k in range(256)})
    text = "a é 日 🙂"
    assert "".join(machine.stream(list(text.encode()))) == text
    for data in (b"\xff a", b"\xe6\x97", b"\xc3(", b"\xed\xa0\x80"):
        assert machine.decode(list(data)).encode("utf-8", "strict").count("�".encode()) >= 1


def test_token_files(spark, corpus):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from siltstone.llm.tokenstore import _checksum, open_file, read_files, write_files

    path = P.path("word_bpe_49k.json")
    true = Tokenizer.from_file(path)
    rows = sorted({i: t for i, t in corpus}.items())
    files = write_files(make(spark, rows), path, 1)
    got = sorted(map(tuple, read_files(files, _checksum, "ids_crc32 long", "bigint").collect()))
    at, expected, everything = 0, [], []
    for i, t in rows:
        ids = true.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        everything += ids
    assert got == expected
    row = files.orderBy("part", "seq").first()
    _, matrix = open_file(row["payload"])
    mine = everything[: row["n_tokens"]]
    token = Counter(mine).most_common(1)[0][0]
    assert matrix.count(token) == mine.count(token)
    assert matrix.occurrence(token, 3) == [k for k, x in enumerate(mine) if x == token][3]
    assert [matrix.access(k) for k in range(20)] == mine[:20]
    assert read_files(write_files(make(spark, EMPTY), path, 1), _checksum, "ids_crc32 long", "bigint").count() == 0


def test_crf_against_all_paths():
    from siltstone.llm.crf import Crf

    rng = np.random.default_rng(2)
    for n, k in itertools.product((1, 3, 6), (2, 3)):
        crf = Crf(np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k))
        unary, first = rng.normal(size=(n, k)), np.zeros(n, np.bool_)
        first[0] = True
        weight = {y: np.exp(crf.start[y[0]] + sum(unary[i, y[i]] for i in range(n)) + sum(crf.trans[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product(range(k), repeat=n)}
        p = np.array([[sum(w for y, w in weight.items() if y[i] == j) for j in range(k)] for i in range(n)]) / sum(weight.values())
        assert np.allclose(crf.marginals(unary, first), p)
        assert tuple(crf.viterbi(unary, first)) == max(weight, key=weight.get)


def test_toxicity(spark):
    from siltstone.llm.toxicity import learn, tag

    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeiorst") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(300):
        words = [r.choice(vocab) for _ in range(40)]
        bad = k % 3 == 0
        for _ in range(3 if bad else 0):
            words[r.randrange(40)] = r.choice(["vilezz", "nastyqq", "grimxx"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    rows += [(900, None), (901, ""), (900, None)]
    docs = make(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = learn(docs, table)
    got = tag(docs, model).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in labels}
    assert np.mean([(r["tox_score"] >= 0.5) == truth.get(r["doc_id"], 0) for r in got]) > 0.98
    marked = [r["text"][s["start"] : s["end"]] for r in got for s in r["tox_spans"] or []]
    assert marked and all(any(b in m for b in ("vilezz", "nastyqq", "grimxx")) for m in marked)
    assert tag(docs, learn(docs, table.limit(0))).where("tox_score > 0").count() == 0
    assert tag(make(spark, EMPTY), model).count() == 0


def test_language_id(spark):
    import public_tokenizers as P

    from siltstone.llm.langid import classify, fit, vocabulary

    path = P.path("piece_bpe_32k.model")
    english = "the house is near the river and the children are playing in the garden with their friends"
    german = "das haus steht am fluss und die kinder spielen im garten mit ihren freunden und nachbarn"
    model = fit([english] * 3 + [german] * 3, ["en"] * 3 + ["de"] * 3, vocabulary(path))
    rows = [(1, "The children are in the house"), (2, "die kinder sind im haus"), (3, None), (4, "123 !!"), (5, ""), (6, "THE RIVER" * 50)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in classify(make(spark, rows), model, path).collect()}
    assert [got[k][0] for k in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in classify(make(spark, rows), ([], np.zeros((1, 0))), path).collect()} == {"und"}


def test_language_forward_sums_all_segmentations():
    import public_tokenizers as P

    from siltstone.llm.langid import distinct_words, vocabulary, word_logs

    vocab = vocabulary(P.path("piece_bpe_32k.model"))
    probs = np.random.default_rng(0).random((vocab.n, 2))
    probs /= probs.sum(axis=0)
    number = {p: i for i, p in enumerate(vocab.pieces)}
    data, starts, size, _, _ = distinct_words(pa.array(["Hello ñandú"]))
    logs = word_logs(vocab, data, starts, size, probs)
    for i, s in enumerate(starts):
        word = bytes(data[s : s + size[i]])
        alpha = [np.ones(2)] + [np.zeros(2) for _ in word]
        for b in range(1, len(word) + 1):
            for a in range(max(0, b - 16), b):
                if word[a:b] in number:
                    alpha[b] = alpha[b] + alpha[a] * probs[number[word[a:b]]]
        assert np.allclose(np.log(alpha[-1]), logs[i])


def test_language_sums_words_of_any_length(monkeypatch):
    """All pieces of the vocabulary, across any border: against brute force by logarithms, and words cut nowhere in the fit."""
    import public_tokenizers as P
    import sentencepiece

    from siltstone.llm import langid

    path = P.path("piece_bpe_32k.model")
    vocab = langid.vocabulary(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {sp.id_to_piece(i).lower().replace("▁", " ").encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    assert texts <= set(vocab.pieces) and vocab.longest == max(map(len, texts)) > 16
    probs = np.random.default_rng(1).random((vocab.n, 2)) ** 4 + 1e-6
    probs /= probs.sum(axis=0)
    number = {p: i for i, p in enumerate(vocab.pieces)}
    words = ["становништво", "является", "население" * 9, "日本語の文章は空白がなく長い" * 12, "the" * 40, "short"]
    data, starts, size, _, _ = langid.distinct_words(pa.array([" ".join(words)]))
    expected = []
    for i, s in enumerate(starts):
        word = bytes(data[s : s + size[i]])
        alpha = np.full((len(word) + 1, 2), -np.inf)
        alpha[0] = 0
        for b in range(1, len(word) + 1):
            for a in range(b):
                if word[a:b] in number:
                    alpha[b] = np.logaddexp(alpha[b], alpha[a] + np.log(probs[number[word[a:b]]]))
        expected.append(alpha[-1])
    for segment in (4096, 7, 100):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        assert np.allclose(langid.word_logs(vocab, data, starts, size, probs), expected)
    fits = []
    for segment, longest in ((4096, 48), (7, 48), (4096, 10)):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        monkeypatch.setattr(langid, "LONGEST", longest)
        fits.append(langid.fit([" ".join(words)], ["x"], vocab)[1])
    assert np.allclose(fits[0], fits[1]) and np.allclose(fits[0], fits[2])


def test_html_blocks():
    from siltstone.llm.html_blocks import blocks

    page = "<html><head><title>t</title></head><body><p>a <b>b</b><br>c<p>d &amp; e&nbsp;f<script>x<p>y</p></script><!-- <p>no</p> --><ul><li>g<li>h</ul>i<div>j<span>k</span></div><p>open"
    assert [t for t, _ in blocks(page)] == ["a b c", "d & e f", "g", "h", "i", "jk", "open"]
    for odd in ("", "<", "<p", "</p>", "a < b <c", "<!--", "<script>", "<a href='x>y", "<p>x</div></p></p>"):
        blocks(odd)
    assert [t for t, _ in blocks("a < b")] == ["a < b"]


def test_html_blocks_of_deep_pages():
    from siltstone.llm.crf import Ragged
    from siltstone.llm.extract import model
    from siltstone.llm.html_blocks import _hash, blocks

    depth = 12
    wrappers = "".join(f"<div class='{' '.join(f'u{chr(97 + d)}{chr(97 + k)}' for k in range(11))}'>" for d in range(depth))
    said = "<p>Some words, said by a reader of this page, and a few more of them.</p>"
    deep = [f"<{tag} class='{kind}'>{wrappers}{said}{'</div>' * depth}</{tag.split()[0]}>" for tag, kind in (("article", "post"), ("section id='comments'", "comments"), ("footer", "site"))]
    got = blocks("<html><body>" + "".join(deep) + "</body></html>")
    assert len(got) == 3
    words = {_hash(f"word u{chr(97 + d)}{chr(97 + k)}") for d in range(depth) for k in range(11)}
    for (_, feats), own in zip(got, (("in article", "word post"), ("in section", "word comments"), ("in footer", "word site")), strict=True):
        assert {_hash(x) for x in own} | words | {_hash("in body"), _hash("in html")} <= set(feats)
        assert len(set(feats)) == len(feats)
    # The scores are the sums of all features, whatever their number.
    crf = model()
    feats = [f for _, f in got] + [[1, 2], list(range(1, 300))]
    assert np.allclose(crf.scores(Ragged(feats)), [crf.weights[f].sum(axis=0) for f in feats])


def test_html_extraction(spark):
    from siltstone.llm.extract import extract, model, training_set

    crf = model()
    feats, labels, first = training_set(150, seed=77)
    assert (crf.viterbi(crf.scores(feats), first) == labels).mean() > 0.94
    page = "<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>Title here.</h1><p>First words, of the  text.</p><p>Second &lt;one&gt;, too.</p></article><footer>&copy; x.com</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (1, "u", page, "x")], "page_id long, url string, html string, n_blocks string")
    got = sorted((r["page_id"], r["main_text"]) for r in extract(rows).collect())
    text = "Title here.\nFirst words, of the text.\nSecond <one>, too."
    assert got == [(1, text), (1, text), (2, ""), (3, "")]
    assert extract(rows.limit(0)).count() == 0


def test_pipeline_on_small_tables(spark, small, tmp_path):
    """The stages against brute force, each on its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = ({r["doc_id"]: r for r in docs.collect()}, before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    after, before = kept["near_duplicates"]
    assert set(after) == {i for i, _, _, first in brute_components([(i, r["text"]) for i, r in before.items()]) if first}
    after, before = kept["repeated_strings"]
    assert set(after) == set(before) and all(len(after[i]["text"]) <= len(before[i]["text"]) for i in after)
    after, before = kept["byte_bpe"]
    assert {i: r["text"] for i, r in after.items()} == {i: r["text"] for i, r in before.items()}
    assert all(r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in after.values())
