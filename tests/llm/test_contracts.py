"""The registered queries on whole small tables: names, types and rows of the contracts, against brute force or SQL."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from siltstone.llm.oracle import ORACLE_SQL
from siltstone.llm.queries import QUERIES
from tests.llm.test_operators import WORD9, brute_components, fold

CONTRACT = {
    "op1_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_repeated_strings": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op10_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op11_centroid_clustering": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op12_importance_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op13_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
}


@pytest.fixture(scope="module")
def sf001(small):
    """The next larger driver tables."""
    return small.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def results(spark, small):
    """The rows of every query, run once."""
    out = {}
    for name in [*CONTRACT, "op3_top_k_search"]:
        df = QUERIES[name](spark, small)
        out[name] = (dict(df.dtypes), [r.asDict() for r in df.collect()])
    return out


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns(name, results, documents, spark, small):
    kinds, rows = results[name]
    assert {c: kinds[c] for c in CONTRACT[name]} == CONTRACT[name]
    table = {"op2_html_extraction": "pages", "op11_centroid_clustering": "embeddings"}.get(name)
    n = spark.read.parquet(f"{small}/{table}.parquet").count() if table else len(documents)
    assert len(rows) == n


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, results, small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    asked = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in asked.description]
    assert set(names) == set(results[name][0])
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(plain(r) for r in asked.fetchall()) == sorted(plain(r[c] for c in names) for r in results[name][1])


def test_op1(results, documents):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in results["op1_near_duplicates"][1]}
    assert got == brute_components([(i, r["text"]) for i, r in documents.items()])


def test_op2(results, spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in results["op2_html_extraction"][1]:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert r["text"] == "\n".join(" ".join(x.split()) for x in r["text"].split("\n"))


def test_op4(results, documents):
    rows = results["op4_sharding"][1]
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts[k] for k in range(16)) <= 1
    for k in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))
    for r in rows:
        data = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


def test_op5_and_op8(results, documents, spark, small):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    right = []
    for r in results["op5_toxicity"][1]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and labels.get(r["doc_id"]) is not None:
            right.append(r["predicted"] == labels[r["doc_id"]])
    assert not right or np.mean(right) > 0.8
    right = []
    for r in results["op8_language_id"][1]:
        doc = documents[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if not re.search(r"[^\W\d_]", doc["text"] or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and doc["lang"]:
            right.append(r["lang_pred"] == doc["lang"])
    assert np.mean(right) > 0.9


def test_op6_and_op10(results, documents):
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in results["op6_byte_bpe"][1]:
        text = documents[r["doc_id"]]["text"] or ""
        ids = true.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode()))
    words, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for r in sorted(results["op10_token_files"][1], key=lambda r: r["doc_id"]):
        ids = words.encode(documents[r["doc_id"]]["text"] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op7(results, documents):
    got, seen = {r["doc_id"]: r for r in results["op7_repeated_strings"][1]}, set()
    for i in sorted(documents):
        data = (documents[i]["text"] or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 99):
            s = data[k : k + 100]
            if s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == (len(data), int(gone.sum()), spans, sha(kept))


def test_op9(results, documents, spark, small):
    wins = {}
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = WORD9.findall(fold(r["text"]))
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(str(r["item_id"]))
    sizes = {len(x) for x in wins}
    for r in results["op9_decontamination"][1]:
        w, hit, names = WORD9.findall(fold(documents[r["doc_id"]]["text"])), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                found = wins.get(tuple(w[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    names |= found
        expected = (len(w), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit) and 20 * len(hit) >= len(w))
        assert tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == expected


def test_search_with_odd_keys(spark):
    """Null keys, keys of text and keys above 2**53: none is lost or changed."""
    from siltstone.llm.search import top_k

    big = 2**53 + 1
    rows = [(None, "red green"), (big, "red red"), (big + 2, "blue"), (big, "red red"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = top_k(docs, docs.where("text = 'red green'"), 3).collect()
    assert sorted((r["query"], r["rank"], r["doc_id"]) for r in got if r["doc_id"]) == sorted([(None, r["rank"], big) for r in got if r["doc_id"]], key=lambda x: x[1])
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])][:1] == [None] and len(got) == 3
    named = spark.createDataFrame([("b", "red", 1), ("a", "red", 2), (None, "red", 3)], "doc_id string, text string, row int")
    got = top_k(named, named.where("doc_id = 'a'"), 3).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == ["a", "b", None]
    assert top_k(docs.limit(0), docs).count() == 0 and top_k(docs, docs.limit(0)).count() == 0


def test_null_keys(spark):
    from siltstone.llm.decontaminate import contamination
    from siltstone.llm.neardup import link
    from siltstone.llm.sharding import shard
    from siltstone.llm.tokenstore import _checksum, read_files, write_files
    from siltstone.llm.toxicity import tag

    import public_tokenizers as P

    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(None, text), (7, text), (None, None), (7, "other words")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in link(docs).collect())
    assert got == Counter([(None, 10, 7), (7, 10, 7), (None, 0, None), (7, 1, 7)])
    assert Counter(r["doc_id"] for r in shard(docs, 2).collect()) == Counter({None: 2, 7: 2})
    items = spark.createDataFrame([(None, text), (1, text)], "item_id long, text string")
    assert sorted((r["n_hit"], r["contaminated"]) for r in contamination(docs, items).collect()) == [(0, False), (0, False), (14, True), (14, True)]
    files = write_files(docs, P.path("word_bpe_49k.json"), 1)
    assert Counter(r["doc_id"] for r in read_files(files, _checksum, "ids_crc32 long", "bigint").collect()) == Counter({None: 2, 7: 2})
    assert tag(docs, None).count() == 4


def test_pipeline_keeps_columns(spark, small, tmp_path):
    """Columns that operators have names for pass unchanged, and a null text stays null."""
    import corpus_pipeline

    r = random.Random(2)
    text, other = (" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(60)) for _ in range(2))
    docs = spark.createDataFrame(
        [(1, text, "mine", 0.5, 9, b"x", "a", "b", "c"), (2, None, "yours", None, 8, None, "d", None, "f"), (3, "", "u", 1.0, 7, b"", "g", "h", "i"), (None, f"{text[:150]} {other}", "n", 2.0, 6, b"z", "j", "k", "l")],
        "doc_id long, text string, uid string, tox_score double, n_bytes int, kept_bytes binary, `__ord` string, rest string, `n.removed` string",
    )
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = {r["uid"]: r for r in docs.collect()}
    assert {u: (x["tox_score"], x["n_bytes"], x["kept_bytes"], x["__ord"], x["rest"], x["n.removed"]) for u, x in got.items()} == {
        "mine": (0.5, 9, b"x", "a", "b", "c"), "yours": (None, 8, None, "d", None, "f"), "u": (1.0, 7, b"", "g", "h", "i"), "n": (2.0, 6, b"z", "j", "k", "l"),
    }
    assert got["yours"]["text"] is None and got["u"]["text"] == "" and got["yours"]["n_tokens"] == 0
    # A null id comes first: what the texts share goes from the other one.
    assert got["n"]["text"] == f"{text[:150]} {other}" and got["mine"]["text"] == text[150:]


def test_broken_markup_takes_linear_time():
    import time

    from siltstone.llm.html_blocks import leaf_blocks

    for part in ("<a x='", "<a x='>", "<a '>'", "<a \"'>", "<div>x", "<li>x", "</p>x", "<td><div>", "<"):
        began = time.process_time()
        leaf_blocks(part * (300_000 // len(part)))
        assert time.process_time() - began < 8


def test_deep_and_stray_markup_takes_linear_time():
    """Pages of 5 MB: stray inline ends under open inline elements, and nested elements with class words of their own."""
    import time

    from siltstone.llm.extract import _scores, model
    from siltstone.llm.html_blocks import leaf_blocks

    n = 5_000_000
    stray = "<i><div>" + "<b>" * (n // 6) + "</i>" * (n // 8)
    names = ["".join("abcdefghij"[int(d)] for d in str(k)) for k in range(n // 24)]
    nested = "".join(f"<div class='w{x}'>x" for x in names)
    began = time.process_time()
    assert len(leaf_blocks(stray)) == 0
    found = leaf_blocks(nested)
    assert len(found) == len(names) and len(found.changes) < 3 * len(names)
    assert _scores(model(), [found]).shape == (len(names), 2)
    assert time.process_time() - began < 60


def test_running_sums_are_those_of_all_features():
    """Scores by running sums against sums over the listed features, over several pages of a slice."""
    from siltstone.llm.crf import Crf, Ragged
    from siltstone.llm.extract import _scores, model
    from siltstone.llm.html_blocks import blocks, leaf_blocks
    from siltstone.llm.html_training import labelled_pages

    pages = ["".join(t for t, _ in page) for page in labelled_pages(12, 5)] + ["", "<div class='post'>open", "<p>x</p>"]
    crf = model()
    unit = Crf(np.round(crf.weights * 2.0**20), crf.trans, crf.start)
    listed = unit.scores(Ragged([f for p in pages for _, f in blocks(p)])) / 2.0**20
    assert np.array_equal(_scores(crf, [leaf_blocks(p) for p in pages]), listed)


def test_ids_that_do_not_fit():
    from siltstone.llm.wavelet import WaveletMatrix

    assert WaveletMatrix.build(np.array([1, 65535], "<u4"), 16).tokens().tolist() == [1, 65535]
    with pytest.raises(ValueError, match="bit-planes"):
        WaveletMatrix.build(np.array([65536], "<u4"), 16)


def test_near_duplicates_keeps_one_row_of_a_group(spark, small, tmp_path):
    """Ids of several texts, repeated rows, rows without an id and texts without words."""
    import corpus_pipeline

    r = random.Random(8)
    a, b, t, u, v = (" ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(30)) for _ in range(5))

    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        out = corpus_pipeline.near_duplicates(spark, docs, small)
        assert out.columns == docs.columns
        return Counter((x["doc_id"], x["text"]) for x in out.collect())

    assert kept([(3, b, "s"), (5, a, "s"), (5, b, "s")]) == Counter([(3, b), (5, a)])
    assert kept([(9, t, "s"), (9, t, "other")] + [(9, t, "s")] * 50) == Counter([(9, t)])
    assert kept([(None, u, "s"), (None, u, "s"), (4, v, "s")]) == Counter([(None, u), (4, v)])
    near = f"{v} one more"
    assert kept([(2, near, "s"), (1, v, "s"), (1, v, None), (7, None, "s"), (7, None, "s"), (8, "", "s"), (8, "", "s"), (6, "one two", "s"), (6, "one two", "s")]) == Counter(
        [(1, v), (7, None), (7, None), (8, ""), (8, ""), (6, "one two")]
    )
    assert not kept([(1, "x", "s")]) - Counter([(1, "x")])


def test_counts_of_very_long_texts(spark, monkeypatch):
    """With one stretch in all, its count of shared shingles is far beyond what two bytes hold."""
    from siltstone.llm import neardup

    monkeypatch.setattr(neardup, "STRETCHES", 1)
    n = 40_000
    texts = spark.createDataFrame([(bytes([k]), " ".join(f"w{i}" for i in range(n + 4)) + f" end{k}") for k in (1, 2)], "cls binary, text string")
    members = spark.createDataFrame([(bytes([k]), bytes([k])) for k in (1, 2)], "cls binary, root binary")
    got = neardup.shared_histograms(members, texts, 5)
    assert sorted(r["shared"][0] for r in got.collect()) == [n, n]


def test_op2_texts_are_those_of_the_articles(spark, sf001):
    """Every page of the driver against the text of its own article element, by an independent reading: nearly all are equal, and none is far off."""
    import html as markup

    def article(page):
        inner = re.search(r"(?is)<article[^>]*>(.*?)</article>", page)[1]
        inner = re.sub(r"(?is)<(script|style|form|aside|figure)[^>]*>.*?</\1>|<!--.*?-->", "", inner)
        parts = re.split(r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|blockquote|section|table|tr|td|th|header|footer|pre|dl|dt|dd)(?:\s[^>]*)?>", re.sub(r"(?i)<br[^>]*>", " ", inner))
        texts = [" ".join(markup.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
        return [x for x in texts if x]

    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()}
    with_article = [k for k, p in pages.items() if re.search(r"(?i)<article", p)]
    got = {r["page_id"]: r["text"].split("\n") if r["text"] else [] for r in QUERIES["op2_html_extraction"](spark, sf001).collect()}
    assert len(with_article) > 100
    shared = [len(set(got[k]) & set(article(pages[k]))) / max(1, len(set(got[k]) | set(article(pages[k])))) for k in with_article]
    assert np.mean(shared) > 0.9 and np.mean([x == 1 for x in shared]) > 0.6


def test_op5_finds_the_toxic(spark, sf001):
    """Held-out labels: most toxic documents are found, and nearly no clean one is marked."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf001}/labels.parquet").where("toxic is not null").collect()}
    rows = [r for r in QUERIES["op5_toxicity"](spark, sf001).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = ([r["predicted"] for r in rows if labels[r["doc_id"]] == y] for y in (1, 0))
    assert toxic and clean
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.05


def test_op5_score_from_marginals():
    """The score is the logistic function of sums over the tokens' marginals."""
    from siltstone.llm.toxicity import summaries

    class Two:
        n_rows, counts, bounds = 3, np.array([3, 0, 2]), np.array([0, 3, 3, 5])

    p = np.array([0.1, 0.9, 0.5, 0.0, 0.25])
    wanted = [[1, 0.9, np.log1p(1.5), min(1.5 / 3 * 20, 3)], [1, 0, 0, 0], [1, 0.25, np.log1p(0.25), min(0.25 / 2 * 20, 3)]]
    assert np.allclose(summaries(p, Two), wanted)


def test_op8_document_score(spark):
    """The score of a text: the share of its language among the products of its words' sums over all segmentations."""
    from siltstone.llm.langid import classify, distinct_words, fit, vocabulary, word_logs

    import public_tokenizers as P
    import pyarrow as pa

    path = P.path("piece_bpe_32k.model")
    texts = ["the cat and the dog", "a house on the hill", "der hund und die katze", "ein haus auf dem berg"]
    model = fit(texts, ["en", "en", "de", "de"], vocabulary(path))
    asked = ["the dog and the house", "der berg und das haus", "the haus", "123 !!", None]
    got = {r["doc_id"]: r for r in classify(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), model, path).collect()}
    for i, text in enumerate(asked[:3]):
        data, starts, size, inverse, _ = distinct_words(pa.array([text]))
        logs = word_logs(vocabulary(path), data, starts, size, model[1])
        totals = [sum(logs[w][k] for w in inverse.tolist()) for k in range(len(model[0]))]
        best = int(np.argmax(totals))
        assert got[i]["lang_pred"] == model[0][best] and got[i]["score"] == pytest.approx(1 / sum(np.exp(t - totals[best]) for t in totals))
    assert [got[i]["lang_pred"] for i in (0, 1)] == ["en", "de"] and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4))


def test_pipeline_stages_by_brute_force(spark, small, documents):
    """Each stage on what its predecessor kept: rejected, grouped, cut and contaminated documents, judged anew in plain Python."""
    import corpus_pipeline
    from siltstone.llm.toxicity import learn, tag

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, small)
    score = {r["doc_id"]: r["tox_score"] for r in tag(docs, learn(docs, labels), spans=False).collect()}
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(left) == {k for k, v in score.items() if v < 0.5}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(clean - set(left)) <= 0.02 * len(clean)

    kept = corpus_pipeline.near_duplicates(spark, kept, small)
    first = {i for i, _, _, kept_one in brute_components(left.items()) if kept_one}
    left = {k: t for k, t in left.items() if k in first}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == left

    cut = corpus_pipeline.repeated_strings(spark, kept, small)
    seen, after = set(), {}
    for k in sorted(left):
        raw = (left[k] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(raw[i : i + 100])
        after[k] = (bytes(c for c, g in zip(raw, gone) if not g), left[k] is None)
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(got) == set(after)
    for k, (raw, null) in after.items():
        # A cut may fall inside a character.
        assert got[k] is None if null else got[k].replace("\ufffd", "") == raw.decode(errors="ignore").replace("\ufffd", "")

    kept = corpus_pipeline.decontamination(spark, cut, small)
    wins = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = WORD9.findall(fold(r["text"]))
        wins |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(x) for x in wins}
    clean = set()
    for k, t in got.items():
        w = WORD9.findall(fold(t))
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in wins for j in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(k)
    assert {r["doc_id"] for r in kept.collect()} == clean
