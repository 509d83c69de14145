"""Toxic spans by a linear-chain CRF, and document scores from its marginals.

Only documents are labelled, so the tokens of the training documents are labelled first: a token of a
toxic document is toxic if its word or one of its affixes occurs in toxic documents far oftener than in
others, behind many different words. A CRF learns these labels; forward-backward marginals then give every token of every document
its probability of being toxic. A logistic regression on what a document's marginals add up to, fitted
on the training documents, makes the document's score.

About ``PER_CLASS`` toxic documents and four times as many others at most are learnt from, chosen by a
hash of the key; of a key that repeats one text, and toxic if any of its labels says so. Texts of more than
``LONGEST_SAMPLE`` bytes are not learnt from. Every text is scored, whole.

Defined cases: a null or wordless text scores as one without toxic tokens and has no spans; a null key
counts as an empty text where its CRC is taken; labels that are null are not learnt from; without
labelled rows of both classes every score is 0; very long texts are scored whole, in slices of their own; repeated
rows get equal results; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.crf import Crf, train
from siltstone.llm.resident import enter, trim
from siltstone.llm.textbytes import Words, lut, mix, pieces

PER_CLASS = 600
LONGEST_SAMPLE = 1 << 17  # bytes of a text that is learnt from
BITS = 18
AFFIXES = (4, 5, 6, 7, 8, -4)
MIN_SEEN = 6  # different words before an affix or word in toxic documents, for it to mark tokens
MIN_LOG_ODDS = 3.5
IS_LETTER = lut(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def features(words: Words) -> np.ndarray:
    """[token, slot]: the word and its affixes, each kind in hashed places."""
    kinds = [words.hashes, *(words.affixes(a) for a in AFFIXES)]
    return np.stack([((h + np.uint64(j * 0x51ED27)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32) for j, h in enumerate(kinds)], axis=1)


class Tokens:
    """What the fit needs of the words of many texts, gathered from slices so that little is held at once."""

    def __init__(self, texts: list[str], slice_bytes: int = 1 << 20, with_features: bool = True):
        self.n_rows, parts = len(texts), []
        for b in pieces(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])]), "t", slice_bytes):
            w = Words(b.column(0), IS_LETTER)
            parts.append([w.hashes, w.counts, features(w) if with_features else np.zeros((0, 0), np.int32)])
        self.hashes, self.counts, self.features = (np.concatenate([p.pop(0) for p in parts]) for _ in range(3))
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.starts = self.hashes


def _firsts(words: Words | Tokens) -> np.ndarray:
    first = np.zeros(len(words.starts), np.bool_)
    first[words.bounds[:-1][words.counts > 0]] = True
    return first


def _hashed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


def one_of_each_family(words: Tokens) -> np.ndarray:
    """Marks documents, leaving out those that share one of two minima over three-word shingles with an earlier one: copies are not evidence."""
    doc = np.repeat(np.arange(words.n_rows), words.counts)
    n = len(doc)
    keep = np.ones(words.n_rows, np.bool_)
    if n < 3:
        return keep
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    for salt in (1, 2):
        h = _hashed(np.full(len(whole), salt, np.uint64), words.hashes[:-2][whole], words.hashes[1:-1][whole], words.hashes[2:][whole])
        order = np.lexsort((h, doc[whole]))
        d = doc[whole][order]
        first = np.ones(len(d), np.bool_)
        first[1:] = d[1:] != d[:-1]
        docs, least = d[first], h[order][first]
        _, earliest = np.unique(least, return_index=True)
        again = np.ones(len(docs), np.bool_)
        again[earliest] = False
        keep[docs[again]] = False
    return keep


def label_tokens(feats: np.ndarray, words: Tokens, toxic: np.ndarray) -> np.ndarray:
    """0/1 for each token of the training documents, from the documents' labels.

    A word or affix counts once for each different word before it, so copies count once.
    """
    doc = np.repeat(np.arange(words.n_rows, dtype=np.int32), words.counts)
    before = np.roll(words.hashes, 1)
    seen = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for y in (0, 1):
        at = np.flatnonzero(toxic[doc] == y)
        for j in range(feats.shape[1]):
            pairs = np.unique(mix(before[at]) >> np.uint64(BITS) << np.uint64(BITS) | feats[at, j].astype(np.uint64))
            seen[y] += np.bincount((pairs & np.uint64((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
    n1, n0 = (toxic[doc] == 1).sum(), (toxic[doc] == 0).sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    marks = (seen[1] >= MIN_SEEN) & (odds >= MIN_LOG_ODDS)
    return (marks[feats].any(axis=1) & (toxic[doc] == 1)).astype(np.int64)


def summaries(p: np.ndarray, words: Words | Tokens) -> np.ndarray:
    """[document, x]: what the marginals of a document add up to."""
    sums = np.concatenate([[0], np.cumsum(p)])
    total = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
    top = np.zeros(words.n_rows)
    full = words.counts > 0
    if full.any():
        top[full] = np.maximum.reduceat(p, words.bounds[:-1][full])
    n = np.maximum(words.counts, 1)
    return np.stack([np.ones(words.n_rows), top, np.log1p(np.maximum(total, 0)), np.minimum(total / n * 20, 3)], axis=1)


@dataclass
class Model:
    crf: Crf
    logit: np.ndarray

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the documents, toxicity of the tokens)."""
        p = self.crf.marginals(self.crf.scores(features(words)), _firsts(words))[:, 1]
        return 1 / (1 + np.exp(-np.clip(summaries(p, words) @ self.logit, -30, 30))), p


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """None without documents of both classes."""
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    keep = one_of_each_family(Tokens(texts, with_features=False))
    keep |= len(set(y[keep].tolist())) < 2
    texts, y = [t for t, k in zip(texts, keep, strict=True) if k], y[keep]
    words = Tokens(texts)
    labels, first = label_tokens(words.features, words, y), _firsts(words)
    # The chain learns from all toxic documents and about as many others.
    others = np.flatnonzero(y == 0)
    part = y == 1
    part[others[:: max(1, len(others) // max(1, int(part.sum())))]] = True
    chosen = np.repeat(part, words.counts)
    crf = train(words.features[chosen], labels[chosen], first[chosen], 1 << BITS)
    p = np.empty(len(first))
    cuts = np.unique(np.append(words.bounds[np.searchsorted(words.bounds, np.arange(0, len(first), 100_000))], len(first)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # whole documents each
        p[lo:hi] = crf.marginals(crf.scores(words.features[lo:hi]), first[lo:hi])[:, 1]
    x, w = summaries(p, words), np.zeros(4)
    for _ in range(50):  # Newton steps, lightly damped
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(4)
        w = w + np.linalg.solve(hessian, x.T @ (y - q) - 0.1 * w)
    return Model(crf, w)


def held_out(key) -> F.Column:
    """Rows whose labels are not learnt from: CRC-32 of the key's decimal text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """A model from the labelled documents that are not held out."""
    known = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    spread = F.pmod(F.xxhash64(F.lit("toxic"), key), F.lit(1 << 30))
    share = F.when(F.col("y") == 1, min(1.0, per_class / n[1])).otherwise(min(1.0, 4 * per_class / n[0])) * (1 << 30)
    # About 5 * per_class keys, each with one text of at most LONGEST_SAMPLE bytes.
    chosen = known.where(spread < share)
    short = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("t")).where(F.octet_length("t") <= LONGEST_SAMPLE)
    rows = short.join(F.broadcast(chosen), key).groupBy(key).agg(F.min("t").alias("t"), F.max("y").alias("y"))
    found = sorted((str(r[key]), r["t"], r["y"]) for r in rows.toLocalIterator())
    model = fit([t for _, t, _ in found], [y for _, _, y in found])
    trim()
    return model


def tag(docs: DataFrame, model: Model | None, text: str = "text", spans: bool = True, score: str = "tox_score") -> DataFrame:
    """The columns of ``docs`` and ``tox_score`` (0 to 1) and, on request, ``tox_spans``: [start, end) in characters.

    Columns of these names are replaced; the score's may be chosen.
    """
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != score and not (spans and c == "tox_spans")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([docs.schema[c] for c in kept]).add(score, T.DoubleType())
    if spans:
        schema = schema.add("tox_spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))

    def run(batches):
        enter("toxicity")
        m = sent.value
        for b in pieces(batches, "__text"):
            words = Words(b.column(b.num_columns - 1), IS_LETTER)
            scores, p = m.score(words) if m else (np.zeros(b.num_rows), np.zeros(len(words.starts)))
            out = [*b.columns[:-1], pa.array(scores)]
            if spans:
                out.append(_spans(words, p >= 0.5, b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return source.mapInArrow(run, schema)


def _spans(words: Words, hit: np.ndarray, column: pa.Array) -> pa.Array:
    """Runs of marked tokens, as character offsets in their texts."""
    from siltstone.llm.textbytes import flat

    _, offsets = flat(column)
    doc = np.repeat(np.arange(words.n_rows), words.counts)
    chars = np.concatenate([[0], np.cumsum((words.buf & 0xC0) != 0x80)])
    on = np.flatnonzero(hit)
    opens = np.ones(len(on), np.bool_)
    opens[1:] = (np.diff(on) != 1) | (doc[on[1:]] != doc[on[:-1]])
    begin, end = on[opens], on[np.append(opens[1:], True)] if len(on) else on
    d = doc[begin]
    base = chars[offsets[d]]
    pairs = pa.StructArray.from_arrays([pa.array((chars[words.starts[begin]] - base).astype(np.int32)), pa.array((chars[words.ends[end]] - base).astype(np.int32))], ["start", "end"])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=words.n_rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pairs)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, scored by a model learnt from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = tag(docs.select("doc_id", "text"), model, spans=False)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
