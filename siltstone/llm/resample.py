"""Importance resampling: draw the documents whose words look most like a target collection's.

Features are all runs of 1 to ``n`` words, counted in ``buckets`` by CRC-32. Each task keeps a trie of words: a
path from the root is a feature, and its node holds how often it occurred and the CRC state of the text on
the path, from which a child's state goes on, so a feature's checksum costs its last word only, once for each
node. Bucket totals of all tasks are merged; a bucket's gain is the floored logarithm of its share in the target over its
share in the corpus. In a second pass the nodes hold gains, and a document's weight is the floored mean of
the gains along the paths that its words walk. Weight plus Gumbel noise, made from a digest of the key, gives
a score; the highest scores are drawn, which is sampling without replacement by the weights.

A trie is emptied into its bucket totals when it has ``NODES`` nodes, and long texts are walked in stretches,
so memory depends on neither. Totals and gains are ``buckets`` numbers each. Ranks come from a range
sort of the scores from the last drawn one upwards and counts per partition: no task holds all of them.

Defined cases: a null text has no words; no words make weight 0; a null key is hashed as an empty one and comes
last among ties; rows with equal keys are rows of their own, tied by score and key in the order of features, weight and storage; an
empty corpus gives an empty result, an empty target equal gains of what it lacks; texts of any length are walked whole; other
columns, whatever their names, come along in ``document`` on request and are ignored else.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.resident import enter
from siltstone.llm.textbytes import flat, pieces
from siltstone.storage import materialize

BUCKETS, WORDS_LEAST, PERCENT, SEED = 10_000, 20, 10, 2024
NODES = 1 << 18
STRETCH = 1 << 20

#: A-Z folded, bytes outside of words blank: 0-9, a-z and all of non-ASCII stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def stretches(folded: bytes) -> Iterator[bytes]:
    """A folded text in parts of about ``STRETCH`` bytes, cut between words."""
    at = 0
    while at + STRETCH < len(folded):
        to = folded.find(b" ", at + STRETCH)
        if to < 0:
            break
        yield folded[at:to]
        at = to
    yield folded[at:]


class _Branch(dict):
    """The children of a node by word; an unknown word makes one."""

    __slots__ = ("trie", "node", "depth")

    def __init__(self, trie: Trie, node: int, depth: int):
        self.trie, self.node, self.depth = trie, node, depth

    def __missing__(self, word: bytes) -> int:
        node = self[word] = self.trie.grow(self, word)
        return node


class Trie:
    """Features of up to ``n`` words as paths; node 0 is the root."""

    def __init__(self, n: int):
        self.n = n
        self.clear()

    def clear(self) -> None:
        self.states, self.branches = [0], []
        self.branches.append(_Branch(self, 0, 0))
        self._crc = np.zeros(0, np.int64)

    def grow(self, parent: _Branch, word: bytes) -> int:
        node = len(self.states)
        self.states.append(zlib.crc32(b" " + word if parent.depth else word, self.states[parent.node]))
        self.branches.append(_Branch(self, node, parent.depth + 1) if parent.depth + 1 < self.n else None)
        return node

    def crc(self) -> np.ndarray:
        """The CRC of the feature at every node."""
        known = len(self._crc)
        if known < len(self.states):
            self._crc = np.append(self._crc, np.array(self.states[known:], np.int64))
        return self._crc

    def walk(self, texts: list[tuple[int, list[bytes], int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(owner, node) of all features of ``texts``: (owner, words, words that were walked before and only lead in)."""
        words: list[bytes] = []
        spans = []
        for owner, own, before in texts:
            spans.append((owner, len(words), before, len(words) + len(own)))
            words += own
        owner, start, before, end = np.array(spans, np.int64).reshape(-1, 4).T
        counts = end - start
        owners, ends, fresh = (np.repeat(x, counts) for x in (owner, end, start + before))
        at, nodes = np.arange(len(words)), np.fromiter(map(self.branches[0].__getitem__, words), np.int64, len(words))
        for length in range(1, self.n + 1):
            new = at + length - 1 >= fresh[at]
            yield owners[at[new]], nodes[new]
            if length < self.n:
                on = at + length < ends[at]
                at, nodes = at[on], nodes[on]
                branches = self.branches
                nodes = np.fromiter((branches[v][words[i]] for v, i in zip(nodes.tolist(), (at + length).tolist())), np.int64, len(at))


def _texts(batch: pa.RecordBatch, n: int) -> Iterator[tuple[list[tuple[int, list[bytes], int]], np.ndarray]]:
    """Parts of a slice for ``Trie.walk`` with the counts of new words of every row."""
    buf, offsets = flat(batch.column(batch.schema.get_field_index("text")))
    folded, ends = buf.tobytes().translate(FOLD), offsets.tolist()
    part, counts = [], np.zeros(batch.num_rows, np.int64)
    for row in range(batch.num_rows):
        lead: list[bytes] = []
        for piece in stretches(folded[ends[row] : ends[row + 1]]):
            words = piece.split()
            part.append((row, lead + words, len(lead)))
            counts[row] += len(words)
            lead = (lead + words)[1 - n :] if n > 1 else []
            if len(piece) >= STRETCH:
                yield part, counts
                part, counts = [], np.zeros(batch.num_rows, np.int64)
    yield part, counts


def bucket_totals(docs: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``docs`` lie in each bucket."""

    def run(batches):
        enter("resample")
        trie, totals = Trie(n), np.zeros(buckets, np.int64)
        held = np.zeros(0, np.int64)  # how often each node was met

        def emptied():
            np.add.at(totals, trie.crc()[: len(held)] % buckets, held)

        for b in pieces(batches, "text", STRETCH):
            for part, _ in _texts(b, n):
                for _, nodes in trie.walk(part):
                    held = np.append(held, np.zeros(len(trie.states) - len(held), np.int64))
                    held += np.bincount(nodes, minlength=len(held))
                if len(held) > NODES:
                    emptied()
                    trie.clear()
                    held = np.zeros(0, np.int64)
        emptied()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], ["bucket", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # a row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket from its totals: floor(1000 * ln of the ratio of smoothed shares), in doubles."""
    n, s_all, t_all = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(corpus))
    pairs = zip(corpus.tolist(), target.tolist())
    return np.fromiter((math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in pairs), np.int64, n)


def noise(key, seed: int) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", n: int = 1, seed: int = SEED, carry: bool = False) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every row; with ``carry`` also ``document``, all columns of the row."""
    columns = [F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    source = docs.select(*columns)
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        enter("resample")
        trie, gain = Trie(n), sent.value
        for b in pieces(batches, "text", STRETCH):
            total, features, n_words = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for part, counts in _texts(b, n):
                n_words += counts
                for owners, nodes in trie.walk(part):
                    features += np.bincount(owners, minlength=b.num_rows)
                    # Sums of less than 2**53 in all: exact in doubles.
                    total += np.bincount(owners, weights=gain[trie.crc()[nodes] % len(gain)], minlength=b.num_rows).astype(np.int64)
                if len(trie.states) > NODES:
                    trie.clear()
            weight = total // np.maximum(features, 1)
            score = weight + np.fromiter((noise(x, seed) for x in b.column(0).to_pylist()), np.int64, b.num_rows)
            made = [pa.array(x) for x in (n_words, features, weight, score)]
            names = ["key", "n_words", "n_features", "weight", "score"] + (["document"] if carry else [])
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *([b.column(2)] if carry else [])], names=names)

    schema = T.StructType([source.schema["key"], *(T.StructField(x, T.LongType()) for x in ("n_words", "n_features", "weight", "score"))])
    return source.mapInArrow(run, schema.add(source.schema["document"]) if carry else schema)


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = WORDS_LEAST) -> DataFrame:
    """``scored`` (a stored table) with ``rank``: 1, 2, ... by falling score among the drawn, else null."""
    spark, fit = scored.sparkSession, F.col("n_words") >= least
    # Scores are whole thousandths of logarithms of doubles: fewer than 2**20 different ones.
    seen = sorted(((r["score"], r["n"]) for r in scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    take = sum(n for _, n in seen) * percent // 100
    if not take:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cut, above = 0, 0
    for score, n in seen:
        cut, above = score, above + n
        if above >= take:
            break
    reached = fit & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), "n_features", "weight", "__row"]
    top = materialize(scored.where(reached).withColumn("__row", F.monotonically_increasing_id()).orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "drawn")
    part, in_part = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in top.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    offsets, before = [], 0
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    known = spark.createDataFrame(offsets, "__part int, __before long")
    ranked = top.withColumn("__part", part).join(F.broadcast(known), "__part")
    rank = F.col("__before") + in_part + 1
    ranked = ranked.select(*[F.col(f"`{c}`") for c in scored.columns], F.when(rank <= take, rank).alias("rank"))
    return ranked.unionByName(scored.where(~reached).withColumn("rank", F.lit(None).cast("long")))


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least: int = WORDS_LEAST, seed: int = SEED, carry: bool = False) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document; with ``carry`` also ``document``."""
    gain = gains(bucket_totals(docs, text, n, buckets), bucket_totals(target, target_text, n, buckets))
    return drawn(materialize(scores(docs, gain, key, text, n, seed, carry), "scores"), percent, least)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves: (rank, weight, score, document), a struct of all their columns."""
    return importance(docs, target, carry=True, **options).where("rank is not null").select("rank", "weight", "score", "document")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn towards the words of all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = importance(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return out.select(F.col("key").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")
