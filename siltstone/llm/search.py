"""Exact BM25 top-k search with block-max pruning of shards, merged with global statistics.

Rows with the same words, as often each, score alike and are one document of the index; its k smallest keys
are put in at the end. Documents are dealt to clusters by their use of the most frequent terms (centroids
fitted on a bounded sample, which decide speed but no result), in a cluster to classes by their lengths, and by a hash to the
shards of a class, of about ``SHARD_DOCS`` documents or ``SHARD_POSTINGS`` postings. A shard's inverted index is built once and stored as
a row of a Parquet table: for each term its postings, and for each document its terms.

Queries are packed into rows by cluster, in the order of their lengths, and each row of queries meets each shard: a stated query set
against all rows, in blocks. A task gets a shard's data once for all its rows of queries. Queries start with the k-th best score of some
shards of long documents of their own cluster. In a shard documents are in the order of their lengths, in blocks of ``BLOCK``; the sum of a query's
block maxima is its bound of a block, and where no bound comes up to the k-th best score so far, the shard is left out: so are
those of other languages. In the other shards all documents are scored, many queries together: terms that many of these queries and many
documents have, by a matrix product of dense rows of impacts, the others from their postings, both in single
precision. What comes within that precision of the k-th best is scored again in double
precision, in the order of terms, before it is compared, so results are exact. It is not WAND: no cursors of single terms
leap over each other, as with whole documents as queries nearly every block of their language has most of their terms.
Inverse document frequencies and the average length are those of the whole corpus, so the shards' best k
merge into the exact best k.

Defined cases: a null or wordless text matches nothing, and as a query finds nothing; very long texts are
searched and asked for whole; equal scores (to six decimals) are ordered by key, a null key last; keys may
be of any type that can be ordered; repeated rows are separate rows; an empty table finds nothing; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.decontaminate import IS_WORD
from siltstone.llm.resident import enter, one_thread, trim
from siltstone.llm.textbytes import Words, list_array, pieces
from siltstone.storage import drop, materialize, measured, settings

K1, B = 1.2, 0.75
BLOCK = 256
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 19
QUERY_BLOCK, QUERY_ENTRIES = 1024, 1 << 18
FREQUENT = 0.05  # share of a shard's documents from which a term has a dense row
DENSER = 350  # what adding a posting costs, in multiplications of a product
TOGETHER, SCORES = 512, 1 << 20  # queries in a product, and its scores
EXPANDED, STRIP = 1 << 15, 8  # postings in a sum, and postings of a term side by side
CLUSTERS, LENGTHS, MARKS, SAMPLE = 8, 6, 256, 4096
SPREAD, ROWS = 8, 8  # parts of the index, each for tasks of its own, and the rows of queries of a task, for which it opens its shards once
PILOTS = 4  # one of so many shards of long documents is tried first
ULP = 2.0**-23


def term_rows(docs: DataFrame, key: str, text: str, label: str = "terms") -> tuple[DataFrame, dict]:
    """(id, n, bag, fresh, terms, tfs) of every row, and their totals: words, distinct terms in order, how often each occurs.

    ``bag`` is a digest of terms and frequencies. Of the rows with one bag, only those with a smaller key than
    all before in their task are ``fresh``: among them is the smallest key of all.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enter("search")
        least = {}
        for b in pieces(batches, "text"):
            w = Words(b.column(1), IS_WORD)
            found = [np.unique(w.hashes[lo:hi].view(np.int64), return_counts=True) for lo, hi in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
            sizes = np.array([len(t) for t, _ in found], np.int64)
            bags = [hashlib.blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest() for t, c in found]
            fresh = []
            for bag, id_ in zip(bags, b.column(0).to_pylist(), strict=True):
                new = bag not in least or (id_ is not None and (least[bag] is None or id_ < least[bag]))
                fresh.append(new)
                if new:
                    least[bag] = id_
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(w.counts.astype(np.int64)),
                    pa.array(bags, pa.binary()),
                    pa.array(fresh, pa.bool_()),
                    list_array(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in found)]), sizes, pa.int64()),
                    list_array(np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)]).astype(np.int32), sizes, pa.int32()),
                ],
                ["id", "n", "bag", "fresh", "terms", "tfs"],
            )

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n long, bag binary, fresh boolean, terms array<long>, tfs array<int>")
    return measured(rows, label, F.count("*").alias("n"), F.avg("n").alias("length"), F.sum(F.size("terms")).alias("postings"))


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges behind one another."""
    n = stop - start
    return np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)


def _bytes(x: np.ndarray) -> bytes:
    """Numbers as a byte for their kind and their own bytes, as narrow as they can be: Spark copies them as they are."""
    if x.dtype.kind != "f" and (not len(x) or x.min() >= 0):
        x = x.astype(np.min_scalar_type(x.max() if len(x) else 0))
    return x.dtype.char.encode() + x.tobytes()


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    """The numbers of ``_bytes`` in row ``i``."""
    held = column[i].as_buffer()
    kind = np.dtype(chr(memoryview(held)[0]))
    return np.frombuffer(held, np.uint8)[1:].view(kind) if kind.itemsize == 1 else np.frombuffer(bytes(memoryview(held)[1:]), kind)


def _tidy() -> None:
    """Give back what the stages before have left in this worker."""
    trim()
    pa.default_memory_pool().release_unused()


class Clusters:
    """Which cluster a document belongs to: the centroid nearest to its frequent terms, by their cosine."""

    def __init__(self, marks: np.ndarray, weights: np.ndarray, sample: list, sizes: list, lengths: list, most: int, shards: int):
        order = np.argsort(marks)
        self.marks, self.weights = marks[order], weights[order]
        x = np.zeros((len(sample), len(marks)))
        for i, terms in enumerate(sample):
            at = np.searchsorted(self.marks, np.array(terms, np.int64))
            x[i, at] = self.weights[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        some = x[x.any(axis=1)]
        centers = some[:1] if len(some) else np.zeros((1, len(marks)))
        for _ in range(min(most, len(some)) - 1):
            centers = np.vstack([centers, some[np.argmin((some @ centers.T).max(axis=1))]])
        for _ in range(8 if len(centers) > 1 else 0):
            mine = np.argmax(x @ centers.T, axis=1)
            sums = np.array([x[mine == c].sum(axis=0) if np.any(mine == c) else centers[c] for c in range(len(centers))])
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        self.centers = centers
        mine, sizes, lengths = np.argmax(x @ centers.T, axis=1), np.array(sizes, float) + 1, np.array(lengths, float)
        share = np.bincount(mine, sizes, len(centers)) if len(x) else np.ones(1)
        self.shares = share / share.sum()
        # The shards of a cluster: lengths at which its classes end, of about as many postings each, and the shards of a class.
        self.cuts, self.parts = [], []
        for c, part in enumerate(self.shares.tolist()):
            own = max(1, int(np.ceil(shards * part)))
            order = np.argsort(lengths[mine == c], kind="stable")
            total = np.cumsum(sizes[mine == c][order])
            at = [np.searchsorted(total, total[-1] * (i + 1) / LENGTHS) for i in range(min(LENGTHS, own) - 1)] if len(total) and own >= LENGTHS else []
            self.cuts.append(np.unique(lengths[mine == c][order][at]).tolist() if len(at) else [])
            self.parts.append(max(1, int(np.ceil(own / (len(self.cuts[-1]) + 1)))))

    def of(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The cluster of every document, whose terms are those between its bounds."""
        if len(self.centers) < 2:
            return np.zeros(len(bounds) - 1, np.int32)
        at = np.searchsorted(self.marks, terms)
        at[at == len(self.marks)] = 0
        hit = np.flatnonzero(self.marks[at] == terms)
        doc = np.searchsorted(bounds, hit, side="right") - 1
        sums = [np.bincount(doc, (c * self.weights)[at[hit]], len(bounds) - 1) for c in self.centers]
        return np.argmax(sums, axis=0).astype(np.int32)


def fit_clusters(rows: DataFrame, df: DataFrame, n: int, shards: int) -> Clusters:
    """Clusters from a sample of some ``SAMPLE`` rows, by the hash of their bags, and the ``MARKS`` most frequent terms."""
    top = df.orderBy(F.desc("df"), "term").limit(MARKS).collect() if shards > 1 else []
    sample = []
    if top:
        marks = F.array(*(F.lit(r["term"]) for r in top))
        some = rows.where("n > 0 AND fresh").where(F.pmod(F.xxhash64("bag"), F.lit(max(1, n // SAMPLE))) == 0)
        sample = some.select(F.array_intersect("terms", marks).alias("terms"), F.size("terms").alias("size"), "n").collect()
    weights = np.array([np.log1p((n - r["df"] + 0.5) / (r["df"] + 0.5)) for r in top])
    return Clusters(np.array([r["term"] for r in top], np.int64), weights, [r["terms"] for r in sample], [r["size"] for r in sample], [r["n"] for r in sample], min(CLUSTERS, shards), shards)


def clustered(rows: DataFrame, clusters: Clusters) -> DataFrame:
    """``rows`` with their cluster; they have ``terms``."""
    at = rows.columns.index("terms")

    def run(batches):
        enter("search")
        for b in batches:
            lists = b.column(at)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            found = clusters.of(lists.flatten().to_numpy(zero_copy_only=False), bounds)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], [*b.schema.names, "cluster"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, cluster int")


class Index:
    """The inverted index of a shard: postings by term and document, frequent terms as dense rows too, and block maxima.

    Documents are numbered in the order of their lengths; ``rank`` is their place in the order of their keys, by which
    ties go. Stored are also the documents' own lists of terms, for scores in double precision.
    """

    FIELDS = ("lengths", "rank", "terms", "counts", "doc", "tf", "sizes", "own", "own_tf")
    KINDS = ", ".join(f"{f} binary" for f in FIELDS)

    def __init__(self, lengths: np.ndarray, rank: np.ndarray, terms: np.ndarray, counts: np.ndarray, doc: np.ndarray, tf: np.ndarray, sizes: np.ndarray, own: np.ndarray, own_tf: np.ndarray, average: float):
        self.terms, self.rank, self.own, self.own_tf = terms, rank, own, own_tf
        counts, sizes, lengths, doc = counts.astype(np.int64), sizes.astype(np.int64), lengths.astype(np.int64), doc.astype(np.int64)
        self.size = n = len(lengths)
        self.blocks = -(-n // BLOCK)
        self.norm = K1 * (1 - B + B * lengths / average)
        norm = self.norm.astype(np.float32)
        tf = tf.astype(np.float32)
        impact = tf * np.float32(K1 + 1) / (tf + norm[doc])
        stop = np.cumsum(counts, dtype=np.int64)
        start = stop - counts
        self.own_stop = np.cumsum(sizes, dtype=np.int64)
        self.own_start = self.own_stop - sizes
        frequent = np.flatnonzero(counts >= max(FREQUENT * n, 2))
        self.counts = counts[frequent]
        self.row = np.full(len(terms), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), n), np.float32)
        place = _ranges(start[frequent], stop[frequent])
        self.dense[np.repeat(np.arange(len(frequent)), counts[frequent]), doc[place]] = impact[place]
        self.postings = self._strips(counts, doc, impact)
        part = doc // BLOCK
        fresh = np.ones(len(doc), bool)
        fresh[1:] = part[1:] != part[:-1]
        fresh[start] = True
        first = np.flatnonzero(fresh)
        self.peaks = self._strips(np.add.reduceat(fresh, start, dtype=np.int64), part[first], np.maximum.reduceat(impact, first))
        self.known = np.zeros(1 << 20, bool)
        self.known[terms >> 44] = True  # by the first bits of a term's hash: most terms of queries are in no document of a shard

    @staticmethod
    def _strips(counts: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists one behind another, each in strips of ``STRIP`` that end in zeros: for each list its first strip and the number of them, and the strips' columns and values."""
        many = -(-counts // STRIP)
        first = np.cumsum(many) - many
        place = np.repeat(first * STRIP - (np.cumsum(counts) - counts), counts) + np.arange(len(column))
        columns, values = np.zeros(int(many.sum()) * STRIP, np.int32), np.zeros(int(many.sum()) * STRIP, np.float32)
        columns[place], values[place] = column, value
        return first, many, columns.reshape(-1, STRIP), values.reshape(-1, STRIP)

    @staticmethod
    def sort(n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> list[np.ndarray]:
        """The stored fields, from the documents in the order of their keys."""
        rank = np.argsort(n, kind="stable").astype(np.int32)
        stop = np.cumsum(sizes)
        mine = _ranges((stop - sizes)[rank], stop[rank])
        sizes, terms, tfs = sizes[rank], terms[mine], tfs[mine]
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        distinct, own, counts = np.unique(terms, return_inverse=True, return_counts=True)
        own = own.astype(np.int32)
        order = np.argsort(own, kind="stable")
        return [n[rank].astype(np.int32), rank, distinct, counts.astype(np.int32), doc[order], tfs[order], sizes.astype(np.int32), own, tfs]

    def exact(self, at: np.ndarray, weights: np.ndarray, docs: np.ndarray, scratch: np.ndarray) -> np.ndarray:
        """Scores of ``docs`` in double precision, to six decimals; ``scratch`` is zero for each term, before and after."""
        scratch[at] = weights
        start, stop = self.own_start[docs], self.own_stop[docs]
        place = _ranges(start, stop)
        tf = self.own_tf[place].astype(np.float64)
        parts = scratch[self.own[place]] * (tf * (K1 + 1) / (tf + np.repeat(self.norm[docs], stop - start)))
        scratch[at] = 0
        return np.round(np.add.reduceat(parts, np.cumsum(stop - start) - (stop - start)), 6)

    def search(self, vocabulary: np.ndarray, which: np.ndarray, weights: np.ndarray, sizes: np.ndarray, floors: np.ndarray, k: int, near: bool = True, rough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, documents, scores): the best k of the shard for every query, those below its floor left out, ties by rank.

        Query i has the next ``sizes[i]`` entries: numbers of terms in ``vocabulary`` and their weights. Queries that are not
        ``near`` the shard are first held against its blocks. With ``rough``, which has k values for every query, nothing is found, but the
        values become the greatest of them and of what the shard's scores are at least, and floors the k-th ones.
        """
        known = np.full(len(vocabulary), -1)
        may = np.flatnonzero(self.known[vocabulary >> 44])
        place = np.minimum(np.searchsorted(self.terms, vocabulary[may]), len(self.terms) - 1)
        hit = self.terms[place] == vocabulary[may]
        known[may[hit]] = place[hit]
        at = known[which]
        mine = np.flatnonzero(at >= 0)
        at, weights, query = at[mine], weights[mine], np.repeat(np.arange(len(sizes)), sizes)[mine]
        first = np.searchsorted(query, np.arange(len(sizes) + 1))
        scratch, found = np.zeros(len(self.terms)), []
        step = max(1, min(TOGETHER, SCORES // self.size))
        for lo in range(0, len(sizes), step):
            hi = min(lo + step, len(sizes))
            part = slice(first[lo], first[hi])
            if first[hi] > first[lo]:
                made, near = self._some(at[part], weights[part], query[part] - lo, floors[lo:hi], k, scratch, lo, near, None if rough is None else rough[lo:hi])
                found += made
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    @staticmethod
    def _spread(lists: tuple, at: np.ndarray, weights: np.ndarray, query: np.ndarray, out: np.ndarray) -> None:
        """Add to a query's row of ``out`` the weighted values of its terms' lists, at their columns; queries are in order."""
        first, many, columns, values = lists
        width, sums = out.shape[1], out.reshape(-1)
        load = np.concatenate([[0], np.cumsum(many[at])])
        lo = 0
        while lo < len(at):  # so few at once that they stay in the cache
            hi = max(lo + 1, int(np.searchsorted(load, load[lo] + EXPANDED // STRIP, side="right")) - 1)
            some = slice(lo, hi)
            count = many[at[some]]
            strip = _ranges(first[at[some]], first[at[some]] + count)
            key = np.repeat(query[some] * width, count * STRIP)
            key += columns.take(strip, axis=0).ravel()
            value = values.take(strip, axis=0).ravel()
            value *= np.repeat(weights[some].astype(np.float32), count * STRIP)
            np.add.at(sums, key, value)
            lo = hi

    def _some(self, at, weights, query, floors, k, scratch, number, near, rough) -> tuple[list[tuple], bool]:
        """``search`` for the queries of one product, and whether those after them are near."""
        n = len(floors)
        slack = 1 + (np.bincount(query, minlength=n) + 16) * ULP  # sums of so many products in single precision
        first = np.searchsorted(query, np.arange(n + 1))
        here, mine = np.arange(n), slice(None)
        if not near:
            bound = np.zeros((n, self.blocks), np.float32)
            self._spread(self.peaks, at, weights, query, bound)
            stay = bound.max(axis=1) * slack + 1e-6 >= np.maximum(floors, 2e-6)
            here, mine = np.flatnonzero(stay), stay[query]
            if not len(here):
                return [], False
            near = len(here) > n / 2
        terms, loads, line = at[mine], weights[mine], np.searchsorted(here, query[mine])
        row = self.row[terms]
        asked = np.bincount(row[row >= 0], minlength=len(self.counts))
        chosen = np.flatnonzero(asked * self.counts * DENSER > len(here) * self.size)
        new = np.full(len(self.counts) + 1, -1, np.int32)
        new[chosen] = np.arange(len(chosen))
        row = new[row]
        often = row >= 0
        w = np.zeros((len(here), len(chosen)), np.float32)
        w[line[often], row[often]] = loads[often]
        score = w @ (self.dense if len(chosen) == len(self.dense) else self.dense.take(chosen, axis=0))
        self._spread(self.postings, terms[~often], loads[~often], line[~often], score)
        slack = slack[here]
        if rough is not None:
            most = score if self.size <= k else np.partition(score, self.size - k, axis=1)[:, self.size - k :]
            both = np.concatenate([rough[here], most / slack[:, None] - 2e-6], axis=1)
            rough[here] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            floors[here] = np.maximum(floors[here], rough[here].min(axis=1))
            return [], near
        close = score >= (np.maximum(floors[here] - 1e-6, 1e-12) / slack)[:, None]
        found = []
        for j in np.flatnonzero(close.any(axis=1)).tolist():
            i, docs = int(here[j]), np.flatnonzero(close[j])
            if len(docs) > k:
                those = score[j, docs]
                docs = docs[those >= np.partition(those, len(those) - k)[len(those) - k] / slack[j] ** 2 - 2e-6]
            own = slice(first[i], first[i + 1])
            scores = self.exact(at[own], weights[own], docs, scratch)
            keep = np.lexsort((self.rank[docs], -scores))[:k]
            keep = keep[scores[keep] >= floors[i]]
            if len(keep):
                found.append((np.full(len(keep), number + i), docs[keep], scores[keep]))
        return found, near


def build_shards(rows: DataFrame, clusters: Clusters, shards: int) -> DataFrame:
    """A row per shard: its cluster, whether queries of the cluster try it first, its documents' bags, and its index. Written to the shared folder."""
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("cluster") + 1)
    first = np.cumsum([0, *(p * (len(cuts) + 1) for p, cuts in zip(clusters.parts, clusters.cuts, strict=True))]).tolist()
    pilots = {f + i for f, p, cuts in zip(first[:-1], clusters.parts, clusters.cuts, strict=True) for long in range((len(cuts) + 1) // 2, len(cuts) + 1) for i in range(long * p, long * p + p, PILOTS)}
    schema = f"shard int, cluster int, pilot boolean, bags array<binary>, {Index.KINDS}"

    def run(table: pa.Table) -> pa.Table:
        enter("search")
        trim(False)
        shard, cluster = table["shard"][0].as_py(), table["cluster"][0].as_py()
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")])).combine_chunks()  # null last
        bags, seen = table["bag"].to_pylist(), set()
        keep = [i for i, bag in enumerate(bags) if not (bag in seen or seen.add(bag))]
        table = table.take(pa.array(keep)).combine_chunks()
        lists = table["terms"].combine_chunks()
        made = Index.sort(table["n"].to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(), table["tfs"].combine_chunks().flatten().to_numpy())
        ordered = table["bag"].combine_chunks().take(pa.array(made[1]))
        columns = [pa.array([shard], pa.int32()), pa.array([cluster], pa.int32()), pa.array([shard in pilots])]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(ordered)], pa.int32()), ordered)]
        columns += [pa.array([_bytes(x)], pa.binary()) for x in made]
        return pa.table(columns, names=["shard", "cluster", "pilot", "bags", *Index.FIELDS])

    # A file for each shard or two: a reader holds little at once.
    ends = F.element_at(F.array(*(F.array(*(F.lit(x) for x in cuts)).cast("array<double>") for cuts in clusters.cuts)), F.col("cluster") + 1)
    length = F.size(F.filter(ends, lambda x: x < F.col("n")))
    shard = (pick(first[:-1]) + length * pick(clusters.parts) + F.pmod(F.xxhash64("bag"), pick(clusters.parts).cast("long"))).cast("int")
    mine = clustered(rows.where("n > 0 AND fresh").select("id", "n", "bag", "terms", "tfs"), clusters).withColumn("shard", shard).repartition(first[-1], "shard")
    return materialize(mine.groupBy("shard").applyInArrow(run, schema), "index")


def pack_queries(asked: DataFrame, df: DataFrame, n: int, clusters: Clusters, blocks: int) -> DataFrame:
    """Rows of many queries of a cluster each: (part, cluster, rows, entries, vocabulary, which, weights). Written to the shared folder."""
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mine = clustered(asked, clusters)
    entries = mine.select("row", "cluster", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", "cluster", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    weighted = entries.join(df, "term").groupBy("row", "cluster").agg(F.array_sort(F.collect_list(F.struct("term", (idf * F.col("tf")).alias("w")))).alias("t"))
    parts = [max(1, int(np.ceil(blocks * s))) for s in clusters.shares.tolist()]
    first = [sum(parts[:i]) for i in range(len(parts))]
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("cluster") + 1)
    part = (pick(first) + F.pmod(F.xxhash64("row"), pick(parts).cast("long"))).cast("int")
    packed = weighted.groupBy(part.alias("part"), "cluster").agg(F.collect_list(F.struct("row", "t")).alias("q"))
    lists = packed.select(
        "part",
        "cluster",
        F.col("q.row").alias("rows"),
        F.transform("q", lambda x: F.size(x["t"])).alias("entries"),
        F.flatten(F.transform("q", lambda x: x["t"].getField("term"))).alias("terms"),
        F.flatten(F.transform("q", lambda x: x["t"].getField("w"))).alias("weights"),
    )

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                sizes, weights = (_flat(b.column(j), i).to_numpy(zero_copy_only=False) for j in (3, 5))
                order = np.argsort(sizes, kind="stable")  # those that use as many terms side by side
                stop = np.cumsum(sizes)
                mine = _ranges((stop - sizes)[order], stop[order])
                vocabulary, which = np.unique(_flat(b.column(4), i).to_numpy(zero_copy_only=False)[mine], return_inverse=True)
                rows = _flat(b.column(2), i).take(pa.array(order))
                made = [pa.array([_bytes(x)], pa.binary()) for x in (sizes[order], vocabulary, which, weights[mine])]
                lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([*(b.column(j).slice(i, 1) for j in range(2)), lists, *made], ["part", "cluster", "rows", "entries", "vocabulary", "which", "weights"])

    with settings(asked.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        return materialize(lists.mapInArrow(run, "part int, cluster int, rows array<long>, entries binary, vocabulary binary, which binary, weights binary"), "queries")


def _flat(column: pa.Array, i: int) -> pa.Array:
    return column.slice(i, 1).flatten()


def meet(index: DataFrame, packed: DataFrame, parts: int, average: float, k: int, pilot: bool = False) -> DataFrame:
    """Every row of queries with every shard: (part, row, bag, score), in each task the best k of each query and what equals the k-th.

    With ``pilot``, queries meet the shards of their cluster alone, and there are no bags but what the best k scores are at least.
    Otherwise packed has ``floors``.
    """

    def run(batches):
        enter("search")
        one_thread()
        _tidy()
        opened, shard, own, asked, bags, held = None, None, None, {}, {}, {}
        for b in batches:
            c = {name: b.column(j) for j, name in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                part, cluster = c["part"][i].as_py(), c["cluster"][i].as_py()
                if c["rows"][i].is_valid:
                    rows = _flat(c["rows"], i).to_numpy(zero_copy_only=False).copy()
                    asked[part] = tuple(_numbers(c[f], i) for f in ("vocabulary", "which", "weights", "entries"))
                    if pilot:
                        held[part] = rows, np.zeros(len(rows)), np.zeros((len(rows), k))
                    else:
                        held[part] = rows, _flat(c["floors"], i).to_numpy(zero_copy_only=False).copy(), [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
                if c["lengths"][i].is_valid:
                    shard, opened = c["shard"][i].as_py(), None  # its memory goes first
                    trim(False)
                    opened = Index(*(_numbers(c[f], i) for f in Index.FIELDS), average)
                    own = None if pilot else pa.concat_arrays([_flat(c["bags"], i)])
                if shard != c["shard"][i].as_py() or part not in asked:
                    raise RuntimeError("a shard or a row of queries has come without its data")
                near = cluster == c["asked_cluster"][i].as_py()
                rows, floors, best = held[part]
                if pilot:
                    if near:
                        opened.search(*asked[part], floors, k, rough=best)
                    continue
                query, doc, score = opened.search(*asked[part], floors, k, near)
                if not len(query):
                    continue
                if shard not in bags:
                    bags[shard] = own
                query, owner, doc, score = (np.concatenate(x) for x in zip(best, (query, np.full(len(query), shard), doc, score), strict=True))
                order = np.lexsort((-score, query))
                query, owner, doc, score = query[order], owner[order], doc[order], score[order]
                at, many = (x.astype(np.int64) for x in np.unique(query, return_index=True, return_counts=True)[1:])
                full = many >= k
                floors[query[at[full]]] = np.maximum(floors[query[at[full]]], score[at[full] + k - 1])
                keep = score >= floors[query]
                held[part] = rows, floors, [query[keep], owner[keep], doc[keep], score[keep]]
        opened = b = c = None
        asked.clear()
        names = ["part", "row", "bag", "score"]
        for part, (rows, _, best) in held.items():
            if pilot:
                line, place = np.nonzero(best > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(line), part), pa.int32()), pa.array(rows[line]), pa.nulls(len(line), pa.binary()), pa.array(best[line, place])], names)
                continue
            query, owner, doc, score = best
            for shard in np.unique(owner).tolist():
                mine = np.flatnonzero(owner == shard)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), part), pa.int32()), pa.array(rows[query[mine]]), bags[shard].take(pa.array(doc[mine])), pa.array(score[mine])], names)
        held = bags = own = None
        _tidy()  # the worker goes on to other stages

    begins = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    left = index.coalesce(2 if pilot else SPREAD).withColumn("opening", begins)
    right = packed.withColumnRenamed("cluster", "asked_cluster").coalesce(max(1, -(-parts // (4 if pilot else ROWS)))).withColumn("lead", begins)
    # The product takes a shard with each row of queries of a task before it turns to the next one: a shard's data are
    # sent with the first of these rows, and a row's with the task's first shard.
    once = {**dict.fromkeys(["bags", *Index.FIELDS], "lead"), **dict.fromkeys(["rows", "entries", "vocabulary", "which", "weights", "floors"], "opening")}
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    pairs = pairs.select("shard", "cluster", "part", "asked_cluster", *(F.when(F.col(flag), F.col(c)).alias(c) for c, flag in once.items() if c in pairs.columns))
    # The rows are large: few are read and sent at a time.
    with settings(index.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "4"}):
        return materialize(pairs.mapInArrow(run, "part int, row long, bag binary, score double"), "found")


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, rank, key, score): the k best documents of every query; both tables have ``key`` and ``text``."""
    rows, stats = term_rows(docs, key, text)
    n, average = stats["n"], max(stats["length"] or 0.0, 1e-9)
    terms, many = term_rows(queries, key, text, "asked_terms")
    asked = materialize(terms.withColumn("row", F.monotonically_increasing_id()), "asked")
    drop(terms)
    firsts = asked.where("fresh").groupBy("bag").agg(F.min("row").alias("first"))
    distinct = asked.select("bag", "row", "terms", "tfs").join(firsts.select(F.col("first").alias("row")), "row", "left_semi").select("row", "terms", "tfs")
    df = materialize(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "df")
    shards = max(1, -(-n // SHARD_DOCS), -(-(stats["postings"] or 0) // SHARD_POSTINGS))
    clusters = fit_clusters(rows, df, n, shards)
    parts = max(1, -(-many["n"] // QUERY_BLOCK), -(-(many["postings"] or 0) // QUERY_ENTRIES))
    packed = pack_queries(distinct, df, n, clusters, parts)
    parts += CLUSTERS
    drop(df)
    index = build_shards(rows, clusters, shards)
    smallest = F.row_number().over(Window.partitionBy("bag").orderBy(F.asc_nulls_last("id")))
    members = materialize(rows.where("n > 0").select("bag", "id").withColumn("place", smallest).where(F.col("place") <= k).drop("place"), "members")
    drop(rows)

    # Queries start from the k-th best score of one shard of their cluster.
    tried = meet(index.where("pilot"), packed, parts, average, k, pilot=True)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))
    kth = tried.withColumn("place", place).where(F.col("place") == k).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("row", "score"))).alias("kth"))
    floors = F.transform("rows", lambda r: F.coalesce(F.element_at("kth", r), F.lit(0.0)))
    ready = materialize(packed.join(kth, "part", "left").withColumn("floors", F.when(F.col("kth").isNotNull(), floors).otherwise(F.transform("rows", lambda r: F.lit(0.0)))).drop("kth"), "queries")
    drop(tried, packed)
    found = meet(index, ready, parts, average, k)
    drop(index, ready)

    place = F.rank().over(Window.partitionBy("row").orderBy(F.desc("score")))
    classes = found.withColumn("place", place).where(F.col("place") <= k).select(F.col("row").alias("first"), "bag", "score")
    rank = F.row_number().over(Window.partitionBy("first").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    best = classes.join(members, "bag").withColumn("rank", rank).where(F.col("rank") <= k).select("first", "rank", F.col("id").alias(key), "score")
    names = asked.select("bag", F.col("id").alias("query")).join(firsts, "bag")
    return best.join(names, "first").select("query", "rank", key, "score")


def op3_top_k_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20, as whole-text queries."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return top_k(docs, docs.where(F.col("doc_id") % 20 == 0)).select(F.col("query").alias("query_id"), "rank", "doc_id", "score")
