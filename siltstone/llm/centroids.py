"""Exact centroid clustering: k-means over integer vectors, screened in float32.

A component x becomes the integer floor(scale * x). To find a vector's nearest centroid, one float32 matrix
product gives its scalar products with all centroids. The classical bound on the rounding error of a sum of
products, which holds for any order of summation, makes an interval of each: the true squared distance lies
inside. Centroids whose interval overlaps the best one are recomputed in exact integers; ties go to the
lowest number. A vector with a single centroid left needs no second look. So float32 decides nothing by itself,
and the result is that of integer arithmetic.

Every task sums its vectors by centroid before anything moves: what is shuffled and what the driver gets are
``k`` sums per component, however many vectors there are. Sums are exact at any size: they travel as
digits in base 2**32. Each round reads ``vectors`` again; store them first if they are dear to make.

Defined cases: a null vector, one of another length, and one with a null, NaN or infinite component (or one that is
infinite when scaled) are left out; fewer vectors than ``k`` make fewer centroids; equal centroids keep their
numbers and the lower one wins; a centroid without vectors stays where it is; repeated rows are rows, each with
its result; a null key is hashed as an empty one; rows with equal keys take places as centroids in the order of their
components; a distance or sum that does not fit a long is null, though clusters are right; an empty table
gives an empty result; other columns are ignored. Very large components take the exact path for all centroids.
"""

from __future__ import annotations

import hashlib
import heapq
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.resident import enter
from siltstone.storage import materialize

K, DIM, SCALE, ROUNDS, SEED = 16, 64, 64, 3, 1
BLOCK = 4096  # vectors of one matrix product
_DIGIT = 32
_LONG = 2**63 - 1


def integers(column: pa.Array, dim: int = DIM, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that hold a vector to keep, and their integers, as float64 without loss."""
    offsets = column.offsets.to_numpy()
    ok = np.diff(offsets) == dim
    if column.null_count:
        ok &= column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    values = column.values.to_numpy(zero_copy_only=False)  # a null is NaN here
    x = values[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
    fine = np.isfinite(x).all(axis=1)
    return rows[fine], x[fine]


class Screen:
    """Centroids, ready to be compared with blocks of vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.dim = len(centroids[0])
        self.exact = np.array(centroids, dtype=object)
        self.limit = isqrt(2**61 // self.dim)  # below it no squared distance leaves 63 bits
        self.small = bool((abs(self.exact) < self.limit).all())
        if self.small:
            self.exact = self.exact.astype(np.int64)
        self.wide = self.exact.astype(np.float64)
        with np.errstate(over="ignore"):
            self.single = self.wide.astype(np.float32).T.copy()
            self.square = (self.wide * self.wide).sum(axis=1)
        terms = self.dim + 4  # additions, two roundings to float32, and room for norms in float64
        self.error = 2 * terms * 2.0**-24 / (1 - terms * 2.0**-24) * np.sqrt(self.square) * (1 + 1e-6)

    def shortlist(self, x: np.ndarray) -> np.ndarray:
        """Marks (vector, centroid) where the centroid may be the nearest."""
        with np.errstate(over="ignore", invalid="ignore"):
            product = (x.astype(np.float32) @ self.single).astype(np.float64)
            score = self.square - 2 * product  # the squared distance without the vector's own square
            radius = np.sqrt((x * x).sum(axis=1))[:, None] * self.error + (self.square + 2 * abs(product)) * 2.0**-48
            low, high = score - radius, score + radius
        known = np.isfinite(low) & np.isfinite(high)
        low, high = np.where(known, low, -np.inf), np.where(known, high, np.inf)
        return low <= high.min(axis=1)[:, None]

    def _distance(self, x: np.ndarray, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Squared distances of pairs, exact; ``x`` holds integers, int64 or Python's."""
        d = x[rows] - self.exact[centroids]
        return (d * d).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(integers, cluster, squared distance) of float64 integers, exact."""
        if self.small and (abs(x) < self.limit).all():
            whole = x.astype(np.int64)
        else:
            whole = np.array([[int(c) for c in v] for v in x], dtype=object).reshape(x.shape)
        marks = self.shortlist(x)
        cluster = marks.argmax(axis=1)
        open_rows = np.flatnonzero(marks.sum(axis=1) > 1)
        if len(open_rows):
            at, c = np.nonzero(marks[open_rows])
            d = self._distance(whole, open_rows[at], c)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            least = np.minimum.reduceat(d, first)
            hit = np.flatnonzero((d == least[at]).astype(np.bool_))  # in rising order of centroids
            cluster[open_rows] = c[hit[np.flatnonzero(np.diff(at[hit], prepend=-1))]]
        return whole, cluster, self._distance(whole, np.arange(len(x)), cluster)


def _blocks(batches, dim, scale):
    """(keys, rows, integers) of blocks of vectors."""
    for b in batches:
        rows, x = integers(b.column(1), dim, scale)
        for at in range(0, len(rows), BLOCK):
            yield b.column(0), rows[at : at + BLOCK], x[at : at + BLOCK]


def _starts(source: DataFrame, k: int, dim: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the least hashes of their keys; each task sends its own ``k`` at most."""

    def run(batches):
        enter("centroids")
        best: list = []
        for keys, rows, x in _blocks(batches, dim, scale):
            hashes = [hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest() for key in keys.take(pa.array(rows)).to_pylist()]
            last = heapq.nsmallest(k, hashes)[-1]  # all rows with this one stay in: their components decide
            best = heapq.nsmallest(k, best + [(h, x[at].tolist()) for at, h in enumerate(hashes) if h <= last])
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.float64()))], ["hash", "v"])

    rows = source.mapInArrow(run, "hash string, v array<double>").orderBy("hash", "v").limit(k).collect()
    return [[int(x) for x in r["v"]] for r in rows]


def _digits(v: int):
    """(place, digit) of an integer in base 2**32; a negative one has negative digits."""
    sign, v, at = (-1 if v < 0 else 1), abs(v), 0
    while v:
        yield at, sign * (v & (2**_DIGIT - 1))
        v >>= _DIGIT
        at += 1


def _moved(source: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[list[int]]:
    """The centroids after a round: the floored means of their vectors."""

    def run(batches):
        enter("centroids")
        screen = Screen(centroids)
        sums, counts = np.zeros((len(centroids), dim), dtype=object), np.zeros(len(centroids), np.int64)
        for _, _, x in _blocks(batches, dim, scale):
            whole, cluster, _ = screen.nearest(x)
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            sums[cluster[order][first]] += np.add.reduceat(whole[order], first, axis=0).astype(object)
            counts += np.bincount(cluster, minlength=len(counts))
        rows = [(c, -1, at, d) for c, n in enumerate(counts.tolist()) for at, d in _digits(n)]
        rows += [(c, i, at, d) for c in np.flatnonzero(counts).tolist() for i in range(dim) for at, d in _digits(int(sums[c, i]))]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["c", "i", "place", "digit"])

    # Digits are below 2**32: their sums over all tasks fit a long. At most k * (dim + 1) sums of few digits come back.
    found = source.mapInArrow(run, "c int, i int, place int, digit long").groupBy("c", "i", "place").agg(F.sum("digit").alias("digit")).collect()
    total: dict = {}
    for r in found:
        total[r["c"], r["i"]] = total.get((r["c"], r["i"]), 0) + (r["digit"] << (_DIGIT * r["place"]))
    return [[total.get((c, i), 0) // n for i in range(dim)] if (n := total.get((c, -1), 0)) else v for c, v in enumerate(centroids)]


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, dim: int = DIM, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster, distance) per kept vector, written to the shared folder; the final centroids)."""
    values = F.col(f"`{vector}`")
    if vectors.schema[vector].dataType.elementType.simpleString() not in ("float", "double"):
        values = values.cast("array<double>")
    source = vectors.select(F.col(f"`{key}`").alias("key"), values.alias("v"))
    centroids = _starts(source, k, dim, scale, seed)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(source, centroids, dim, scale)

    def run(batches):
        enter("centroids")
        screen = Screen(centroids) if centroids else None
        for keys, rows, x in _blocks(batches, dim, scale):
            _, c, d = screen.nearest(x)
            fits = d if d.dtype != object else [v if v <= _LONG else None for v in d.tolist()]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(c.astype(np.int32)), pa.array(fits, pa.int64())], ["key", "cluster", "distance"])

    kind = vectors.schema[key].dataType.simpleString()
    out = materialize(source.mapInArrow(run, f"key {kind}, cluster int, distance long"), "clusters")
    return out, centroids


def inertia(clusters: DataFrame) -> DataFrame:
    """(cluster, cluster_inertia, inertia): the squared distances summed; null where one is null or the sum fits no long."""
    n_null = F.count_if(F.col("distance").isNull())
    sums = clusters.groupBy("cluster").agg(F.when(n_null == 0, F.sum(F.col("distance").cast("decimal(20,0)"))).alias("s")).collect()
    parts = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in sums}  # a row for each centroid
    whole = None if None in parts.values() else sum(parts.values())

    def fit(v):
        return v if v is not None and v <= _LONG else None

    return clusters.sparkSession.createDataFrame([(c, fit(v), fit(whole)) for c, v in parts.items()], "cluster int, cluster_inertia long, inertia long")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """All vectors of 64 finite components, dealt to 16 centroids after three rounds."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    per_centroid = inertia(found).join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    out = found.join(F.broadcast(per_centroid), "cluster")  # k rows
    return out.select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
