"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact links.

1. Each text becomes a set of hashed word shingles. Equal sets are one class from here on.
2. One permutation splits the hash range into bins; a bin's value is its least hash. An empty bin takes
   the value of the first full bin in its own fixed order of all bins (optimal densification).
3. The bins form bands; equal bands share a bucket. In each bucket only the edges from its least class
   to the others become candidates (a star), so a bucket of n classes makes n - 1 pairs.
4. Candidates whose set sizes allow it are confirmed on their full shingle sets.
5. A bucket whose classes still fall into several components may hide a link between two classes that
   are not its centre. Of its classes only those stay that can have such a link at all: enough of their
   shingles must occur in other components. Counts of these shingles in ``STRETCHES`` stretches of hashes
   bound what two sets share. Such buckets make further stars, from ``DRAWS`` centres drawn by hash, and
   their links contract the components to their roots. What is then left of a bucket is compared across
   components where the bound allows a link, which leaves no link out.
6. Components of the confirmed links, as the least document id in them.

``BANDS`` bands of ``ROWS`` bins miss a pair at the threshold with a chance of about 6 in 100,000.

Defined cases: a text with fewer words than a shingle is one shingle; without words, or null, it has no
shingles and is linked with nothing; very long texts are hashed whole, in slices of their own; equal texts
are one class, whatever their number; rows that share an id are linked by their own texts; a null id is
never the least; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import connected_components
from siltstone.llm.resident import enter
from siltstone.llm.textbytes import Words, list_array, lut, mix, pieces
from siltstone.storage import drop, materialize

BANDS, ROWS = 54, 6
BINS = BANDS * ROWS
STRETCHES = 128
DRAWS = 3  # centres of a bucket's further stars
_U = np.uint64
IS_WORD = lut(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, out = words.hashes, []
    keys = [_U((0x9E3779B97F4A7C15 * (2 * k + 3) | 1) & (2**64 - 1)) for k in range(size)]
    n = len(h) - size + 1
    rolled = np.zeros(max(n, 0), _U)
    for k in range(size if n > 0 else 0):
        rolled += h[k : k + n] * keys[k]
    rolled = mix(rolled)
    for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            s = np.sort(rolled[lo : hi - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif hi > lo:
            part = np.zeros(1, _U)
            for k in range(hi - lo):
                part += h[lo + k : lo + k + 1] * keys[k]
            out.append(mix(part + _U(hi - lo)))
        else:
            out.append(np.zeros(0, _U))
    return out


@lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    """[bin, empty bin]: the place of the bin in the empty bin's order; first in its own."""
    rng = np.random.default_rng(7)
    order = np.empty((BINS, BINS), np.int16)
    for j in range(BINS):
        order[rng.permutation(BINS), j] = np.arange(BINS)
        order[j, j] = -1
    return order


def bands(shingles: np.ndarray) -> np.ndarray:
    """The hashes of the bands of a set that is not empty."""
    # Shingles are sorted, and bins are stretches of the hash range: a bin's first entry is its least.
    place = ((shingles >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    full = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    values = np.zeros(BINS, _U)
    if len(full) == BINS:
        values[:] = shingles[full]
    else:
        values[:] = shingles[full][_donors()[place[full]].argmin(axis=0)]
    keys = np.arange(1, ROWS + 1, dtype=_U) * _U(0xD6E8FEB86659FD93) | _U(1)
    return mix((values.reshape(BANDS, ROWS) * keys).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    a = mix(shingles + _U(0x1234567)).sum(dtype=_U)
    b = mix(shingles ^ _U(0x9E3779B97F4A7C15)).sum(dtype=_U)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def signatures(docs: DataFrame, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, cls, buckets) of every row; ``cls`` is null without shingles. Written to the shared folder."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enter("near_duplicates")
        for b in pieces(batches, "text"):
            sets = shingle_sets(Words(b.column(1), IS_WORD), size)
            found = [bands(s) for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    list_array(np.concatenate([np.zeros(0, _U), *found]).view(np.int64), np.array([BANDS if len(s) else 0 for s in sets]), pa.int64()),
                ],
                ["id", "n", "cls", "buckets"],
            )

    return materialize(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n long, cls binary, buckets array<long>"), "signatures")


def _fits(a: str, b: str, percent: int) -> F.Column:
    """Set sizes between which the similarity can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of classes whose full shingle sets are similar enough. Written to the shared folder.

    ``pairs`` has the classes a and b and their roots root_a and root_b, ``texts`` has (cls, text).
    """
    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b", "root_a", "root_b").join(right, "b").join(left, "a").select("a", "root_a", "root_b", "text_a", "text_b")

    def run(batches):
        enter("near_duplicates")
        held: list = [None, None]
        for b in pieces(batches, "text_b"):
            sets = shingle_sets(Words(b.column(4), IS_WORD), size)
            good = []
            for i, s in enumerate(sets):
                c = b.column(0)[i].as_py()
                if held[0] != c:
                    held[:] = c, shingle_sets(Words(b.column(3).slice(i, 1), IS_WORD), size)[0]
                t = held[1]
                small, big = (s, t) if len(s) < len(t) else (t, s)
                at = np.minimum(np.searchsorted(big, small), max(len(big) - 1, 0))
                shared = int((big[at] == small).sum()) if len(big) else 0
                good.append(shared * 100 >= percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2)], ["root_a", "root_b"]).filter(pa.array(good, pa.bool_()))

    return materialize(both.mapInArrow(run, "root_a binary, root_b binary"), "links")


def shared_histograms(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(cls, shared): for each stretch of hashes, how many shingles of the class some class of another component has.

    ``members`` has (cls, root). Two sets share no more than the sum of the lesser counts, and no more
    than either sum: a class that lacks the sum it needs is linked with nothing outside its component.
    """

    def run(batches):
        enter("near_duplicates")
        for b in pieces(batches, "text"):
            sets = shingle_sets(Words(b.column(1), IS_WORD), size)
            which = np.repeat(np.arange(b.num_rows), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), pa.array(np.concatenate([np.zeros(0, _U), *sets]).view(np.int64))], ["cls", "shingle"])

    rows = materialize(texts.mapInArrow(run, "cls binary, shingle long").join(members, "cls"), "shingles")
    open_ = rows.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("shingle")
    live = rows.join(open_, "shingle").groupBy("cls", F.pmod("shingle", F.lit(STRETCHES)).cast("int").alias("r")).agg(F.count("*").cast("int").alias("k"))
    counts = live.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("r", "k"))).alias("m")).select(
        "cls", F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda r: F.coalesce(F.col("m")[r], F.lit(0))).alias("shared")
    )
    out = materialize(counts, "shared")
    drop(rows)
    return out


class _Open:
    """The buckets whose classes fall into several components: (bucket, cls, n, root, shared)."""

    def __init__(self, rows: DataFrame):
        """``rows`` has all buckets; those of one component are left out."""
        several = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
        self.rows = materialize(rows.join(several, "bucket", "left_semi"), "open")

    def contract(self, roots: DataFrame) -> _Open:
        """The same after components have grown; ``roots`` has (node, root) of the old roots that changed."""
        old = self.rows
        renamed = old.withColumnRenamed("root", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        new = _Open(renamed.select(*old.columns))
        drop(old)
        return new

    def pairs(self, other: DataFrame, percent: int) -> DataFrame:
        """(a, b, root_a, root_b), once each: members with ``other`` (bucket, a, n_a, root_a, shared_a), where they may be similar enough."""
        most = F.aggregate(F.zip_with("shared", "shared_a", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda t, x: t + x)
        near = most * (100 + percent) >= (F.col("n") + F.col("n_a")) * percent
        found = self.rows.join(other, "bucket").where((F.col("root") != F.col("root_a")) & _fits("n", "n_a", percent) & near)
        one, two = F.struct(F.col("a"), F.col("root_a").alias("r")), F.struct(F.col("cls").alias("a"), F.col("root").alias("r"))
        found = found.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
        return found.select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.col("x.r").alias("root_a"), F.col("y.r").alias("root_b"))

    def stars(self, percent: int) -> DataFrame:
        """Pairs of each bucket's classes with ``DRAWS`` centres of it, drawn by hash."""
        fields = F.struct(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("shared").alias("shared_a"))
        drawn = [F.min_by(fields, F.xxhash64(F.lit(k), "bucket", "cls")) for k in range(DRAWS)]
        centres = self.rows.groupBy("bucket").agg(F.array(*drawn).alias("c")).select("bucket", F.explode(F.array_distinct("c")).alias("c")).select("bucket", "c.*")
        return self.pairs(centres, percent)

    def rest(self, percent: int) -> DataFrame:
        """All pairs across components that the counts do not rule out."""
        other = self.rows.select("bucket", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("shared").alias("shared_a"))
        return self.pairs(other, percent)


def _grow(roots: list[DataFrame], pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> bool:
    """Confirm pairs and contract the components that they link; False if there are none."""
    links = confirm(pairs, texts, size, percent)
    found = connected_components(links, "root_a", "root_b")
    drop(links)
    if found.isEmpty():
        drop(found)
        return False
    roots.append(found)
    return True


def link(docs: DataFrame, size: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; ``component_id`` is the least key of all documents it is linked with."""
    sig = signatures(docs, size, key, text)
    sets = sig.where(F.col("cls").isNotNull())
    classes = materialize(sets.groupBy("cls").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.first("buckets").alias("buckets")), "classes")
    members = classes.select(F.explode("buckets").alias("bucket"), "cls", "n")
    centres = members.groupBy("bucket").agg(F.min(F.struct("cls", "n")).alias("centre"), F.count("*").alias("k")).where("k > 1").select("bucket", F.col("centre.cls").alias("a"), F.col("centre.n").alias("n_a"))
    # Buckets of one class are done with; the rest are looked at twice.
    crowded = materialize(members.join(centres, "bucket"), "buckets")
    wanted = classes.join(crowded.select("cls").distinct(), "cls", "left_semi").select("cls", "rep")
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text"))
    texts = _own_text(texts.join(wanted, texts["rep"].eqNullSafe(wanted["rep"])).select("cls", "text"), size)
    stars = crowded.where((F.col("cls") != F.col("a")) & _fits("n", "n_a", percent)).select("a", F.col("cls").alias("b"), F.col("a").alias("root_a"), F.col("cls").alias("root_b"))
    roots: list[DataFrame] = []
    _grow(roots, stars.distinct(), texts, size, percent)
    named = crowded.select("bucket", "cls", "n").withColumn("root", F.col("cls"))
    if roots:
        named = named.drop("root").join(roots[0], F.col("cls") == F.col("node"), "left").select("bucket", "cls", "n", F.coalesce("root", "cls").alias("root"))
    several = _Open(named)
    drop(crowded)
    owners = materialize(several.rows.select("cls", "root").distinct(), "owners")
    shared = shared_histograms(owners, texts.join(owners, "cls", "left_semi"), size)
    enough = F.aggregate("shared", F.lit(0).cast("long"), lambda t, x: t + x) * 100 >= F.col("n") * percent
    open_ = _Open(several.rows.join(shared, "cls").where(enough).select("bucket", "cls", "n", "root", "shared"))
    drop(several.rows, owners, shared)
    if _grow(roots, open_.stars(percent), texts, size, percent):
        open_ = open_.contract(roots[-1])
    _grow(roots, open_.rest(percent), texts, size, percent)
    drop(open_.rows, texts)
    least = classes.select("cls", "rep", F.col("cls").alias("root"))
    for grown in roots:
        least = least.join(grown.withColumnRenamed("root", "next"), F.col("root") == F.col("node"), "left").select("cls", "rep", F.coalesce("next", "root").alias("root"))
    least = materialize(least, "least")
    drop(classes, *roots)
    ids = least.groupBy("root").agg(F.min("rep").alias("component"))
    component = materialize(least.join(ids, "root").select("cls", "component"), "component")
    drop(least)
    out = sig.select("id", "n", "cls").join(component, "cls", "left")
    component_id = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept"))


def _own_text(rows: DataFrame, size: int) -> DataFrame:
    """(cls, text) where the text's set is that class, once for each: rows that share an id may have other texts."""

    def run(batches):
        enter("near_duplicates")
        for b in pieces(batches, "text"):
            sets = shingle_sets(Words(b.column(1), IS_WORD), size)
            own = [len(s) > 0 and _digest(s) == c.as_py() for s, c in zip(sets, b.column(0), strict=True)]
            yield b.filter(pa.array(own, pa.bool_()))

    return materialize(rows.mapInArrow(run, "cls binary, text string").dropDuplicates(["cls"]), "texts")


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """All documents: five-word shingles, linked from a similarity of 0.75."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
