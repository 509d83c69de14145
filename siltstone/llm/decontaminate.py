"""Benchmark decontamination over a distributed positional inverted index.

The index holds, per document, the postings (term, position) of training tokens that can take part in
a match. For exact phrases (``slop`` 0) these are terms of the benchmark, inside runs of such terms that
are as long as the shortest window: a position outside those runs cannot lie in any exact match. With
``slop`` > 0 foreign words may stand inside a match, so every posting of a benchmark term is kept; the
index must be built with a ``slop`` > 0 too. Which words are
benchmark terms is told by a bitmap of fixed size (``BITMAP`` bits), so what travels to the executors
does not grow with the benchmark; a false hit only keeps a posting that no window asks for.

A window of a benchmark item is looked up from its rarest term (the shortest posting list). Its
postings give the possible starts; the offset-adjusted lists of the other terms are then intersected
with them, which leaves exact phrases. With ``slop`` > 0 every other term may lie up to that many
positions off, seen from the rarest, which gives proximity matches.

Defined cases: a null or wordless text has no words and is hit by nothing; a null or wordless item has
no windows; very long texts are indexed whole, in slices of their own; repeated rows get equal results;
rows that share a ``doc_id`` but not the text are told apart; a null key is a key like any other; empty tables give empty or unhit results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.resident import enter
from siltstone.llm.textbytes import Words, list_array, lut, pieces
from siltstone.storage import materialize

BITMAP = 1 << 24
IS_WORD = lut(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)

_TERMS = "id {id}, uid binary, n_words long, terms array<long>"
_INDEX = "id {id}, uid binary, n_words long, terms array<long>, places array<int>"


def row_id(key: str, text: str) -> F.Column:
    """128 bits that stand for a row's key and text; repeated rows share them."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (key, text)]
    return F.unhex(F.md5(F.concat(parts[0], F.lit("\0"), parts[1])))


def _rows(table: DataFrame, key: str, text: str) -> DataFrame:
    return table.select(F.col(key).alias("id"), row_id(key, text).alias("uid"), F.col(text).alias("text"))


def _kind(table: DataFrame, key: str) -> str:
    return table.schema[key].dataType.simpleString()


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(id, uid, n_words, terms) of every item."""

    def run(batches):
        enter("decontamination")
        for b in pieces(batches, "text"):
            w = Words(b.column(2), IS_WORD)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w.counts.astype(np.int64)), list_array(w.hashes.view(np.int64), w.counts, pa.int64())], ["id", "uid", "n_words", "terms"])

    return _rows(items, key, text).mapInArrow(run, _TERMS.format(id=_kind(items, key)))


def windows(terms: DataFrame, size: int = 13) -> DataFrame:
    """(id, uid, start, terms) of every window; an item of fewer words, but not none, is one window."""
    last = F.greatest(F.col("n_words") - size, F.lit(0)).cast("int")
    return terms.where("n_words > 0").select("id", "uid", F.explode(F.sequence(F.lit(0), last)).alias("start"), F.col("terms").alias("all")).select(
        "id", "uid", "start", F.slice("all", F.col("start") + 1, F.lit(size)).alias("terms")
    )


def _bitmap(terms: DataFrame) -> bytes:
    """The bitmap of the terms, gathered as its distinct set places: BITMAP of them at most."""
    at = terms.select(F.explode("terms").alias("t")).select((F.col("t").bitwiseAND(BITMAP - 1)).cast("int").alias("at"))
    bits = np.zeros(BITMAP // 8, np.uint8)
    # Bytes of the bitmap, each the OR of its bits: at most BITMAP / 8 small rows.
    found = at.groupBy((F.col("at") / 8).cast("int").alias("byte")).agg(F.expr("bit_or(shiftleft(1, at % 8))").alias("v")).toPandas()
    bits[found["byte"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64)
    return bits.tobytes()


def _in_runs(known: np.ndarray, doc_of: np.ndarray, least: int) -> np.ndarray:
    """Marks words in runs of at least ``least`` known words of one document."""
    n = len(known)
    if not n:
        return known
    edge = np.empty(n, np.bool_)
    edge[0] = True
    edge[1:] = (known[1:] != known[:-1]) | (doc_of[1:] != doc_of[:-1])
    begins = np.flatnonzero(edge)
    lengths = np.diff(np.append(begins, n))
    return known & np.repeat(lengths >= least, lengths)


def build_index(docs: DataFrame, terms: DataFrame, size: int = 13, key: str = "doc_id", text: str = "text", slop: int = 0) -> DataFrame:
    """The index, a row per document: (id, uid, n_words, terms, places). Written to the shared folder.

    With ``slop`` 0 it serves exact phrases only; else also proximity matches of any slop.
    """
    spark = docs.sparkSession
    long_bits = spark.sparkContext.broadcast(_bitmap(terms.where(F.col("n_words") >= size)))
    short = terms.where((F.col("n_words") > 0) & (F.col("n_words") < size))
    least = short.agg(F.min("n_words")).first()[0]
    short_bits = spark.sparkContext.broadcast(_bitmap(short)) if least else None

    def run(batches):
        enter("decontamination")
        maps = [(np.frombuffer(long_bits.value, np.uint8), size)] + ([(np.frombuffer(short_bits.value, np.uint8), int(least))] if least else [])
        for b in pieces(batches, "text"):
            w = Words(b.column(2), IS_WORD)
            rows = np.repeat(np.arange(w.n_rows), w.counts)
            at = (w.hashes & np.uint64(BITMAP - 1)).astype(np.int64)
            keep = np.zeros(len(at), np.bool_)
            for bits, shortest in maps:
                known = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.bool_)
                keep |= known if slop else _in_runs(known, rows, shortest)
            found = np.flatnonzero(keep)
            counts = np.bincount(rows[found], minlength=w.n_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(w.counts.astype(np.int64)),
                    list_array(w.hashes[found].view(np.int64), counts, pa.int64()),
                    list_array((found - w.bounds[rows[found]]).astype(np.int32), counts, pa.int32()),
                ],
                ["id", "uid", "n_words", "terms", "places"],
            )

    return materialize(_rows(docs, key, text).mapInArrow(run, _INDEX.format(id=_kind(docs, key))), "postings")


def postings(index: DataFrame) -> DataFrame:
    """(uid, term, place), once for equal rows."""
    lists = index.where(F.size("terms") > 0).select("uid", F.explode(F.arrays_zip("terms", "places")).alias("p"))
    return lists.select("uid", F.col("p.terms").alias("term"), F.col("p.places").alias("place")).distinct()


def phrase_matches(index: DataFrame, wins: DataFrame, slop: int = 0) -> DataFrame:
    """(uid, place, length, window) of all places where a window occurs.

    ``window`` is a digest of its terms: equal windows are looked up once. With ``slop`` 0 the terms
    stand side by side, in order; else each lies within ``slop`` positions of where it would, and
    ``index`` must have been built with a ``slop`` > 0.
    """
    posts = postings(index)
    distinct = wins.select(F.xxhash64("terms").alias("window"), "terms").dropDuplicates(["window"])
    entries = distinct.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    lists = posts.groupBy("term").agg(F.count("*").alias("n"))
    rare = Window.partitionBy("window").orderBy("n", "offset")
    ranked = entries.join(lists, "term", "left").select("window", "length", "offset", "term", F.coalesce("n", F.lit(0)).alias("n")).withColumn("rank", F.row_number().over(rare))
    # A window with a term that has no postings occurs nowhere.
    live = ranked.where("rank = 1 and n > 0").select("window", "length", F.col("offset").alias("at"), "term")
    starts = live.join(posts, "term").select("uid", "window", "length", (F.col("place") - F.col("at")).alias("place")).where(F.col("place") >= -slop)
    wanted = starts.join(entries.select("window", "offset", "term"), "window")
    asked = wanted.select("uid", "window", "length", "place", "offset", "term")
    if slop:
        others = posts.select(F.col("uid").alias("u"), F.col("term").alias("t"), F.col("place").alias("p"))
        met = asked.join(others, (F.col("uid") == F.col("u")) & (F.col("term") == F.col("t")) & (F.abs(F.col("p") - F.col("place") - F.col("offset")) <= slop))
    else:
        met = asked.withColumn("spot", F.col("place") + F.col("offset")).join(posts.withColumnRenamed("place", "spot"), ["uid", "term", "spot"])
    return met.groupBy("uid", "window", "length", "place").agg(F.countDistinct("offset").alias("k")).where("k = length").select("uid", "place", "length", "window")


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, percent: int = 5, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, item_ids (sorted as strings), contaminated."""
    terms = materialize(item_terms(items, item_key, text), "items")
    wins = windows(terms, size)
    index = build_index(docs, terms, size, doc_key, text)
    found = materialize(phrase_matches(index, wins), "phrases")
    words = found.select("uid", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("length") - 1)).alias("word")).distinct()
    hits = words.groupBy("uid").agg(F.count("*").alias("n_hit"))
    owners = wins.select(F.xxhash64("terms").alias("window"), F.col("id").cast("string").alias("item")).distinct()
    named = found.select("uid", "window").distinct().join(owners, "window").groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    per_doc = index.select("id", "uid", "n_words").join(hits.join(named, "uid", "left"), "uid", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return per_doc.select(
        F.col("id").alias(doc_key),
        "uid",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: windows of 13 words, contaminated from one word in 20."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
