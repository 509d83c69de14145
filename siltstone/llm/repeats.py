"""Exact removal of repeated byte strings across a corpus, by suffix arrays over bounded shards.

Removed is every byte covered by a string of ``LIMIT`` bytes that also starts earlier: in a document of
smaller key, or earlier in the same one. The strings are judged on the input.

1. Anchors. Among the ``WINDOW`` short strings in each string of LIMIT bytes one is chosen by hash, so
   equal strings choose equal anchors. The starts that chose one anchor are neighbours; they and their
   text make a span. Anchors that occur once need no further look: no string there is repeated.
2. Equal spans. Spans of one anchor with equal text are told by a digest of 64 bits, with partial aggregation; all
   but the earliest are repeats as a whole.
3. Suffix arrays. Anchors that are left with several different spans are dealt to shards of bounded
   size. A shard's spans are joined into one string whose suffix array is built by induced sorting;
   runs of suffixes whose permuted common prefixes reach LIMIT are equal strings, of which all but the
   earliest start are repeats.
4. An anchor with more than ``CROWD`` different spans (a short passage in very many surroundings) would
   not fit a shard. Its strings are grouped by 128-bit digests instead, with partial aggregation.
5. The repeats are brought back to their documents, merged, and cut out.

Defined cases: a null text is empty; a text shorter than LIMIT is kept whole; very long texts are anchored whole, in slices of their own; rows that share a key, or
have none, come in the order of key (null first) and text hash; an empty table gives an empty result;
a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.resident import enter
from siltstone.llm.suffixes import Hashes, common_prefixes, suffix_array
from siltstone.llm.textbytes import flat, mix, pieces
from siltstone.storage import drop, materialize

LIMIT = 100
ANCHOR = 32
WINDOW = LIMIT - ANCHOR + 1
CROWD = 4000
SHARD_BYTES = 2 << 20
_U = np.uint64
_INTERVALS = "ord long, start int, stop int"


class Spans:
    """The spans of the rows of a slice: row, first start, number of starts, anchor hash and span hash."""

    def __init__(self, column: pa.Array):
        self.buf, self.offsets = flat(column)
        n, size = len(self.buf), np.diff(self.offsets)
        self.hashes = Hashes(self.buf)
        empty = np.zeros(0, np.int64)
        if n < LIMIT or size.max(initial=0) < LIMIT:
            self.row = self.start = self.count = empty
            self.anchor = self.digest = np.zeros(0, _U)
            return
        at = np.arange(n - ANCHOR + 1)
        h = mix(self.hashes.of(at, ANCHOR))
        # Of equal hashes the last place wins, wherever the text lies.
        order = h >> _U(26) << _U(26) | ((1 << 26) - 1 - at % (1 << 26)).astype(_U)
        least = self._sliding(order, WINDOW)
        chosen = at[: len(least)] // (1 << 26) * (1 << 26)
        place = (1 << 26) - 1 - (least & _U((1 << 26) - 1)).astype(np.int64)
        place += chosen
        place += (place < at[: len(least)]) * (1 << 26)
        row = np.repeat(np.arange(len(size)), np.maximum(size - LIMIT + 1, 0))
        starts = np.arange(len(row)) + np.repeat(self.offsets[:-1] - np.cumsum(np.maximum(size - LIMIT + 1, 0)) + np.maximum(size - LIMIT + 1, 0), np.maximum(size - LIMIT + 1, 0))
        anchor = place[starts]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
        self.count = np.diff(np.append(first, len(starts)))
        self.row, self.start = row[first], starts[first]
        where = anchor[first]
        self.anchor = h[where]
        lead = (where - self.start).astype(_U)
        self.digest = mix(self.hashes.of(self.start, self.count + LIMIT - 1) + mix(lead * _U(256) + self.count.astype(_U)))

    @staticmethod
    def _sliding(x: np.ndarray, width: int) -> np.ndarray:
        """The least of every ``width`` neighbours."""
        n = len(x)
        padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, _U)
        padded[:n] = x
        blocks = padded.reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _spans(docs: DataFrame) -> DataFrame:
    """(h, digest, ord, at): at holds the first start and the number of starts."""

    def run(batches):
        enter("repeated_strings")
        for b in pieces(batches, "text"):
            s = Spans(b.column(1))
            local = s.start - s.offsets[s.row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.anchor.view(np.int64)), pa.array(s.digest.view(np.int64)), b.column(0).take(pa.array(s.row)), pa.array(local * 128 + s.count)], ["h", "digest", "ord", "at"]
            )

    return docs.select("ord", "text").mapInArrow(run, "h long, digest long, ord long, at long")


def _anchors(docs: DataFrame) -> DataFrame:
    """The anchor hash of every span."""

    def run(batches):
        enter("repeated_strings")
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(Spans(b.column(0)).anchor.view(np.int64))], ["h"])

    return docs.select("text").mapInArrow(run, "h long")


def _fetch(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(ord, text, list) of the documents that the spans (h, ord, at) lie in."""
    lists = wanted.groupBy("ord").agg(F.collect_list(F.struct("h", "at")).alias("list"))
    return docs.join(lists, "ord").select("ord", "text", "list")


def _cut_out(found: DataFrame, shards: int) -> DataFrame:
    """(shard, ord, at, body) of the spans asked for."""

    def run(batches):
        enter("repeated_strings")
        for b in pieces(batches, "text"):
            buf, offsets = flat(b.column(1))
            lists = b.column(2)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            h, at = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            start, size = offsets[row] + at // 128, at % 128 + LIMIT - 1
            ends = np.cumsum(size)
            data = buf[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]
            body = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([pa.array((mix(h.view(_U)) % _U(shards)).astype(np.int32)), b.column(0).take(pa.array(row)), pa.array(at), body], ["shard", "ord", "at", "body"])

    return found.mapInArrow(run, "shard int, ord long, at long, body binary")


def shard_repeats(ord_: np.ndarray, at: np.ndarray, body: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of the spans of a shard: (ord, start) of the strings that also start earlier in the shard."""
    buf, offsets = flat(body)
    size = np.diff(offsets)
    # The spans behind one another, each closed by a symbol that no text has.
    t = np.zeros(len(buf) + len(size), np.int64)
    inside = np.ones(len(t), np.bool_)
    ends = np.cumsum(size + 1)
    inside[ends - 1] = False
    t[inside] = buf.astype(np.int64) + 1
    sa = suffix_array(t, LIMIT)
    same = common_prefixes(t, sa, LIMIT, exact=False)[sa] >= LIMIT
    span = np.repeat(np.arange(len(size)), size + 1)
    offset = np.arange(len(t)) - np.repeat(ends - size - 1, size + 1)
    whole = offset <= size[span] - LIMIT
    run = np.cumsum(~same)
    live = whole[sa] & (np.bincount(run)[run] > 1)
    places, run = sa[live], run[live]
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    o, start = ord_[span[places]], at[span[places]] // 128 + offset[places]
    order = np.lexsort((start, o, run))
    o, start, run = o[order], start[order], run[order]
    later = np.concatenate([[False], run[1:] == run[:-1]])
    later[1:] &= (o[1:] != o[:-1]) | (start[1:] != start[:-1])
    return o[later], start[later]


def _intervals(ord_: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring starts as covered bytes."""
    order = np.lexsort((start, ord_))
    o, s = ord_[order], start[order]
    first = np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)])[: len(o)]
    last = np.append(first[1:], True)[: len(o)]
    return pa.RecordBatch.from_arrays([pa.array(o[first]), pa.array(s[first].astype(np.int32)), pa.array((s[last] + LIMIT).astype(np.int32))], ["ord", "start", "stop"])


def _by_suffix_array(cut: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        o, s = shard_repeats(table["ord"].to_numpy(), table["at"].to_numpy(), table["body"].combine_chunks())
        return pa.Table.from_batches([_intervals(o, s)])

    return cut.groupBy("shard").applyInArrow(run, _INTERVALS)


def _by_digest(found: DataFrame) -> DataFrame:
    """Repeats among the strings of crowded anchors."""

    def run(batches):
        enter("repeated_strings")
        for b in pieces(batches, "text"):
            buf, offsets = flat(b.column(1))
            lists = b.column(2)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = lists.flatten().field(1).to_numpy(zero_copy_only=False)
            n = at % 128
            start = np.repeat(at // 128, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(row, n)
            whole = Hashes(buf).of(offsets[row] + start, LIMIT)
            other = Hashes(buf.astype(np.int64) + 257).of(offsets[row] + start, LIMIT)
            yield pa.RecordBatch.from_arrays([pa.array(mix(whole).view(np.int64)), pa.array(mix(other).view(np.int64)), b.column(0).take(pa.array(row)), pa.array(start.astype(np.int32))], ["x", "y", "ord", "start"])

    strings = materialize(found.mapInArrow(run, "x long, y long, ord long, start int"), "strings")
    first = strings.groupBy("x", "y").agg(F.min(F.struct("ord", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("x", "y", "first")
    return strings.join(first, ["x", "y"]).where(F.struct("ord", "start") > F.col("first")).select("ord", "start", (F.col("start") + LIMIT).cast("int").alias("stop"))


def ordered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows with ``__ord``, a long that rises with the key: the key itself if that is whole and unique."""
    kind = docs.schema[key].dataType.simpleString()
    if kind in ("bigint", "int", "smallint", "tinyint"):
        twice = docs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n").__gt__(1) | F.col(key).isNull())
        if not twice.limit(1).count():
            return docs.withColumn("__ord", F.col(key).cast("long"))
    by_text = F.xxhash64(text)
    return materialize(docs.repartitionByRange(F.col(key), by_text).sortWithinPartitions(F.col(key), by_text).withColumn("__ord", F.monotonically_increasing_id()), "ordered")


def find_repeats(docs: DataFrame) -> DataFrame:
    """(ord, start, stop) of repeated bytes; ``docs`` has ord and text."""
    repeated = materialize(_anchors(docs).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    spans = materialize(_spans(docs).join(repeated, "h"), "spans")
    drop(repeated)
    groups = materialize(spans.groupBy("h", "digest").agg(F.min(F.struct("ord", "at")).alias("first"), F.count("*").alias("n")), "groups")
    again = groups.where("n > 1").select("h", "digest", "first")
    copies = spans.join(again, ["h", "digest"]).where(F.struct("ord", "at") > F.col("first"))
    start = F.expr("cast(at div 128 as int)")
    whole = materialize(copies.select("ord", start.alias("start"), (start + (F.col("at") % 128).cast("int") + LIMIT - 1).cast("int").alias("stop")), "copies")
    drop(spans)
    several = groups.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    wanted = materialize(groups.join(several, "h").select("h", "k", F.col("first.ord").alias("ord"), F.col("first.at").alias("at")), "wanted")
    drop(groups)
    size = wanted.where(F.col("k") <= CROWD).agg(F.sum(F.col("at") % 128 + LIMIT)).first()[0] or 0
    found = [whole]
    if size:
        cut = _cut_out(_fetch(wanted.where(F.col("k") <= CROWD), docs), max(1, int(size // SHARD_BYTES) + 1))
        found.append(materialize(_by_suffix_array(cut), "shards"))
    crowded = wanted.where(F.col("k") > CROWD)
    if crowded.limit(1).count():
        found.append(materialize(_by_digest(_fetch(crowded, docs)), "crowds"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with n_bytes, n_removed, n_spans, kept_bytes (the bytes that stay) and kept_text.

    ``kept_text`` is without characters of which only some bytes stay. Columns of these names, behind
    ``prefix``, and of the names __ord, __cuts and __body are replaced.
    """
    from pyspark.sql import types as T

    made = [prefix + c for c in ("n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_text")]
    docs = docs.drop(*made, "__ord", "__cuts", "__body")
    source = ordered(docs, key, text)
    repeats = find_repeats(source.select(F.col("__ord").alias("ord"), F.col(f"`{text}`").alias("text")))
    lists = repeats.groupBy(F.col("ord").alias("__ord")).agg(F.collect_list(F.struct("start", "stop")).alias("__cuts"))
    joined = source.join(lists, "__ord", "left").drop("__ord")
    kept = [c for c in docs.columns if c not in made]
    joined = joined.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("__body"), "__cuts")
    schema = T.StructType([docs.schema[c] for c in kept])
    for name, kind in zip(made, (T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.StringType()), strict=True):
        schema = schema.add(name, kind)

    def run(batches):
        enter("repeated_strings")
        for b in pieces(batches, "__body"):
            n, removed, spans, bodies = [], [], [], []
            for body, cuts in zip(b.column(len(kept)), b.column(len(kept) + 1), strict=True):
                data = body.as_py() or b""
                n.append(len(data))
                if not cuts.is_valid:
                    removed.append(0), spans.append(0), bodies.append(data)
                    continue
                start, stop = (cuts.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, stop, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                bodies.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n), pa.array(removed), pa.array(spans), pa.array(bodies, pa.binary()), pa.array([x.decode(errors="ignore") for x in bodies], pa.string())], schema.names)

    return joined.mapInArrow(run, schema)


def op7_repeated_strings(spark, sf_dir: str) -> DataFrame:
    """All documents without the strings of 100 bytes that start earlier somewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = cut_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
