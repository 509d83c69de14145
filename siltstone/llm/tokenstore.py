"""Token ids of a corpus in ascending document order, as wavelet-matrix files.

Documents are range-partitioned by id, tokenised, and packed into files of about ``FILE_TOKENS`` ids.
A file is one self-contained blob: a table of its documents (id, number of ids) and the wavelet matrix
of their ids, which answers access, count and occurrence lookups without unpacking. Files are rows of
a Parquet table, so that they live wherever Spark can write; ``export`` puts them into single files.

Defined cases: a null text is empty, and an empty document still has its end id; a very long text is
encoded whole and stays in one file, however large; rows that share an id stand side by side, ordered by a
hash of the text; repeated rows are separate documents; a null id comes first; an empty table has no files;
other columns are ignored; an id that does not fit the planes fails the write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.resident import enter, resident
from siltstone.llm.textbytes import Words, pieces
from siltstone.llm.wavelet import WaveletMatrix
from siltstone.storage import materialize

FILE_TOKENS = 1 << 18
CACHED_WORDS = 500_000


_SPACE, _LETTER, _SIGN = 0, 1, 2
_CLASS = np.full(256, _SIGN, np.uint8)  # of the bytes of plain texts
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
_CLASS[0x80:] = _LETTER
for _a, _z in ("09", "AZ", "az"):
    _CLASS[ord(_a) : ord(_z) + 1] = _LETTER


class Stretches(Words):
    """The stretches that a plain text is cut into: runs of letters and digits, or of other signs; one apostrophe joins the letters after it."""

    @staticmethod
    def _edges(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = is_word[buf]
        edge = np.ones(len(buf) + 1, np.bool_)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        seen = kind[starts] != _SPACE
        starts, ends = starts[seen], ends[seen]
        if len(starts) > 1:
            # An apostrophe alone, right before letters of the same row.
            row_start = np.zeros(len(buf) + 1, np.bool_)
            row_start[offsets] = True
            joins = (buf[starts[:-1]] == 0x27) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1]) & (kind[starts[1:]] == _LETTER) & ~row_start[starts[1:]]
            whole = np.append(True, ~joins)
            ends = ends[np.append(~joins, True)]
            starts = starts[whole]
        return starts, ends


class WordEncoder:
    """Encodes whole texts with the ``tokenizers`` library, one look-up per distinct stretch of text.

    The tokenizer drops white space, and its pattern never matches across a change between letters or
    digits and other ASCII signs, apart from an apostrophe before letters. So a text made of ASCII and
    plain Latin letters is encoded by such stretches, many texts at once; any other text is cut at ASCII
    spaces only.
    """

    _OTHER = "[^0-9A-Za-zÀ-ÖØ-öø-įı-ɏ\\x20-\\x7e\\n\\t\\r]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Special tokens are looked for before the text is cut; texts with their first sign go by spaces.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.stretches: dict[bytes, bytes] = {}

    def _by_spaces(self, text: str) -> np.ndarray:
        cache, parts = self.words, text.replace("\n", " ").split(" ")
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for p in parts:
            if p not in cache:
                cache[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
        return np.frombuffer(b"".join([cache[p] for p in parts]), "<u4")

    def _by_stretches(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = Stretches(pc.utf8_lower(column), _CLASS, fold=False)
        code, distinct = pd.factorize(w.hashes)
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        cache, encode, body = self.stretches, self.tokenizer.encode, w.buf.tobytes()
        if len(cache) > CACHED_WORDS:
            cache.clear()
        parts = []
        for lo, hi in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True):
            part = body[lo:hi]
            got = cache.get(part)
            if got is None:
                got = cache[part] = np.array(encode(part.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            parts.append(got)
        ids = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        start = np.cumsum(size) - size
        n = size[code]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.arange(total) + np.repeat(start[code] - ends + n, n)]
        sums = np.concatenate([[0], ends])
        return out, sums[w.bounds[1:]] - sums[w.bounds[:-1]]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, and how many each text has; null is empty."""
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, self._OTHER).to_numpy(zero_copy_only=False)
        for s in self.special:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        plain, counts = self._by_stretches(column if not odd.any() else pc.if_else(pa.array(odd), "", column))
        if not odd.any():
            return plain, counts
        parts, ends = [], np.cumsum(counts)
        at = 0
        for k in np.flatnonzero(odd).tolist():
            mine = self._by_spaces(column[k].as_py())
            parts += [plain[at : ends[k]], mine]
            at, counts[k] = ends[k], len(mine)
        return np.concatenate([*parts, plain[at:]]), counts


def write_files(docs: DataFrame, tokenizer: str, end_id: int, width: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The files: (part, seq, before, n_tokens, payload), ``before`` counting within the part."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enter("token_files")
        encode, part, seq, before = resident(WordEncoder, tokenizer), TaskContext.get().partitionId(), 0, 0
        held, n_held = [], 0  # (ids of documents, their numbers of tokens, tokens)

        def file():
            nonlocal seq, before, n_held
            table = pa.table({"id": pa.concat_arrays([x for x, _, _ in held]), "n": pa.array(np.concatenate([x for _, x, _ in held]))})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            head = sink.getvalue().to_pybytes()
            matrix = WaveletMatrix.build(np.concatenate([x for _, _, x in held]), width)
            blob = struct.pack("<Q", len(head)) + head + matrix.to_bytes()
            out = pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (before, pa.int64()), (n_held, pa.int64()), (blob, pa.binary()))], ["part", "seq", "before", "n_tokens", "payload"])
            seq, before, n_held = seq + 1, before + n_held, 0
            held.clear()
            return out

        for b in pieces(batches, "text"):
            tokens, counts = encode(b.column(1))
            n = counts + 1
            ends = np.cumsum(n)
            ids = np.full(int(ends[-1]), end_id, "<u4")
            inside = np.ones(len(ids), np.bool_)
            inside[ends - 1] = False
            ids[inside] = tokens
            at = 0
            while at < len(n):
                # Up to the document that fills the file.
                done = int(ends[at - 1]) if at else 0
                to = min(int(np.searchsorted(ends, done + FILE_TOKENS - n_held)) + 1, len(n))
                held.append((b.column(0).slice(at, to - at), n[at:to], ids[done : ends[to - 1]]))
                n_held += int(ends[to - 1]) - done
                at = to
                if n_held >= FILE_TOKENS:
                    yield file()
        if held:
            yield file()

    spread = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    ordered = spread.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    return materialize(ordered.mapInArrow(run, "part int, seq int, before long, n_tokens long, payload binary"), f"tokens-{kind[:8]}")


def open_file(blob: bytes) -> tuple[pa.Table, WaveletMatrix]:
    """The documents of a file (id, n) and the wavelet matrix of their ids."""
    view = memoryview(blob)
    (size,) = struct.unpack_from("<Q", view)
    return pa.ipc.open_stream(pa.BufferReader(pa.py_buffer(view[8 : 8 + size]))).read_all(), WaveletMatrix.from_bytes(view[8 + size :])


def offsets(files: DataFrame) -> DataFrame:
    """Files with ``start``: the number of ids in all files before."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A row per range partition: bounded by the number of partitions.
    return files.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before"))


def read_files(files: DataFrame, per_document: Callable[[np.ndarray], dict], fields: str, kind: str, key: str = "doc_id") -> DataFrame:
    """Decode every file; per document: key, start, n_tokens and the ``fields`` that ``per_document`` makes of its ids."""
    names = [f.split()[0] for f in fields.split(",")]

    def run(batches):
        enter("token_files")
        for b in batches:
            for i in range(b.num_rows):
                docs, matrix = open_file(b.column(1)[i].as_buffer())
                ids, n = matrix.tokens().astype("<u4"), docs["n"].to_numpy()
                ends = np.cumsum(n)
                made = [per_document(ids[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                starts = pa.array(ends - n + b.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([docs["id"].combine_chunks(), starts, pa.array(n), *(pa.array([m[x] for m in made]) for x in names)], [key, "start", "n_tokens", *names])

    return offsets(files).select("start", "payload").mapInArrow(run, f"{key} {kind}, start long, n_tokens long, {fields}")


def export(files: DataFrame, folder: str) -> int:
    """Write each file as ``folder/PART-SEQ.wvm`` on this machine; returns how many."""
    n = 0
    for row in files.select("part", "seq", "payload").toLocalIterator():
        with open(f"{folder}/{row['part']:05d}-{row['seq']:05d}.wvm", "wb") as f:
            f.write(row["payload"])
        n += 1
    return n


def _checksum(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.tobytes())}


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents, written as token files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_files(files, _checksum, "ids_crc32 long", docs.schema["doc_id"].dataType.simpleString())
