"""Language identification by segmentation-marginalised unigrams.

Each language gives every piece of a fixed public vocabulary a probability. A word's probability is the
sum over all its segmentations into pieces (single bytes included), by the forward algorithm; a text's
score is the sum of its words' log probabilities. The piece probabilities are fitted by expectation
maximisation on about ``PER_LANGUAGE`` documents of each language, of ``LONGEST_SAMPLE`` bytes at most: bounds of the fit alone.

Words are runs of ASCII letters and non-ASCII bytes of the lower-cased text, each behind a word mark.
Words of more than ``LONGEST`` bytes are summed by logarithms, over all of their segmentations too.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null key counts as an
empty text where its CRC is taken; without labelled rows every text is ``und``; repeated rows get equal
results; among languages of equal score the first by name is taken; very long texts are scored whole, in slices of their own; an
empty table gives an empty result; other columns, whatever their names, are ignored, as only the key and what is new is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.resident import enter, resident
from siltstone.llm.textbytes import Words, flat, lut, mix, pieces

LONGEST = 48  # up to here plain probabilities do not underflow
SEGMENT = 4096  # bytes of long words whose pieces are looked up at once
FLOOR = 1e-6
PER_LANGUAGE = 300
LONGEST_SAMPLE = 1 << 17  # bytes of a text that is learnt from
ROUNDS = 4
_U = np.uint64
_MARK = 0x20  # stands for the vocabulary's word mark
_FILTER = 22
IS_LETTER = lut(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_BASE = _U(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces by length, as sorted hashes, behind a bitmap that most other strings fail."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        texts = {sp.id_to_piece(i).lower().replace("▁", " ").encode() for i in normal}
        texts |= {bytes((b,)) for b in range(256)}
        self.pieces = sorted(texts)
        self.n, self.longest = len(self.pieces), max(map(len, self.pieces))
        hashes = np.array([self._hash(t) for t in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order.astype(np.int32)
        self.bits = np.zeros(1 << _FILTER, np.bool_)
        self.bits[hashes >> _U(64 - _FILTER)] = True

    @staticmethod
    def _hash(t: bytes) -> int:
        h = np.zeros(1, np.uint64)
        for b in t:
            h = h * _BASE + _U(b + 1)
        return int(mix(h ^ _U(len(t)))[0])

    def matches(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All places where a piece occurs within a word: (word, from, to, piece), by ``to``."""
        word = np.repeat(np.arange(len(starts)), lengths)
        left = np.repeat(lengths, lengths) - (np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths))  # bytes to the word's end
        at = np.repeat(starts, lengths) + (np.repeat(lengths, lengths) - left)
        offset = (at - np.repeat(starts, lengths)).astype(np.int32)
        live, h = np.arange(len(word)), np.zeros(len(word), np.uint64)
        found = []
        for size in range(1, self.longest + 1):
            if size > 1:
                ok = left[live] >= size
                live, h = live[ok], h[ok]
            if not len(live):
                break
            h = h * _BASE + data[at[live] + size - 1].astype(np.uint64) + _U(1)
            key = mix(h ^ _U(size))
            maybe = np.flatnonzero(self.bits[key >> _U(64 - _FILTER)])
            place = np.minimum(np.searchsorted(self.keys, key[maybe]), self.n - 1)
            hit = self.keys[place] == key[maybe]
            who = live[maybe[hit]]
            found.append((word[who], offset[who], offset[who] + np.int32(size), self.ids[place[hit]]))
        w, a, b, p = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), (), ())))
        order = np.argsort(b.astype(np.int16), kind="stable")
        return w[order], a[order], b[order], p[order]


def vocabulary(path: str) -> Vocabulary:
    """One for each process."""
    return resident(Vocabulary, path)


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of the distinct stretches of words behind their marks; for each row's stretches which one (and the rows' bounds)."""
    column = pc.utf8_lower(column)
    buf, _ = flat(column)
    w = Words(column, IS_LETTER)
    size = w.ends - w.starts
    _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    size = size[first] + 1
    starts = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    data[starts] = _MARK
    body = np.ones(len(data), np.bool_)
    body[starts] = False
    data[body] = buf[np.repeat(w.starts[first], size - 1) + np.arange(len(data) - len(starts)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)]
    return data, starts, size, inverse, w.bounds


def _forward(hits, lengths: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """alpha[place, word, language]."""
    w, a, b, p = hits
    alpha = np.zeros((LONGEST + 1, len(lengths), probs.shape[1]))
    alpha[0] = 1
    cuts = np.searchsorted(b, np.arange(1, LONGEST + 2))
    for to in range(1, LONGEST + 1):
        lo, hi = cuts[to - 1], cuts[to]
        if lo == hi:
            break
        who, part = w[lo:hi], alpha[a[lo:hi], w[lo:hi]] * probs[p[lo:hi]]
        for k in range(probs.shape[1]):
            alpha[to, :, k] = np.bincount(who, part[:, k], len(lengths))
    return alpha


def _hits_from(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, size: np.ndarray, lo: int):
    """(word, to, piece) of the pieces from each place of [lo, lo + SEGMENT), and the bounds of the places."""
    live = np.flatnonzero(size > lo)
    w, a, b, q = vocab.matches(data, starts[live] + lo, np.minimum(size[live] - lo, SEGMENT + vocab.longest - 1))
    order = np.argsort(a.astype(np.int16), kind="stable")
    cuts = np.searchsorted(a[order], np.arange(SEGMENT + 1))
    return live[w[order]], b[order].astype(np.int64) + lo, q[order], cuts


def _long_forward(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, size: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """log alpha[place, word, language] of words of any length."""
    most = int(size.max())
    la = np.full((most + 1, len(size), logp.shape[1]), -np.inf)
    la[0] = 0
    for lo in range(0, most, SEGMENT):
        w, to, q, cuts = _hits_from(vocab, data, starts, size, lo)
        for k in range(min(SEGMENT, most - lo)):
            x = slice(cuts[k], cuts[k + 1])  # of one word, pieces from one place end at different ones
            la[to[x], w[x]] = np.logaddexp(la[to[x], w[x]], la[lo + k, w[x]] + logp[q[x]])
    return la


def _long_expected(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, size: np.ndarray, p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The expected number of each piece in words of any length, in one language."""
    logp, most, expected = np.log(p), int(size.max()), np.zeros(vocab.n)
    la = _long_forward(vocab, data, starts, size, logp[:, None])[:, :, 0]
    total = la[size, np.arange(len(size))]
    lb = np.full_like(la, -np.inf)
    lb[size, np.arange(len(size))] = 0
    for lo in range((most - 1) // SEGMENT * SEGMENT, -1, -SEGMENT):
        w, to, q, cuts = _hits_from(vocab, data, starts, size, lo)
        share = np.zeros(len(q))
        for k in range(min(SEGMENT, most - lo) - 1, -1, -1):
            x = slice(cuts[k], cuts[k + 1])
            part = lb[to[x], w[x]] + logp[q[x]]
            np.logaddexp.at(lb[lo + k], w[x], part)
            share[x] = np.exp(la[lo + k, w[x]] + part - total[w[x]]) * count[w[x]]
        expected += np.bincount(q, share, vocab.n)
    return expected


def _long_blocks(size: np.ndarray) -> list[np.ndarray]:
    """The words of more than LONGEST bytes, in blocks of like lengths."""
    order = np.argsort(size, kind="stable")
    order, out = order[size[order] > LONGEST], []
    while len(order):
        n = 1
        while n < len(order) and (n + 1) * int(size[order[n]]) <= 1 << 20:
            n += 1
        out.append(order[:n])
        order = order[n:]
    return out


def word_logs(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, size: np.ndarray, probs: np.ndarray, block: int = 20_000) -> np.ndarray:
    """Log probability of each word in each language."""
    logs = np.empty((len(size), probs.shape[1]))
    short = np.flatnonzero(size <= LONGEST)
    for i in range(0, len(short), block):
        at = short[i : i + block]
        n = size[at]
        alpha = _forward(vocab.matches(data, starts[at], n), n, probs)
        logs[at] = np.log(np.maximum(alpha[n, np.arange(len(n))], 1e-300))
    for at in _long_blocks(size):
        logs[at] = _long_forward(vocab, data, starts[at], size[at], np.log(probs))[size[at], np.arange(len(at))]
    return logs


def fit(texts: list[str], labels: list[str], vocab: Vocabulary, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities by language) by expectation maximisation."""
    languages = sorted(set(labels))
    probs = np.empty((vocab.n, len(languages)))
    for k, language in enumerate(languages):
        data, starts, size, inverse, _ = distinct_words(pa.array([t for t, x in zip(texts, labels, strict=True) if x == language], pa.string()))
        weight = np.bincount(inverse, minlength=len(starts)).astype(float)
        short = np.flatnonzero(size <= LONGEST)
        parts = [short[i : i + 20_000] for i in range(0, len(short), 20_000)]
        blocks = [(vocab.matches(data, starts[x], size[x]), size[x], weight[x]) for x in parts]
        long = _long_blocks(size)
        p = np.full(vocab.n, 1 / vocab.n)
        for _ in range(rounds):
            expected = np.full(vocab.n, 0.01)
            for hits, n, count in blocks:
                alpha = _forward(hits, n, p[:, None])[:, :, 0]
                w, a, b, q = hits
                beta = np.zeros_like(alpha)
                beta[n, np.arange(len(n))] = 1
                # Backwards, by where pieces start.
                order = np.argsort(a.astype(np.int8), kind="stable")
                cuts = np.searchsorted(a[order], np.arange(LONGEST + 1))
                for from_ in range(LONGEST - 1, -1, -1):
                    part = order[cuts[from_] : cuts[from_ + 1]]
                    if len(part):
                        beta[from_] += np.bincount(w[part], beta[b[part], w[part]] * p[q[part]], len(n))
                total = np.maximum(alpha[n, np.arange(len(n))], 1e-300)
                expected += np.bincount(q, alpha[a, w] * p[q] * beta[b, w] / total[w] * count[w], vocab.n)
            for x in long:
                expected += _long_expected(vocab, data, starts[x], size[x], p, weight[x])
            p = np.maximum(expected / expected.sum(), FLOOR)
            p /= p.sum()
        probs[:, k] = p
    return languages, probs


def held_out(key: str) -> F.Column:
    """Rows whose labels are not learnt from: CRC-32 of the key's decimal text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(rows: DataFrame, label: str, key: str, text: str, most: int) -> tuple[list[str], list[str]]:
    """About ``most`` rows of each label, chosen by a hash of the key: one for each key, of ``LONGEST_SAMPLE`` bytes at most."""
    spread = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30))
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).collect()  # a row per language
    if not counts:
        return [], []
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r[label], int(min(1.0, most / r["n"]) * (1 << 30)))])
    got = rows.where((spread < limits[F.col(label)]) & (F.octet_length(text) <= LONGEST_SAMPLE)).groupBy(F.col(key).alias("k"), F.col(label).alias("l")).agg(F.min(text).alias("t"))
    found = sorted(((r["l"], str(r["k"]), r["t"]) for r in got.toLocalIterator()))
    return [t for _, _, t in found], [x for x, _, _ in found]


def classify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row; the score is the posterior probability under even priors."""
    languages, probs = model
    sent = docs.sparkSession.sparkContext.broadcast(probs)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enter("language_id")
        vocab = vocabulary(vocab_path)
        for b in pieces(batches, "text", 2 << 20):
            column = b.column(1)
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if languages:
                data, starts, size, inverse, bounds = distinct_words(column)
                logs = word_logs(vocab, data, starts, size, sent.value)
                sums = np.zeros((len(inverse) + 1, len(languages)))
                np.cumsum(logs[inverse], axis=0, out=sums[1:])
                total = sums[bounds[1:]] - sums[bounds[:-1]]
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names = np.where(lettered, np.array(languages, object)[best], "und")
            else:
                score, names = np.zeros(b.num_rows), np.full(b.num_rows, "und", object)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], [key, "lang_pred", "score"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model learnt from those not held out."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    texts, labels = sample(docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()), "lang", "doc_id", "text", PER_LANGUAGE)
    model = fit(texts, labels, vocabulary(path)) if texts else ([], np.zeros((1, 0)))
    return classify(docs, model, path).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
