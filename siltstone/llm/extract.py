"""Main text of HTML pages by a linear-chain CRF over their leaf blocks.

The model is trained on the labelled pages of ``html_training``; Viterbi picks the blocks of the
article. What can hold no article text (scripts, styles, head, form lists) makes no blocks.

Defined cases: a null or empty page, or one without article blocks, has an empty text; unclosed tags,
stray tags and cut-off pages are read as far as they go; very long pages are read whole, in slices of their
own; repeated rows get equal results; an empty table gives an empty result; other columns pass, but for
those whose names clash with the new ones, which are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.crf import Crf, Ragged, train
from siltstone.llm.html_blocks import BITS, Blocks, blocks, leaf_blocks
from siltstone.llm.html_training import labelled_pages
from siltstone.llm.resident import enter
from siltstone.llm.textbytes import pieces

_MARKS = ("\x01", "\x02")  # ends of labelled texts, while the training pages are split


def _firsts(counts: list[int]) -> np.ndarray:
    first = np.zeros(sum(counts), np.bool_)
    starts = np.cumsum([0, *counts[:-1]])[np.array(counts, np.int64) > 0] if counts else []
    first[np.asarray(starts, np.int64)] = True
    return first


def training_set(n: int = 900, seed: int = 11) -> tuple[Ragged, np.ndarray, np.ndarray]:
    """(features, labels, first-of-page marks) of the blocks of the labelled pages."""
    feats, labels, counts = [], [], []
    for page in labelled_pages(n, seed):
        marked = "".join(text if label is None else text + _MARKS[label] for text, label in page)
        plain = blocks("".join(text for text, _ in page))
        got = blocks(marked)
        if len(got) != len(plain):
            continue
        for (text, _), (_, f) in zip(got, plain, strict=True):
            labels.append(int(text.count(_MARKS[1]) > text.count(_MARKS[0])))
            feats.append(f)
        counts.append(len(got))
    return Ragged(feats), np.array(labels), _firsts(counts)


def _scores(crf: Crf, found: list[Blocks]) -> np.ndarray:
    """The labels' scores of all blocks: of their own features, and of their ancestors' as running sums.

    Weights count in whole units of 2**-20, so sums are exact, whatever order they are made in.
    """
    unit, before = np.round(crf.weights * 2.0**20), np.cumsum([0, *(len(x) for x in found)])
    own = Crf(unit, crf.trans, crf.start).scores(Ragged([f for x in found for _, f in x]))
    moved = [(i + b, f, sign) for x, b in zip(found, before.tolist()) for i, f, sign in [*x.changes, *((len(x), f, -1) for f in x.left())]]
    if moved:
        at, feature, sign = np.array(moved).T
        delta = np.zeros((len(own) + 1, crf.k))
        np.add.at(delta, at, unit[feature] * sign[:, None])
        own += np.cumsum(delta, axis=0)[:-1]
    return own / 2.0**20


@lru_cache(maxsize=1)
def model() -> Crf:
    """Trained once for each process; the same everywhere, as nothing in it is left to chance."""
    feats, labels, first = training_set()
    return train(feats, labels, first, 1 << BITS, rounds=40, rate=0.3)


def extract(pages: DataFrame, html: str = "html", crf: Crf | None = None) -> DataFrame:
    """The columns of ``pages`` but the markup, and main_text and n_blocks (those kept)."""
    from pyspark.sql import types as T

    sent = pages.sparkSession.sparkContext.broadcast(crf or model())
    made = ("main_text", "n_blocks")
    kept = [c for c in pages.columns if c not in made and c != html]
    schema = T.StructType([pages.schema[c] for c in kept]).add("main_text", T.StringType()).add("n_blocks", T.IntegerType())

    def run(batches):
        enter("html_extraction")
        crf = sent.value
        for b in pieces(batches, "__html"):
            found = [leaf_blocks(x.as_py() or "") for x in b.column(b.num_columns - 1)]
            counts = [len(x) for x in found]
            labels = crf.viterbi(_scores(crf, found), _firsts(counts)).tolist() if sum(counts) else []
            texts, n, at = [], [], 0
            for x in found:
                mine = [t for (t, _), y in zip(x, labels[at : at + len(x)], strict=True) if y]
                at += len(x)
                texts.append("\n".join(mine))
                n.append(len(mine))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(n, pa.int32())], schema.names)

    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").alias("__html")).mapInArrow(run, schema)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
