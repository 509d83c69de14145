"""Cleaning a document corpus in stages; each stage takes what its predecessor kept.

toxicity           documents that the span tagger's score calls toxic go
near_duplicates    one document of each group of near copies stays, that of the least id; of equal rows one
repeated_strings   byte strings that also start earlier are cut out of the texts
decontamination    documents with a twentieth or more of their words in benchmark passages go
byte_bpe           texts are encoded and decoded; ids, counts and digests are added

The first four return the columns of ``documents``. A stage that changes a text changes ``n_chars`` with
it. Null texts stay null, empty ones empty; very long texts, repeated rows and other columns, whatever
their names, pass through all stages; of equal texts one stays; rows without a ``doc_id`` are rows like any
others; an empty table gives an empty result. Only a column named like one that ``byte_bpe`` adds is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.bpe import encode_decode
from siltstone.llm.decontaminate import contamination, row_id
from siltstone.llm.neardup import link
from siltstone.llm.repeats import cut_repeats
from siltstone.llm.toxicity import learn, tag
from siltstone.storage import drop, materialize

ADDED = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): the other columns out of the way of what the operators call theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))


def _unpacked(packed: DataFrame, docs: DataFrame, *more: str, **changed) -> DataFrame:
    """The columns of ``docs`` again, some of them changed, and more of those of ``packed``."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c) for c in docs.columns if c not in more}
    return packed.select(*[changed.get(c, value).alias(c) for c, value in own.items()], *more)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(tag(_packed(docs), model, spans=False).where("tox_score < 0.5"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows are told apart by id and text: rows that share an id may be of different groups.
    packed = _packed(docs).withColumn("uid", row_id("doc_id", "text"))
    found = materialize(link(packed.select(F.struct("doc_id", "uid").alias("row"), "text"), key="row"), "links")
    kept = found.where("kept").groupBy("row.uid").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("words"))
    repeated = (F.col("n") > 1) & (F.col("words") > 0)  # a text without words has no copies
    once = packed.join(kept.where(~repeated), "uid", "left_semi")
    several = packed.join(kept.where(repeated), "uid", "left_semi").groupBy("uid").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "rest")])
    return _unpacked(once.unionByName(several), docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut, changed = cut_repeats(_packed(docs)), F.col("n_removed") > 0
    columns = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return _unpacked(cut, docs, **columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bad = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("uid").distinct()
    return _unpacked(_packed(docs).withColumn("uid", row_id("doc_id", "text")).join(bad, "uid", "left_anti"), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(_packed(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return _unpacked(out, docs, *ADDED, text=F.when(F.col("text").isNotNull(), F.col("decoded_text")))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: The stages are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            if last is not None:
                drop(last)
            last = docs
    return docs
