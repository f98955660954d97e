"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, benchmark
decontamination and SentencePiece encoding, each stage on what the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumen.llm import decontaminate, langid, near_dedup, pieces, scratch, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, or no letter in it. Where no row has a
    label to learn from, all with a letter stay."""
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    if not model.langs:
        return docs.where("text rlike '\\\\p{L}'").select(*COLUMNS)
    return langid.identify(docs, model).where("lang_pred != 'und'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 0.8 on five-word shingles stays: the least doc_id
    (then those without one), of equal ones the least text."""
    return near_dedup.without_near_duplicates(docs.select(*COLUMNS), k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove what repeats over 100 bytes but for its first place (whole characters);
    a document of which nothing but space is left goes."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), repair=True)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "utf-8")).otherwise(F.col("text"))
    out = out.withColumn("text", text).where("n_removed = 0 or text rlike '\\\\S'")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.flagged(docs, benchmark, COLUMNS).where("not contaminated").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id; decode(ids) is kept as a digest."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path(TOKENIZER), keep=("doc_id",), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece", sentencepiece),
]

#: Suffix arrays, MinHash components and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
