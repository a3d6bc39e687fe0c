"""A training corpus in five stages: language ID, near-dedup, suffix dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontamination, language_id, near_dedup, packing, suffix_dedup
from maskwright.llm.common import Scratch, tokenizer_file

#: A language's share of the likelihood that a document needs.
SURE = 0.5
#: Pieces of text that packing remembers, fewer than alone: executors carry the earlier stages' heap by then.
REMEMBER = 100_000


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Null and empty texts, texts without a letter, and
    undecided ones, go; repeated rows are judged alike. Without any labelled row nothing can be
    recognised, and every document stays. An empty table stays empty."""
    model = language_id.fit(docs)
    return language_id.keep_recognised(docs, model, SURE) if model.langs else docs


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component (five words, 0.8) the document with the smallest doc_id. Null
    and blank texts are linked with nothing; rows that repeat a doc_id, and rows without one, stay."""
    return near_dedup.drop_near_duplicates(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words, and the strings of 400 bytes, that repeat; a document
    of which nothing is left goes. Null and empty texts stay; of repeated rows each loses what they share."""
    full = "_full"
    while full in docs.columns:
        full = "_" + full
    cut = suffix_dedup.remove_repeats(docs.withColumn(full, F.octet_length(F.col("text").cast("string"))), words=suffix_dedup.PASSAGE)
    cut = cut.where((F.octet_length("text") > 0) | (F.coalesce(F.col(full), F.lit(0)) == 0)).drop(full)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in the benchmark. Null and empty
    texts have no words and stay; repeated rows are judged alike; an empty benchmark drops nothing."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens. A null or empty text is its end id
    alone; each of repeated rows is packed; an empty table has no pieces."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), remember=REMEMBER)


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", keep_one_of_near_duplicates),
    ("suffix_dedup", cut_repeated_strings),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
