"""Corpus pipeline: language identification, line dedup, near-dedup, mixing to weights, packing.

Each stage takes all that its predecessor kept and returns the columns of documents; the last returns
the placed pieces. SQL can't express the pipeline; its tests hold it against brute force. Null texts have no
letter and go in the first stage, as do empty ones; ties go by doc_id; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlake.llm import language_id, line_dedup, minhash_dedup, mixing, packing
from interlake.llm._spark import new_folder
from interlake.llm.queries import TOKENIZER


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, as do those that are nearer to no language than to any (score 0.5 or less; that needs a single learned language)."""
    model = language_id.train(docs, learn=~language_id.held_out(F.col("doc_id"), 4, 2))
    return language_id.keep_known(docs, model, min_score=0.5)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents hold stay in the first of them only, so that one of many copies stays whole; n_chars counts what is left."""
    return line_dedup.rewrite(docs, min_docs=10, min_chars=1, first_by="doc_id")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash_dedup.keep_representatives(docs, words=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat_mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids (two bytes each), sequence, offset and, of documents that the mix takes several times, the number of the copy."""
    pieces = packing.tokenized_pieces(docs, tokenizer=TOKENIZER, most=1024, end_id=2, id_bytes=2)
    return packing.pack(pieces, n_rows=packing.expected_pieces(docs), capacity=1024, number_copies=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("minhash_dedup", keep_one_of_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
