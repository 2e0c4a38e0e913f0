"""Corpus pipeline: toxic documents go, then copies, then benchmark passages; the rest is mixed and tokenized."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hourlens.llm import decontaminate, minhash, mixing, token_files, toxicity
from hourlens.llm.shared import written

#: Stages on word shingles link at 80 percent; as sure to find such pairs as the operator is at 85.
NEAR = minhash.Settings(percent=80, bands=32, agree=130)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows under the toxicity threshold of their language; a model without labels keeps all."""
    return toxicity.harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id; texts without words stay."""
    return minhash.without_copies(docs, NEAR)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, none to three times."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows in the order of doc_id (null first), and what they hold of each row."""
    return token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: SQL cannot say the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read again by the next.

    Null and empty texts pass the first three stages and have the end id alone
    in the files; rows with a null doc_id take part like others; equal rows are
    one after the second stage; ties go to the smaller doc_id and then the
    smaller text; columns beside doc_id, text, lang and source may have any
    names; empty tables give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
