"""The corpus pipeline: five stages over documents, each on what its predecessor kept.

Defined results: documents without text or words are kept by the toxicity stage, are one group for exact dedup (null counts as empty),
stay in near dedup, and are not taken by the mixture; of repeated rows one stays; a null doc_id or source is handled as a value of
its own; further columns, whatever their names, pass through all stages but the last; very long texts are handled in whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavelake.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from pavelake.llm.common import ship_package, table
from pavelake.operators.graph import shared_folder

#: Near copies share so many hundredths of their word shingles; 85 is the contract of op9_near_dedup alone.
NEAR = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Labels are learnt from this stage's own documents."""
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays."""
    ship_package(spark)
    return near_dedup.keep_one(docs, NEAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each document of the mixture."""
    ship_package(spark)
    return bpe.encode(docs, bpe.default_tokenizer(), whole=False, keep=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: A trained field and a tokenizer have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def work_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares; a temporary one only on a local master that names none."""
    return f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
