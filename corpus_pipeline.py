"""A training-data pipeline over the documents table; every stage is one operator of ``rulespire.llm``.

Stages keep the columns of documents; the last adds shard and slot. A document passes the first stage when
its language is identified, the second when it is the least doc_id of its near duplicates (five-word shingles,
similarity 0.8), the third when no window of it matches a benchmark item. The mix then takes
nine tenths of all words, each document at most once, by the weights of the sources, and the shards get equal
numbers of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulespire.llm.decontamination import clean_documents
from rulespire.llm.language import accepted_documents
from rulespire.llm.mixing import mix_documents
from rulespire.llm.near_dedup import near_dedup
from rulespire.llm.sharding import shard_rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs, share=0.9, passes=1)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_rows(docs, 40)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: The first two stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    from rulespire.llm.files import shared_folder

    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
