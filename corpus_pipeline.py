"""A training corpus from raw documents, in five stages that each work on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import shared_dir
from loomspan.llm.decontamination import drop_leaks, find_leaks
from loomspan.llm.jaccard import one_of_each, similarity_classes
from loomspan.llm.language import fit, spoken
from loomspan.llm.mixing import mixed_documents
from loomspan.llm.sharding import shard_by_bytes


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language that most of their words are in, by a model of the documents' own labels."""
    return spoken(docs, fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: five-word n-grams, similarity 0.8."""
    return one_of_each(docs, similarity_classes(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return drop_leaks(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there; columns of these names give way to them."""
    placed = shard_by_bytes(docs, 24)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*own, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Language identification and the n-gram join cannot be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
