"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.mixing import mix_sources

    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.jaccard import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.sharding import shard_by_bytes

    placed = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return placed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    rows = identify(docs.withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))
    return rows.select("doc_id", "held_out", "lang_pred", "score", "n_words", "n_spans")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.media import store_texts

    return store_texts(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomspan.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.lexical import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.simhash import fingerprint_classes

    return fingerprint_classes(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.vectors import compress

    return compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_substrings": op5_substrings,
    "op6_sharding": op6_sharding,
    "op7_personal_data": op7_personal_data,
    "op8_media": op8_media,
    "op9_html": op9_html,
    "op10_tokens": op10_tokens,
    "op11_search": op11_search,
    "op12_simhash": op12_simhash,
    "op13_vector_codes": op13_vector_codes,
}
#: Models, parsers and patterns with rules of their own are beyond SQL: those queries are tested against brute force instead.
SQL: dict[str, str] = {
    "op2_mixing": sql.mixing(),
    "op3_decontamination": sql.decontamination(),
    "op4_ngram_jaccard": sql.ngram_jaccard(),
    "op5_substrings": sql.substrings(),
    "op6_sharding": sql.sharding(),
    "op11_search": sql.search(),
    "op13_vector_codes": sql.vector_codes(),
}
