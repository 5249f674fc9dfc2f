"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents")).drop("row_key")


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(spark, table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place

    return place(spark, table(spark, sf_dir, "documents"))


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_frequency import frequent_lines

    return frequent_lines(spark, table(spark, sf_dir, "documents")).drop("text")


def op9_dom_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dom_crf import extract

    return extract(spark, table(spark, sf_dir, "pages"))


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .positional_index import decontaminate

    return decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op10_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity half of op10: a query of its own, as op10's columns are those of its SQL."""
    from .positional_index import proximity

    return proximity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_tree import deduplicate

    return deduplicate(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"), "spans")


def op6_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, a folder of 64 ids. A text titled as a license, or of which license
    notices are at least half of the words, is its folder's license file, whatever its length."""
    from .licenses import is_license_file, scan

    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 64).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select("doc_id", "text", path.alias("path"), is_license_file(F.col("text")).alias("is_license_file"))
    return scan(spark, files, carry=("doc_id",)).withColumn("similarity", F.round("similarity", 6))


def op7_lyndon_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lyndon_suffix import deduplicate

    return deduplicate(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_prob_minhash": op1_prob_minhash,
        "op2_temperature_mix": op2_temperature_mix,
        "op3_substring_tree": op3_substring_tree,
        "op4_sampled_splitters": op4_sampled_splitters,
        "op5_toxic_spans": op5_toxic_spans,
        "op6_license_tfidf": op6_license_tfidf,
        "op7_lyndon_suffix": op7_lyndon_suffix,
        "op8_line_frequency": op8_line_frequency,
        "op9_dom_crf": op9_dom_crf,
        "op10_positional_index": op10_positional_index,
    }


def oracle_sql() -> dict[str, str]:
    from . import line_frequency, mixing, oracles

    return {
        "op1_prob_minhash": oracles.NEAR_DUPLICATES,
        "op2_temperature_mix": mixing.SQL,
        "op3_substring_tree": oracles.SUBSTRING_WORDS,
        "op7_lyndon_suffix": oracles.SUBSTRING_BYTES,
        "op8_line_frequency": line_frequency.SQL,
        "op10_positional_index": oracles.CONTAMINATION,
    }
