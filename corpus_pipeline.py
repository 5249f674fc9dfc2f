"""A corpus pipeline of five training-data operators; every stage works on all rows that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import common, mixing, near_dup, positional_index, sharding, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the span tagger, trained on the labelled documents, scores at 0.5 or more, with or without doc_id."""
    model = toxicity.learn(spark, docs, common.table(spark, sf_dir, "labels"))
    return toxicity.tag(model, docs, spans=False, spark=spark, carry=REST).where("predicted = 0").select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every class of near-duplicates: that of the least doc_id, or any if none has one."""
    kept = near_dup.near_duplicates(spark, docs).where("kept").select(F.col("row_key").alias("d"))
    rows = near_dup.row_keys(docs.select(*COLUMNS), common.Scratch(spark, "near-dup-rows"))
    return rows.join(kept, "d", "left_semi").dropDuplicates(["d"]).select(*COLUMNS)  # repeated rows share a key


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold benchmark phrases in a twentieth of their words or more."""
    found = positional_index.decontaminate(spark, docs, common.table(spark, sf_dir, "benchmark"), carry=REST)
    return found.where("NOT contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the temperature mixture uses them."""
    named = docs.withColumn("found_source", F.col("source"))  # the operator's own source column has no nulls
    return mixing.mix(spark, named, carry=("text", "lang", "found_source", "n_chars")).withColumn("source", F.col("found_source")).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.place(spark, docs, carry=REST).select(*COLUMNS, "size", "shard", "slot")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL states a trained tagger; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. Each stage's rows are a Parquet table in the shared folder; when the next stage has
    written its own, that table and the tables of the operator go. The last stage's table is the result's."""
    steps = common.Scratch(spark, "pipeline-" + uuid.uuid4().hex[:8])
    mark = len(common.Scratch.opened)
    docs = common.table(spark, sf_dir, "documents").select(*[F.col(c) for c in COLUMNS])
    for k, (name, stage) in enumerate(STAGES):
        docs = steps.put(stage(spark, docs, sf_dir), f"{k}-{name}", "snappy")
        steps.keep(f"{k}-{name}")
        common.Scratch.release(mark)
    return docs
