"""Helpers shared by the training-data operators: tables, shared scratch space, connected classes."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the white-space word contract, as a Java regular expression class.
SEP = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a single-process ``local`` master may fall back to a temporary folder; on a cluster an unset
    setting is an error, because executors would not see each other's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _local_dir()
    return at.rstrip("/")


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="sheafline-"))
    return _LOCAL[0]


class Scratch:
    """Parquet tables in the shared folder; they cut lineage and survive lost executors.

    Tables that the result doesn't read are dropped by ``keep``; the others live until ``release`` or as long as the folder.
    """

    opened: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        Scratch.opened.append(self)

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and read it back; shuffle files that fed it become free to be cleaned."""
        schema = df.schema
        self.names.append(name)
        df.write.option("compression", codec).parquet(f"{self.root}/{name}")
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        with contextlib.suppress(Exception):  # a table that stays costs disk only
            path.getFileSystem(conf).delete(path, True)


    def keep(self, *names: str) -> None:
        """Drop all tables but these."""
        for name in [n for n in self.names if n not in names]:
            self.drop(name)
            self.names.remove(name)

    @staticmethod
    def release(since: int) -> None:
        """Drop the tables of all scratches that were opened after the first ``since``: their results have been written."""
        for scratch in Scratch.opened[since:]:
            scratch.drop("")
        del Scratch.opened[since:]


def connected_classes(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """Class of every node of an undirected edge list (``a``, ``b``): returns (``node``, ``root``), root the least node.

    Alternating large-star and small-star rounds. Each round is an aggregation and a join on the edge list and is
    written to the shared folder; nothing but two counters reaches the driver. Self links are allowed, nulls are not.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = scratch.put(e, f"{name}-0")
    last = None
    for k in range(1, max_rounds + 1):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-low-{k}")  # a table, so the join below can split a hub
        # Large star: every larger neighbour moves to the least of the closed neighbourhood.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: every node and its smaller neighbours move to the least of them.
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = scratch.put(small.where("a <> b").distinct(), f"{name}-{k}")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{k - 1}")
        scratch.drop(f"{name}-low-{k}")
        e = new
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"classes did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
