"""Exact de-duplication, content ids, caches and page consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import lines, md_lines, read, with_cte

#: K1: ASCII case and white space don't count.
PRINT_SQL = r"md5(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r]+', ' ', 'g')))"


def fingerprint(text: str = "text"):
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.md5(F.trim(F.regexp_replace(low, r"[ \t\n\r]+", " ")))


@query(f"SELECT min(doc_id)::BIGINT AS first_id, count(*)::BIGINT AS copies FROM documents GROUP BY {PRINT_SQL} HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of several documents; only ids and hashes are shuffled."""
    d = read(spark, sf_dir, "documents").select("doc_id", fingerprint().alias("f"))
    return d.groupBy("f").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("first_id", "copies")


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, {PRINT_SQL} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2: the first document of each fingerprint and source; a minimum combines before the shuffle, a window can't."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", fingerprint().alias("f"))
    return d.groupBy("source", "f").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("SELECT doc_id, left(sha256(text), 16) AS content_id, left(sha256('plan:' || doc_id || ':' || lang), 16) AS plan_id FROM documents")
def content_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K6."""
    return read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("content_id"), F.substring(F.sha2(F.concat_ws(":", F.lit("plan"), F.col("doc_id").cast("string"), "lang"), 256), 1, 16).alias("plan_id"))


@query(with_cte("li", "SELECT doc_id, pos, pk + CASE WHEN pk % 97 = 0 THEN 10000000 ELSE 0 END AS target FROM li WHERE pk % 97 = 0 OR pk NOT IN (SELECT p_partkey FROM part)"))
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without a target block."""
    links = lines(spark, sf_dir).select("doc_id", "pos", F.when(F.col("pk") % 97 == 0, F.col("pk") + 10_000_000).otherwise(F.col("pk")).alias("target"))
    return links.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("target")), "target", "left_anti").select("doc_id", "pos", "target")


@query(with_cte("md", "SELECT doc_id, kind, min(pos) AS first_pos FROM (SELECT doc_id, pos, regexp_replace(line, '[0-9]+', '#', 'g') AS kind FROM md) GROUP BY doc_id, kind"))
def distinct_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered distinct: the first place of each fact."""
    return md_lines(spark, sf_dir).groupBy("doc_id", F.regexp_replace("line", "[0-9]+", "#").alias("kind")).agg(F.min("pos").alias("first_pos"))


@query("SELECT conv_id, count(*)::BIGINT AS turns, min(turn)::BIGINT AS first, max(turn)::BIGINT AS last, max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices without gaps or repetitions, and the last actor."""
    g = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("c"), F.max("role").alias("role")).groupBy("conv_id")
    g = g.agg(F.sum("c").alias("turns"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("d"), F.max_by("role", "turn").alias("last_role"))
    return g.select("conv_id", "turns", "first", "last", ((F.col("last") - F.col("first") + 1 == F.col("turns")) & (F.col("d") == F.col("turns"))).alias("contiguous"), "last_role")


@query("SELECT turn, first_role, count(*)::BIGINT AS n FROM (SELECT turn, role AS first_role FROM conversations WHERE turn <= 2 UNION ALL SELECT turn, 'any' FROM conversations) GROUP BY ALL")
def concatenated_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenation of two projections before one aggregation."""
    c = read(spark, sf_dir, "conversations")
    return c.where("turn <= 2").select("turn", F.col("role").alias("first_role")).unionByName(c.select("turn", F.lit("any").alias("first_role"))).groupBy("turn", "first_role").agg(F.count("*").alias("n"))
