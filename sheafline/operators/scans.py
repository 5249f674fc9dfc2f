"""Scans of plan texts, logs and typed settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import conversions, lines, methods, with_cte
from ..sources.files import delete_tasks, insert_or_ignore, log_number, plan_steps


@query(with_cte("me", "SELECT doc_id, 'execute-obligation' AS action, 'o' || pos AS first, method AS second, count(*)::BIGINT AS n FROM me WHERE available AND NOT tried GROUP BY ALL"))
def plan_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps read back from plan text with comments between."""
    m = methods(spark, sf_dir).where("available AND NOT tried")
    step = F.concat(F.lit(" (execute-obligation o"), F.col("pos").cast("string"), F.lit(" "), "method", F.lit(")"))
    text = m.select("doc_id", F.explode(F.array(step, F.concat(F.lit("; cost "), F.col("cost").cast("string")))).alias("line"))
    return text.select("doc_id", plan_steps(F.col("line")).alias("s")).where("s IS NOT NULL").groupBy("doc_id", "s.action", "s.first", "s.second").agg(F.count("*").alias("n"))


@query(with_cte("cv", "SELECT 'task-' || (id % 5000) AS task_id, min(id)::BIGINT AS id FROM cv WHERE id % 5000 >= 2000 GROUP BY 1"))
def history_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or ignore against the tasks that are known."""
    new = conversions(spark, sf_dir).select(F.concat(F.lit("task-"), (F.col("id") % 5000).cast("string")).alias("task_id"), "id")
    known = spark.range(2000).select(F.concat(F.lit("task-"), F.col("id").cast("string")).alias("task_id"))
    return insert_or_ignore(known, new, "task_id")


@query(with_cte("cv", "SELECT status, count(*)::BIGINT AS n FROM cv WHERE id % 10 <> 3 GROUP BY status"))
def ocr_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete by task as an anti join."""
    c = conversions(spark, sf_dir)
    return delete_tasks(c, c.where("id % 10 = 3").select("task_id")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), 'default') AS engine, event_id % 2 = 0 AS enabled FROM events")
def typed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first setting that is defined; several words are true."""
    from ..sources.adapters import read

    e = read(spark, sf_dir, "events")
    raw = F.create_map(F.lit("A"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")), F.lit("FLAG"), F.when(F.col("event_id") % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in ("1", "true", "yes", "on", "sim")]), (F.col("event_id") % 5 + 1).cast("int"))).otherwise("no"))
    e = e.select("event_id", raw.alias("m"))
    return e.select("event_id", F.coalesce(F.nullif(F.try_element_at("m", F.lit("A")), F.lit("")), F.lit("default")).alias("engine"), F.lower(F.try_element_at("m", F.lit("FLAG"))).isin("1", "true", "yes", "on", "sim").alias("enabled"))
