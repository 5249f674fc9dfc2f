"""Tables: widths, checks, linearisation, visual rows, back-fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import table_cells, with_cte


@query(with_cte("tc", "SELECT doc_id, row, sum(CASE WHEN colspan >= 1 THEN colspan ELSE 1 END)::BIGINT AS width, count(*)::BIGINT AS cells, count(*) FILTER (trim(text) = '')::BIGINT AS blanks FROM tc GROUP BY doc_id, row"))
def table_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    span = F.when(F.col("colspan") >= 1, F.col("colspan")).otherwise(1)
    return table_cells(spark, sf_dir).groupBy("doc_id", "row").agg(F.sum(span).alias("width"), F.count("*").alias("cells"), F.count_if(F.trim("text") == "").alias("blanks"))


@query(
    with_cte("tc", """SELECT doc_id, count(*)::BIGINT AS rows, count(*) FILTER (width <> first_width)::BIGINT AS uneven, sum(blanks)::BIGINT AS blanks FROM (
    SELECT *, first_value(width) OVER (PARTITION BY doc_id ORDER BY row) AS first_width FROM (SELECT doc_id, row, sum(colspan) AS width, count(*) FILTER (trim(text) = '') AS blanks FROM tc GROUP BY doc_id, row)) GROUP BY doc_id""")
)
def table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: rows whose width differs from the first row's, and blank cells."""
    rows = table_widths(spark, sf_dir)
    first = F.first("width").over(Window.partitionBy("doc_id").orderBy("row"))
    return rows.withColumn("w0", first).groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("width") != F.col("w0")).alias("uneven"), F.sum("blanks").alias("blanks"))


ROW_SQL = r"regexp_matches(line, '^\|.*\|$') AND NOT regexp_matches(line, '^[|:\s-]+$')"
