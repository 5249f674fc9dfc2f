"""Readers of documents, manifests, plans and planner logs, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Admitted file extensions, and the greatest size in bytes.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif", "webp", "docx", "html")
MAX_BYTES = 50 * 1024 * 1024

MANIFEST = """manifest_id string, created_at timestamp, revision int, status string, title string,
 elements array<struct<id:string,type:string,reading_order:int,hierarchy_level:int,text:string,parent_id:string,page_number:int,confidence:double>>,
 obligations array<struct<id:string,kind:string,status:string,selected:boolean,target_ids:array<string>,dependencies:array<string>,admissible_methods:array<string>,method_costs:map<string,int>>>"""


def admitted(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder by extension and size; contents are read only where they are used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return f.withColumn("admitted", ext.isin(*EXTENSIONS) & (F.col("length") <= MAX_BYTES))


def extract(files: DataFrame) -> DataFrame:
    """Content hash, size and the time of the only conversion of each admitted file."""
    return files.where("admitted").select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"), F.current_timestamp().alias("completed_at"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as JSON, one a file; a value of another type or a missing brace fails the read."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A table of a database, read in ranges of ``key`` if bounds (low, high, partitions) are given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        low, high, n = bounds
        r = r.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return r.load()


def plan_steps(line: Column) -> Column:
    """(action, first, second) of a plan line; comments and other lines are null."""
    pattern = r"^\s*\(([a-z][a-z-]*)((?:\s+[a-z0-9-]+)*)\s*\)"
    parts = F.split(F.trim(F.regexp_extract(line, pattern, 2)), r"\s+")
    action = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return F.when(action.isNotNull(), F.struct(action.alias("action"), F.nullif(F.get(parts, F.lit(0)), F.lit("")).alias("first"), F.get(parts, F.lit(1)).alias("second")))


def log_number(log: Column, label: str) -> Column:
    """The last number after ``label`` in a planner's log."""
    found = F.regexp_extract_all(log, F.lit(label + r"\D*?(\d+(?:\.\d+)?)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def domain_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Name, version and hash of each domain file read whole."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.regexp_extract("value", r"\(domain\s+([^\s)]+)", 1).alias("name"), F.regexp_extract("value", r"(?i)version:?\s*([\d.]+)", 1).alias("version"), F.sha2("value", 256).alias("sha256"), F.col("value").contains(":action").alias("has_actions"))


def write_json(df: DataFrame, folder: str, by: str | None = None) -> None:
    """One JSON object a row, partitioned by ``by``; a new run is appended."""
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).json(folder)


def insert_or_ignore(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key isn't known, the first of each key by all its columns."""
    fresh = new.join(known.select(key), key, "left_anti")
    rest = [c for c in new.columns if c != key]
    return fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")


def update_by_key(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` replace those of ``rows`` with the same key; changes have one row a key."""
    c = changes.select(key, *[F.col(x).alias(f"new_{x}") for x in changes.columns if x != key], F.lit(True).alias("found"))
    j = rows.join(c, key, "left")
    return j.select(*[F.when(F.col("found"), F.col(f"new_{x}")).otherwise(F.col(x)).alias(x) if f"new_{x}" in c.columns else F.col(x) for x in rows.columns])


def delete_tasks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows of other tasks."""
    return rows.join(tasks.select("task_id"), "task_id", "left_anti")
