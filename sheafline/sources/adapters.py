"""Lifting adapters: tables of document structure made from the stored tables by fixed expressions.

Every adapter has a Spark side (a DataFrame) and the same rows as a common table expression in ``CTE``. All keep the
document key ``doc_id`` and a dense order ``pos``, so later windows share one exchange on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tags that become elements, in the order in which alternatives are tried.
HTML_TAGS = "h1|h2|h3|h4|h5|h6|pre|p|li|nav|footer|article|table|figure|form|b"
#: What holds no elements, though it may hold what looks like tags.
HTML_MUTE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L0: order lines with a dense position in their document."""
    order = Window.partitionBy("doc_id").orderBy("ln", "pk", "sk", "price", "qty")
    li = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").cast("long").alias("ln"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_shipdate").alias("ship"),
    )
    return li.withColumn("pos", F.row_number().over(order).cast("long"))


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: a line of marked-up text per order line."""
    k = F.pmod(F.col("pk") * 7 + F.col("pos"), F.lit(9))
    pk = F.col("pk").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("# Part "), pk))
        .when(k == 1, F.concat(F.lit("## Supplier "), F.col("sk").cast("string")))
        .when(k == 2, F.concat(F.lit("ALL CAPS "), pk))
        .when(k == 3, F.concat(F.lit("2.1 numbered "), pk))
        .when(k == 4, F.concat(F.lit("- item "), pk))
        .when(k == 5, F.concat(F.lit("1) step "), pk))
        .when(k == 6, F.concat(F.lit("| a"), pk, F.lit(" | b |")))
        .when(k == 7, F.lit("| --- | --- |"))
        .otherwise(F.concat(F.lit("Plain **text** of part "), pk, F.lit(".")))
    )
    return lines(spark, sf_dir).select("doc_id", "pos", "pk", "sk", text.alias("line"))


def html_tags() -> Column:
    """Opening tags of a page in order, outside of scripts, styles and comments."""
    return F.regexp_extract_all(F.regexp_replace("html", HTML_MUTE, ""), F.lit(f"<({HTML_TAGS})[ >]"), F.lit(1))


def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: opening tags of pages in order."""
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(html_tags()).alias("p", "label")).select("page_id", (F.col("p") + 1).cast("long").alias("ord"), "label")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: heading levels 1 to 6."""
    return lines(spark, sf_dir).select("doc_id", "pos", "pk", (1 + F.pmod(F.col("pk") + F.col("ln"), F.lit(6))).cast("long").alias("level"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: layout boxes on three pages a document."""
    x0 = F.col("qty")
    top = (F.col("pos") * 30 + F.col("pk") % 17).cast("double")
    return lines(spark, sf_dir).select("doc_id", "pos", "pk", (F.col("sk") % 3 + 1).alias("page"), x0.alias("x0"), (x0 + F.col("disc") * 2000 + 5).alias("x1"), top.alias("y0"), (top + 20).alias("y1"))


def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations with a dependency on the one before."""
    dep = F.when((F.col("pk") % 2 == 0) & (F.col("pos") > 1), F.col("pos") - 1)
    return lines(spark, sf_dir).select("doc_id", "pos", "pk", "sk", "rf", dep.alias("dep"), (F.col("ls") == "F").alias("satisfied"), (F.col("rf") == "A").alias("selected"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three methods an obligation."""
    m = lines(spark, sf_dir).select("doc_id", "pos", "pk", "sk", "rf", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("k"))
    return m.select("doc_id", "pos", F.concat(F.lit("m"), F.col("k").cast("string")).alias("method"), F.pmod(F.col("sk") * F.col("k"), F.lit(100)).alias("cost"), ((F.col("rf") == "R") & (F.col("k") == 1)).alias("tried"), (F.col("k") != F.col("pk") % 5).alias("available"))


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job history."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "cancelled").otherwise("processing")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("task-"), F.col("event_id").cast("string")).alias("task_id"), "user_id", status.alias("status"), F.col("value").alias("seconds"), F.col("ts").cast("timestamp").alias("created_at"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table an order, a row a line, up to four cells a row."""
    rows = lines(spark, sf_dir).withColumn("col", F.explode(F.sequence(F.lit(1), (2 + F.col("pk") % 3).cast("int"))))
    return rows.select("doc_id", F.col("pos").alias("row"), F.col("col").cast("long").alias("col"), (1 + F.pmod(F.col("pos") + F.col("col"), F.lit(2))).cast("long").alias("colspan"), F.when(F.col("pk") % 11 == F.col("col"), F.lit("")).otherwise(F.concat(F.lit("c"), F.col("pk").cast("string"), F.lit("-"), F.col("col").cast("string"))).alias("text"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page regions from parts."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text", "image", "table", "formula", "unknown")]), (F.col("p_size") % 5 + 1).cast("int"))
    w = (F.col("p_partkey") % 40 * 10 + 5).cast("double")
    h = (F.col("p_size") * 7 + 3).cast("double")
    sub = F.when(F.col("p_partkey") % 7 == 0, "code").when(F.col("p_partkey") % 7 == 1, "list").otherwise("")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), w.alias("w"), h.alias("h"), F.length("p_name").cast("long").alias("chars"), sub.alias("subtype"), (F.col("p_partkey") % 3 + 1).alias("n_lines"), "p_name", (F.col("p_partkey") % 4 != 0).alias("has_bytes"), (F.col("p_retailprice") / 2500).alias("confidence"))


_LI = """li AS (SELECT l_orderkey AS doc_id, l_partkey AS pk, l_suppkey AS sk, l_linenumber::BIGINT AS ln, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_returnflag AS rf, l_linestatus AS ls, l_shipdate AS ship,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)::BIGINT AS pos FROM lineitem)"""

#: The adapters as common table expressions; most stand on ``li``.
CTE = {
    "li": _LI,
    "md": _LI + """, md AS (SELECT doc_id, pos, pk, sk, CASE (pk * 7 + pos) % 9 WHEN 0 THEN '# Part ' || pk WHEN 1 THEN '## Supplier ' || sk WHEN 2 THEN 'ALL CAPS ' || pk WHEN 3 THEN '2.1 numbered ' || pk
  WHEN 4 THEN '- item ' || pk WHEN 5 THEN '1) step ' || pk WHEN 6 THEN '| a' || pk || ' | b |' WHEN 7 THEN '| --- | --- |' ELSE 'Plain **text** of part ' || pk || '.' END AS line FROM li)""",
    "el": f"""el AS (SELECT page_id, unnest(range(1, len(f) + 1))::BIGINT AS ord, unnest(f) AS label FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '{HTML_MUTE}', '', 'g'), '<({HTML_TAGS})[ >]', 1) AS f FROM pages))""",
    "hd": _LI + ", hd AS (SELECT doc_id, pos, pk, (1 + (pk + ln) % 6)::BIGINT AS level FROM li)",
    "bx": _LI + ", bx AS (SELECT doc_id, pos, pk, sk % 3 + 1 AS page, qty AS x0, qty + disc * 2000 + 5 AS x1, (pos * 30 + pk % 17)::DOUBLE AS y0, (pos * 30 + pk % 17)::DOUBLE + 20 AS y1 FROM li)",
    "ob": _LI + ", ob AS (SELECT doc_id, pos, pk, sk, rf, CASE WHEN pk % 2 = 0 AND pos > 1 THEN pos - 1 END AS dep, ls = 'F' AS satisfied, rf = 'A' AS selected FROM li)",
    "me": _LI + ", me AS (SELECT doc_id, pos, 'm' || k AS method, (sk * k) % 100 AS cost, rf = 'R' AND k = 1 AS tried, k <> pk % 5 AS available FROM li, (VALUES (1), (2), (3)) v(k))",
    "cv": "cv AS (SELECT event_id AS id, 'task-' || event_id AS task_id, user_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'cancelled' ELSE 'processing' END AS status, value AS seconds, ts AS created_at FROM events)",
    "tc": _LI + ", tc AS (SELECT doc_id, pos AS row, col::BIGINT AS col, (1 + (pos + col) % 2)::BIGINT AS colspan, CASE WHEN pk % 11 = col THEN '' ELSE 'c' || pk || '-' || col END AS text FROM (SELECT *, unnest(range(1, 3 + pk % 3)) AS col FROM li))",
    "rg": "rg AS (SELECT p_partkey AS id, (['text', 'image', 'table', 'formula', 'unknown'])[p_size % 5 + 1] AS kind, (p_partkey % 40 * 10 + 5)::DOUBLE AS w, (p_size * 7 + 3)::DOUBLE AS h, length(p_name)::BIGINT AS chars, CASE p_partkey % 7 WHEN 0 THEN 'code' WHEN 1 THEN 'list' ELSE '' END AS subtype, p_partkey % 3 + 1 AS n_lines, p_name, p_partkey % 4 <> 0 AS has_bytes, p_retailprice / 2500 AS confidence FROM part)",
}


def with_cte(names: str, body: str, recursive: bool = False) -> str:
    """SQL that puts adapters, named by their keys, before a query."""
    parts, seen = [], False
    for n in names.split():
        c = CTE[n]
        if c.startswith(_LI):
            c, first = c[len(_LI) :].lstrip(", "), not seen
            if first:
                parts.append(_LI)
                seen = True
        if c:
            parts.append(c)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
