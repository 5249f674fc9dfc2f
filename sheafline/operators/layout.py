"""Layout: regions, bands, callout clusters, gaps, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import boxes, read, regions, with_cte


def on_page():
    """Boxes of a page from the top down."""
    return Window.partitionBy("doc_id", "page").orderBy("y0", "pos")


CLASS_SQL = """CASE kind WHEN 'image' THEN CASE WHEN has_bytes AND confidence >= 0.5 THEN 'embedded_image' WHEN w * h > 8000 THEN 'unknown' ELSE 'ignore' END
 WHEN 'table' THEN CASE WHEN chars > 0 THEN 'table' WHEN w * h > 8000 THEN 'table' ELSE 'ignore' END WHEN 'formula' THEN CASE WHEN w * h > 500 THEN 'formula' ELSE 'ignore' END
 WHEN 'text' THEN CASE WHEN subtype = 'code' AND chars >= 10 THEN 'code_block' WHEN subtype = 'list' AND chars >= 10 AND (n_lines >= 2 OR chars >= 50) THEN 'list_block'
   WHEN chars >= 20 AND chars / (w * h) >= 0.015 THEN 'text_clean' WHEN chars > 5 AND chars / (w * h) >= 0.005 THEN 'text_scanned' WHEN w * h > 8000 AND NOT thin THEN 'unknown' ELSE 'ignore' END
 WHEN 'unknown' THEN CASE WHEN w * h > 8000 AND NOT thin THEN 'unknown' ELSE 'ignore' END ELSE 'ignore' END"""
THIN_SQL = "w < 40 OR h < 40 OR w / h > 15 OR h / w > 15"


def region_class():
    """One expression over kind, size, density and confidence."""
    area, chars = F.col("w") * F.col("h"), F.col("chars")
    density = F.try_divide(chars, area)
    thin = (F.col("w") < 40) | (F.col("h") < 40) | (F.try_divide("w", "h") > 15) | (F.try_divide("h", "w") > 15)
    large = (area > 8000) & ~thin
    text = (
        F.when((F.col("subtype") == "code") & (chars >= 10), "code_block")
        .when((F.col("subtype") == "list") & (chars >= 10) & ((F.col("n_lines") >= 2) | (chars >= 50)), "list_block")
        .when((chars >= 20) & (density >= 0.015), "text_clean")
        .when((chars > 5) & (density >= 0.005), "text_scanned")
        .when(large, "unknown")
        .otherwise("ignore")
    )
    kind = F.col("kind")
    return (
        F.when(kind == "image", F.when(F.col("has_bytes") & (F.col("confidence") >= 0.5), "embedded_image").when(area > 8000, "unknown").otherwise("ignore"))
        .when(kind == "table", F.when((chars > 0) | (area > 8000), "table").otherwise("ignore"))
        .when(kind == "formula", F.when(area > 500, "formula").otherwise("ignore"))
        .when(kind == "text", text)
        .when(kind == "unknown", F.when(large, "unknown").otherwise("ignore"))
        .otherwise("ignore")
    )


@query(
    with_cte(
        "rg",
        f"""SELECT id, class, class IN ('text_scanned', 'embedded_image', 'unknown', 'table', 'formula') AS needs_vision, class IN ('code_block', 'callout_box', 'list_block', 'embedded_image') AS markers,
        CASE class WHEN 'embedded_image' THEN 'image' WHEN 'table' THEN 'table' WHEN 'formula' THEN 'formula' ELSE 'scanned' END AS prompt FROM (SELECT *, {CLASS_SQL} AS class FROM (SELECT *, {THIN_SQL} AS thin FROM rg))""",
    )
)
def region_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, P10, M1."""
    c = F.col("class")
    prompt = F.when(c == "embedded_image", "image").when(c.isin("table", "formula"), c).otherwise("scanned")
    return regions(spark, sf_dir).withColumn("class", region_class()).select("id", "class", c.isin("text_scanned", "embedded_image", "unknown", "table", "formula").alias("needs_vision"), c.isin("code_block", "callout_box", "list_block", "embedded_image").alias("markers"), prompt.alias("prompt"))


@query(
    with_cte(
        "rg",
        f"""SELECT class, CASE WHEN class IN ('table', 'formula') THEN 'data' WHEN class IN ('embedded_image', 'text_scanned', 'unknown') THEN 'vision' WHEN class = 'ignore' THEN 'none' ELSE 'editor' END AS agent, count(*)::BIGINT AS n
        FROM (SELECT {CLASS_SQL} AS class FROM (SELECT *, {THIN_SQL} AS thin FROM rg)) GROUP BY 1, 2""",
    )
)
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which agent takes a class."""
    c = F.col("class")
    agent = F.when(c.isin("table", "formula"), "data").when(c.isin("embedded_image", "text_scanned", "unknown"), "vision").when(c == "ignore", "none").otherwise("editor")
    return regions(spark, sf_dir).select(region_class().alias("class")).groupBy("class").agg(F.count("*").alias("n")).select("class", agent.alias("agent"), "n")


@query(with_cte("bx", "SELECT doc_id, page, max(widest)::DOUBLE AS widest, min(x0) AS band_left, max(x1) AS band_right FROM (SELECT *, max(x1 - x0) OVER (PARTITION BY doc_id, page) AS widest FROM bx) WHERE x1 - x0 >= 0.75 * widest GROUP BY doc_id, page"))
def text_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of the boxes of three quarters of the greatest width or more."""
    rows = boxes(spark, sf_dir).withColumn("widest", F.max(F.col("x1") - F.col("x0")).over(Window.partitionBy("doc_id", "page"))).where("x1 - x0 >= 0.75 * widest")
    return rows.groupBy("doc_id", "page").agg(F.max("widest").alias("widest"), F.min("x0").alias("band_left"), F.max("x1").alias("band_right"))


BREAK_SQL = "CASE WHEN px1 IS NULL OR y0 - py1 > 28 OR greatest(0, least(x1, px1) - greatest(x0, px0)) / greatest(1, least(x1 - x0, px1 - px0)) < 0.55 THEN 1 ELSE 0 END"


@query(
    with_cte(
        "bx",
        f"""SELECT doc_id, page, cluster, count(*)::BIGINT AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, 'callout-p' || page || '-g' || cluster AS callout FROM (
        SELECT *, sum({BREAK_SQL}) OVER (PARTITION BY doc_id, page ORDER BY y0, pos)::BIGINT AS cluster FROM (
        SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM bx WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, pos))) GROUP BY doc_id, page, cluster HAVING count(*) >= 2""",
    )
)
def callout_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of boxes that are near below each other and overlap across."""
    rows = boxes(spark, sf_dir).withColumn("px0", F.lag("x0").over(on_page())).withColumn("px1", F.lag("x1").over(on_page())).withColumn("py1", F.lag("y1").over(on_page()))
    rows = rows.withColumn("new", F.expr(BREAK_SQL)).withColumn("cluster", F.sum("new").over(on_page()))
    g = rows.groupBy("doc_id", "page", "cluster").agg(F.count("*").alias("members"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where("members >= 2")
    return g.withColumn("callout", F.concat(F.lit("callout-p"), F.col("page").cast("string"), F.lit("-g"), F.col("cluster").cast("string")))


@query(with_cte("bx", "SELECT doc_id, page, pos, row_number() OVER (PARTITION BY doc_id, page, pk % 3 ORDER BY pos) = 1 AS titled FROM bx"))
def callout_title_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of a callout keeps its title."""
    first = F.row_number().over(Window.partitionBy("doc_id", "page", F.col("pk") % 3).orderBy("pos")) == 1
    return boxes(spark, sf_dir).select("doc_id", "page", "pos", first.alias("titled"))


MERGED_SQL = """SELECT doc_id, page, grp, min(y0) AS y0, max(y1) AS y1, count(*)::BIGINT AS boxes FROM (
 SELECT *, sum(CASE WHEN y0 > reach + 5 OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, pos)::BIGINT AS grp FROM (
 SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bx)) GROUP BY doc_id, page, grp"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumn("reach", F.max("y1").over(on_page().rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("grp", F.sum(F.when(F.col("reach").isNull() | (F.col("y0") > F.col("reach") + 5), 1).otherwise(0)).over(on_page()))
    return rows.groupBy("doc_id", "page", "grp").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("boxes"))


@query(with_cte("bx", MERGED_SQL))
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical intervals merged with a tolerance of 5."""
    return merged(spark, sf_dir)


PAGE_HEIGHT = 800.0


@query(
    with_cte("bx", f""", mg AS ({MERGED_SQL}), st AS (SELECT doc_id, page, y1 AS stop FROM mg UNION SELECT DISTINCT doc_id, page, 0.0 FROM mg UNION SELECT DISTINCT doc_id, page, {PAGE_HEIGHT} FROM mg),
    bd AS (SELECT doc_id, page, stop AS top, lead(stop) OVER (PARTITION BY doc_id, page ORDER BY stop) AS bottom FROM st)
    SELECT doc_id, page, top, bottom, count(b.pos)::BIGINT AS covers FROM bd LEFT JOIN bx b USING (doc_id, page) WHERE bottom - top >= 20 AND (b.pos IS NULL OR (b.y0 < bottom AND b.y1 > top)) GROUP BY ALL
    UNION ALL SELECT doc_id, page, top, bottom, 0 FROM bd WHERE bottom - top >= 20 AND NOT EXISTS (SELECT 1 FROM bx b WHERE b.doc_id = bd.doc_id AND b.page = bd.page AND b.y0 < bottom AND b.y1 > top) AND EXISTS (SELECT 1 FROM bx b WHERE b.doc_id = bd.doc_id AND b.page = bd.page)""").replace("FROM li) , mg", "FROM li), mg")
)
def gap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of 20 or more between the page's top, the ends of merged intervals and the page's bottom, with the
    boxes that overlap each; an interval join inside a page."""
    m = merged(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(PAGE_HEIGHT)), F.collect_list("y1")))).alias("s"))
    bands = m.select("doc_id", "page", F.explode(F.arrays_zip(F.expr("slice(s, 1, size(s) - 1)").alias("top"), F.expr("slice(s, 2, size(s) - 1)").alias("bottom"))).alias("b")).select("doc_id", "page", "b.top", "b.bottom").where("bottom - top >= 20")
    b = boxes(spark, sf_dir).select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "y0", "y1")
    hit = bands.join(b, F.expr("doc_id = d AND page = p AND y0 < bottom AND y1 > top"), "left")
    return hit.groupBy("doc_id", "page", "top", "bottom").agg(F.count("d").alias("covers"))


@query(
    with_cte(
        "bx",
        """SELECT a.doc_id, a.pos FROM bx a WHERE a.pk % 2 = 1 AND EXISTS (SELECT 1 FROM bx b WHERE b.pk % 2 = 0 AND b.doc_id = a.doc_id AND b.page = a.page AND b.pos < a.pos
        AND greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1 + 40, b.y1 + 40) AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) + 40 - greatest(a.y0, b.y0)) / greatest((a.x1 - a.x0) * 60, 1) >= 0.3)""",
    )
)
def overlap_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of which three tenths lie in a clean box seen earlier; a semi join on (document, page) with a range."""
    a = boxes(spark, sf_dir).where("pk % 2 = 1").alias("a")
    b = boxes(spark, sf_dir).where("pk % 2 = 0").alias("b")
    x = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))"
    y = "(least(a.y1, b.y1) + 40 - greatest(a.y0, b.y0))"
    on = F.expr(f"a.doc_id = b.doc_id AND a.page = b.page AND b.pos < a.pos AND {x} > 0 AND {y} > 0 AND {x} * {y} / greatest((a.x1 - a.x0) * 60, 1) >= 0.3")
    return a.join(b, on, "left_semi").select("doc_id", "pos")


@query(with_cte("rg", "SELECT a.id, min(b.id) AS match FROM rg a JOIN (SELECT id, w * h AS px FROM rg WHERE kind = 'image') b ON abs(a.w * a.h - b.px) / b.px < 0.5 WHERE a.kind = 'text' GROUP BY a.id"))
def image_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first embedded image whose area is less than half of itself away.

    Equal areas are one row, so both sides are as large as the areas are many. An image of area p is met from p / 2 to
    3 p / 2; powers of two as bins are joined with their neighbours, which hold that range.
    """
    r = regions(spark, sf_dir).select("id", "kind", (F.col("w") * F.col("h")).alias("px")).withColumn("bin", F.floor(F.log2("px")).cast("int"))
    images = r.where("kind = 'image'").groupBy("px", "bin").agg(F.min("id").alias("first")).select(F.col("px").alias("p"), "first", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    texts = r.where("kind = 'text'")
    best = texts.select("px", "bin").distinct().join(images, "bin").where("abs(px - p) / p < 0.5").groupBy("px").agg(F.min("first").alias("match"))
    return texts.join(best, "px").select("id", "match")


@query(
    with_cte(
        "bx",
        "SELECT doc_id, page, count(*)::BIGINT AS blocks, avg(10 + pk % 5) AS mean_size, median(10 + pk % 5) AS median_size, bool_or(pk % 7 = 0) AS any_bold, count(*) FILTER (10 + pk % 5 >= med + 1 AND pk % 7 = 0)::BIGINT AS headings FROM (SELECT *, median(10 + pk % 5) OVER (PARTITION BY doc_id, page) AS med FROM bx) GROUP BY doc_id, page",
    )
)
def block_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font traits a page, and blocks set as headings by them."""
    rows = boxes(spark, sf_dir).withColumn("size", 10 + F.col("pk") % 5).withColumn("bold", F.col("pk") % 7 == 0)
    med = rows.groupBy("doc_id", "page").agg(F.median("size").alias("median_size"))
    return rows.join(med, ["doc_id", "page"]).groupBy("doc_id", "page").agg(F.count("*").alias("blocks"), F.avg("size").alias("mean_size"), F.max("median_size").alias("median_size"), F.bool_or("bold").alias("any_bold"), F.count_if((F.col("size") >= F.col("median_size") + 1) & F.col("bold")).alias("headings"))


@query("SELECT p_partkey AS id, p_name || CASE p_size % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.exe' ELSE '' END AS file, (p_size % 4 IN (0, 1)) AND p_size <= 45 AS admitted, CASE WHEN p_size % 4 NOT IN (0, 1) THEN 'type' WHEN p_size > 45 THEN 'size' ELSE 'ok' END AS reason FROM part")
def file_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension first, then size in MB."""
    p = read(spark, sf_dir, "part")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".docx", ".exe", "")]), (F.col("p_size") % 4 + 1).cast("int"))
    allowed = ("pdf", "png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif", "webp", "docx", "html")
    ext = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(*allowed)
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_name", suffix).alias("file"), "p_size").select("id", "file", (ext & (F.col("p_size") <= 45)).alias("admitted"), F.when(~ext, "type").when(F.col("p_size") > 45, "size").otherwise("ok").alias("reason"))
