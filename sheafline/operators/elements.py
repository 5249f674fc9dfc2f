"""Elements of pages: types, order, parents, membership, counts, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import boxes, headings, html_elements, html_tags, lines, read, with_cte

# Element type of a raw label.
LABEL_TYPE = {"h1": "title", **{f"h{k}": "heading" for k in range(2, 7)}, "pre": "code", "table": "table", "figure": "picture", "form": "form", "p": "paragraph", "li": "list_item", "footer": "page_footer", "section_header": "heading"}
CONTAINERS = ("nav", "article", "body", "section", "list")

TYPE_SQL = "CASE label WHEN 'h1' THEN 'title' WHEN 'h2' THEN 'heading' WHEN 'h3' THEN 'heading' WHEN 'h4' THEN 'heading' WHEN 'h5' THEN 'heading' WHEN 'h6' THEN 'heading' WHEN 'pre' THEN 'code' WHEN 'table' THEN 'table' WHEN 'figure' THEN 'picture' WHEN 'form' THEN 'form' WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list_item' WHEN 'footer' THEN 'page_footer' ELSE CASE WHEN label IN ('nav', 'article', 'body', 'section', 'list') THEN 'group' ELSE 'unknown' END END"


def element_type(label):
    """The mapped type, else group for containers, else unknown."""
    mapped = F.create_map(*[F.lit(x) for kv in LABEL_TYPE.items() for x in kv])
    return F.coalesce(F.try_element_at(mapped, label), F.when(label.isin(*CONTAINERS), "group").otherwise("unknown"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_elements(spark, sf_dir).withColumn("type", element_type(F.col("label")))


@query(with_cte("el", f"SELECT page_id, ord AS reading_order, 'element-' || lpad(ord::VARCHAR, 6, '0') AS element_id, label AS raw_label, {TYPE_SQL} AS type FROM el"))
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).select("page_id", F.col("ord").alias("reading_order"), F.format_string("element-%06d", "ord").alias("element_id"), F.col("label").alias("raw_label"), "type")


@query(with_cte("el", f"SELECT type, count(*)::BIGINT AS n, count(DISTINCT page_id)::BIGINT AS pages FROM (SELECT page_id, {TYPE_SQL} AS type FROM el) GROUP BY type"))
def element_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_page = typed(spark, sf_dir).groupBy("type", "page_id").agg(F.count("*").alias("c"))  # one row a page and type: no distinct aggregate later
    return per_page.groupBy("type").agg(F.sum("c").alias("n"), F.count("*").alias("pages"))


@query(
    with_cte(
        "el",
        f"""SELECT p.page_id, p.url, coalesce(nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), ''), p.url) AS title, coalesce(n, 0)::BIGINT AS elements, coalesce(paragraphs, 0)::BIGINT AS paragraphs,
        coalesce(items, 0)::BIGINT AS items, coalesce(unknowns, 0)::BIGINT AS obligations, coalesce(late_title, false) AS late_title
        FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (type = 'paragraph') AS paragraphs, count(*) FILTER (type = 'list_item') AS items, count(*) FILTER (type = 'unknown') AS unknowns,
          min(ord) FILTER (type = 'title') > min(ord) FILTER (type = 'paragraph') AS late_title FROM (SELECT *, {TYPE_SQL} AS type FROM el) GROUP BY page_id) e USING (page_id)""",
    )
)
def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessibility profile of every page: counts by type, title, elements to review, a title after the text; one pass over
    each page's own tags, without a shuffle."""
    many = lambda t: F.size(F.filter("types", lambda x: x == t)).cast("long")
    place = lambda t: F.nullif(F.array_position("types", t), F.lit(0))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), F.lit("")), F.col("url"))
    pages = read(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"), F.transform(html_tags(), element_type).alias("types"))
    late = F.coalesce(place("title") > place("paragraph"), F.lit(False))
    return pages.select("page_id", "url", "title", F.size("types").cast("long").alias("elements"), many("paragraph").alias("paragraphs"), many("list_item").alias("items"), many("unknown").alias("obligations"), late.alias("late_title"))


PARENT_SQL = "CASE label WHEN 'li' THEN 'nav' WHEN 'p' THEN 'article' WHEN 'h1' THEN 'article' WHEN 'b' THEN 'p' END"


@query(with_cte("el", f"SELECT a.page_id, a.ord, a.label, b.ord AS parent FROM (SELECT *, {PARENT_SQL} AS ref FROM el) a LEFT JOIN (SELECT page_id, label, max(ord) AS ord FROM el GROUP BY ALL) b ON a.page_id = b.page_id AND a.ref = b.label"))
def element_parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent reference to element by source reference; of equal references the last one wins."""
    el = html_elements(spark, sf_dir)
    ref = F.when(F.col("label") == "li", "nav").when(F.col("label").isin("p", "h1"), "article").when(F.col("label") == "b", "p")
    last = el.groupBy("page_id", F.col("label").alias("ref")).agg(F.max("ord").alias("parent"))
    return el.withColumn("ref", ref).join(last, ["page_id", "ref"], "left").select("page_id", "ord", "label", "parent")


@query(
    with_cte(
        "li",
        """SELECT o_orderkey AS page, pos AS member, 'listed' AS how FROM orders JOIN li ON doc_id = o_orderkey
        UNION ALL SELECT o_orderkey, c_nationkey::BIGINT, 'fallback' FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey NOT IN (SELECT doc_id FROM li)""",
    )
)
def page_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed members, and a fallback for pages that list none."""
    li, orders = lines(spark, sf_dir), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    listed = orders.join(li, orders.o_orderkey == li.doc_id).select(F.col("o_orderkey").alias("page"), F.col("pos").alias("member"), F.lit("listed").alias("how"))
    keys = read(spark, sf_dir, "lineitem").select("l_orderkey")
    empty = orders.join(keys, orders.o_orderkey == keys.l_orderkey, "left_anti")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    spare = empty.join(customer, empty.o_custkey == customer.c_custkey).select(F.col("o_orderkey").alias("page"), F.col("c_nationkey").cast("long").alias("member"), F.lit("fallback").alias("how"))
    return listed.unionByName(spare)


@query(
    """SELECT 'order-customer' AS relation, count(*)::BIGINT AS dangling, min(k)::BIGINT AS least FROM (SELECT CASE WHEN o_custkey % 97 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'line-order', count(*), min(k) FROM (SELECT CASE WHEN l_orderkey % 97 = 0 THEN l_orderkey + 10000000 ELSE l_orderkey END AS k FROM lineitem) WHERE k NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'document-label', count(*), min(doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a target, by anti joins."""

    def check(name, refs, known):
        return refs.join(known.select(F.col(known.columns[0]).alias("k")), "k", "left_anti").agg(F.lit(name).alias("relation"), F.count("*").alias("dangling"), F.min("k").alias("least"))

    wrong = lambda c: F.when(F.col(c) % 97 == 0, F.col(c) + 10_000_000).otherwise(F.col(c)).alias("k")
    return (
        check("order-customer", read(spark, sf_dir, "orders").select(wrong("o_custkey")), read(spark, sf_dir, "customer").select("c_custkey"))
        .unionByName(check("line-order", read(spark, sf_dir, "lineitem").select(wrong("l_orderkey")), read(spark, sf_dir, "orders").select("o_orderkey")))
        .unionByName(check("document-label", read(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")), read(spark, sf_dir, "labels").select("doc_id")))
    )


WIDTH, HEIGHT, LEAST = 600.0, 800.0, 4.0


@query(
    with_cte(
        "bx",
        f""", c AS (SELECT doc_id, pos, pk, CASE WHEN pk % 5 = 1 THEN {HEIGHT} - y1 ELSE y0 END AS a, CASE WHEN pk % 5 = 1 THEN {HEIGHT} - y0 ELSE y1 END AS b, x0 + CASE WHEN pk % 4 = 0 THEN 590 ELSE 0 END AS l, x1 + CASE WHEN pk % 4 = 0 THEN 590 ELSE 0 END AS r, CASE pk % 4 WHEN 0 THEN 'wide' WHEN 1 THEN '-3' ELSE (pk % 90)::VARCHAR || '.5' END AS size FROM bx),
        d AS (SELECT doc_id, pos, size, greatest(0, least(a, b)) AS top, least({HEIGHT}, greatest(a, b)) AS bottom, greatest(0, l) AS left_, least({WIDTH}, r) AS right_ FROM c), e AS (SELECT *, right_ - left_ < {LEAST} OR bottom - top < {LEAST} AS small FROM d)
        SELECT doc_id, pos, CASE WHEN small THEN 0 ELSE left_ END::DOUBLE AS x0, CASE WHEN small THEN 0 ELSE top END::DOUBLE AS y0, CASE WHEN small THEN {WIDTH} ELSE right_ END::DOUBLE AS x1, CASE WHEN small THEN {HEIGHT} ELSE bottom END::DOUBLE AS y1, CASE WHEN try_cast(size AS DOUBLE) > 0 THEN try_cast(size AS DOUBLE) END AS width FROM e""",
    ).replace("FROM li) , c", "FROM li), c")
)
def clipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes measured from the bottom are turned over, all are cut to the page, and what is left too small is the
    whole page; sizes that aren't positive numbers are null."""
    pk = F.col("pk")
    up = pk % 5 == 1
    shift = F.when(pk % 4 == 0, 590).otherwise(0)
    size = F.when(pk % 4 == 0, "wide").when(pk % 4 == 1, "-3").otherwise(F.concat((pk % 90).cast("string"), F.lit(".5"))).try_cast("double")
    a, b = F.when(up, HEIGHT - F.col("y1")).otherwise(F.col("y0")), F.when(up, HEIGHT - F.col("y0")).otherwise(F.col("y1"))
    cut = boxes(spark, sf_dir).select("doc_id", "pos", F.greatest(F.lit(0.0), F.col("x0") + shift).alias("l"), F.least(F.lit(WIDTH), F.col("x1") + shift).alias("r"), F.greatest(F.lit(0.0), F.least(a, b)).alias("t"), F.least(F.lit(HEIGHT), F.greatest(a, b)).alias("b"), F.when(size > 0, size).alias("width"))
    small = (F.col("r") - F.col("l") < LEAST) | (F.col("b") - F.col("t") < LEAST)
    side = lambda c, whole, name: F.when(small, F.lit(whole)).otherwise(F.col(c)).alias(name)
    return cut.select("doc_id", "pos", side("l", 0.0, "x0"), side("t", 0.0, "y0"), side("r", WIDTH, "x1"), side("b", HEIGHT, "y1"), "width")


@query(with_cte("hd", "SELECT doc_id, string_agg(n, ',' ORDER BY level) AS counts, sum(c)::BIGINT AS elements, max(level) AS deepest FROM (SELECT doc_id, level, count(*) AS c, level || ':' || count(*) AS n FROM hd GROUP BY doc_id, level) GROUP BY doc_id"))
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: counts by type as one ordered text, with totals."""
    c = headings(spark, sf_dir).groupBy("doc_id", "level").agg(F.count("*").alias("c"))
    pairs = F.array_sort(F.collect_list(F.struct("level", "c")))
    return c.groupBy("doc_id").agg(pairs.alias("p"), F.sum("c").alias("elements"), F.max("level").alias("deepest")).select("doc_id", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["level"].cast("string"), x["c"].cast("string"))), ",").alias("counts"), "elements", "deepest")
