"""Read models, fallbacks, formats, tokens, routing and callout tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import double_text
from ..plans.registry import query
from ..sources.adapters import boxes, conversions, read, regions, with_cte
from .items import elements, items_sql
from .layout import BREAK_SQL, CLASS_SQL, THIN_SQL, on_page, region_class

# Formats of an export with their file endings.
ENDINGS = {"pdf": ".pdf", "pdf_ua": "_ua.pdf", "docx": ".docx", "html": ".html", "txt": ".txt", "json": ".json", "mp3": ".mp3"}


def _s(x):
    return x.cast("string")


def _merged(left, right):
    """Both maps' entries; the right map's value of a key that both have, under any policy for repeated keys."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)


@query(
    items_sql(""", t AS (SELECT doc_id, count(DISTINCT coalesce(page, 1)) AS pages, string_agg(text, ' ') AS said, bool_or(type = 'heading') AS sections FROM els WHERE type <> 'title' GROUP BY doc_id)
    SELECT doc_id, 1::BIGINT AS level, 'Documento sem texto' AS title, 'paragraph' AS block, true AS generated, 'no-text' AS warning, pages::BIGINT AS pages FROM t WHERE coalesce(trim(said), '') = '' AND NOT sections""").replace("FROM said) , t", "FROM said), t")
)
def generated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pages, without sections and with no text left after cleaning get one generated section."""
    g = elements(spark, sf_dir).where("type <> 'title'").groupBy("doc_id").agg(F.count_distinct(F.coalesce("page", F.lit(1))).alias("pages"), F.bool_or(F.coalesce(F.trim("text") != "", F.lit(False))).alias("said"), F.bool_or(F.col("type") == "heading").alias("sections"))
    return g.where("NOT said AND NOT sections").select("doc_id", F.lit(1).cast("long").alias("level"), F.lit("Documento sem texto").alias("title"), F.lit("paragraph").alias("block"), F.lit(True).alias("generated"), F.lit("no-text").alias("warning"), "pages")


@query(
    with_cte("cv", """SELECT c.id, c.status, 'seconds=' || c.seconds || ';user=' || c.user_id || CASE WHEN e.event_type = 'error' THEN ';error=' || e.event_type ELSE '' END AS extra, CASE WHEN c.status = 'done' THEN 200 WHEN c.status = 'error' THEN 404 ELSE 202 END::BIGINT AS code, CASE WHEN c.status = 'done' THEN 'task-' || c.id || '.zip' END AS download
    FROM cv c JOIN events e ON e.event_id = c.id""")
)
def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named fields and a map of the rest, where the right map's values win; the answer's code and download."""
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("said"))
    c = conversions(spark, sf_dir).withColumn("seconds", double_text(F.col("seconds"))).join(events, "id")
    rest = _merged(F.create_map(F.lit("seconds"), F.lit("?"), F.lit("user"), _s(F.col("user_id"))), F.create_map(F.lit("seconds"), F.col("seconds")))
    rest = F.when(F.col("said") == "error", _merged(rest, F.create_map(F.lit("error"), F.col("said")))).otherwise(rest)
    listed = lambda m: F.concat(F.lit("seconds="), m["seconds"], F.lit(";user="), m["user"], F.coalesce(F.concat(F.lit(";error="), m["error"]), F.lit("")))
    extra = F.transform(F.array(rest), listed)[0]  # the map is made once
    failed = F.col("status") == "error"
    code = F.when(F.col("status") == "done", 200).when(failed, 404).otherwise(202)
    return c.select("id", "status", extra.alias("extra"), code.cast("long").alias("code"), F.when(F.col("status") == "done", F.concat("task_id", F.lit(".zip"))).alias("download"))


_END_SQL = "en(format, ending, k) AS (VALUES " + ", ".join(str((f, e, i)) for i, (f, e) in enumerate(ENDINGS.items(), 1)) + ")"


@query(
    f"""WITH {_END_SQL}, files AS (SELECT 'doc-' || o_orderkey || ending AS name FROM orders, en WHERE (o_orderkey * k) % 3 = 0)
    SELECT o_orderkey AS id, count(f.name)::BIGINT AS available, coalesce(string_agg(CASE WHEN f.name IS NOT NULL THEN format END, ',' ORDER BY k), '') AS formats, coalesce(string_agg(f.name, '|' ORDER BY k), '') AS archive FROM orders CROSS JOIN en LEFT JOIN files f ON f.name = 'doc-' || o_orderkey || ending GROUP BY o_orderkey"""
)
def available_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the seven formats there is a file of, by its computed name, and what the archive holds."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.lit(e).alias("ending"), F.lit(i).alias("k")) for i, (f, e) in enumerate(ENDINGS.items(), 1)]))
    named = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), each.alias("f")).select("id", "f.*", F.concat(F.lit("doc-"), _s(F.col("id")), "f.ending").alias("name"))
    files = named.where("id * k % 3 = 0").select("name", F.lit(True).alias("there"))
    j = named.join(files, "name", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("k", "format", "name")))).alias("p"))
    return j.select("id", F.size("p").cast("long").alias("available"), F.array_join(F.transform("p", lambda x: x["format"]), ",").alias("formats"), F.array_join(F.transform("p", lambda x: x["name"]), "|").alias("archive"))


@query(
    with_cte("cv", """SELECT left(sha256(task_id), 16) AS token, CASE WHEN id % 3 = 0 THEN '["txt"]' ELSE '["html","txt"]' END AS formats, CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n, strftime(created_at + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS expires FROM cv WHERE status = 'done'""")
)
def issued_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of finished jobs with their formats as JSON, which reads back, and the time that they expire."""
    formats = F.to_json(F.when(F.col("id") % 3 == 0, F.array(F.lit("txt"))).otherwise(F.array(F.lit("html"), F.lit("txt"))))
    t = conversions(spark, sf_dir).where("status = 'done'").select(F.substring(F.sha2("task_id", 256), 1, 16).alias("token"), formats.alias("formats"), F.date_format(F.col("created_at") + F.expr("INTERVAL 7 DAY"), "yyyy-MM-dd HH:mm:ss").alias("expires"))
    return t.select("token", "formats", F.size(F.from_json("formats", "array<string>")).cast("long").alias("n"), "expires")


@query(
    """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 30 MINUTE, date_trunc('hour', ts) - INTERVAL 30 MINUTE]) AS s, ts FROM events) WHERE ts >= s AND ts < s + INTERVAL 1 HOUR GROUP BY ALL"""
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour every half hour; an event is in two."""
    e = read(spark, sf_dir, "events").select("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes").alias("w"))
    return e.groupBy("event_type", "w").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(
    """SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (ts < seen - INTERVAL 1 DAY)::BIGINT AS late FROM (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) GROUP BY user_id"""
)
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come, in the order of their ids, more than a day behind the latest that came before."""
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("seen", F.max("ts").over(before))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("seen") - F.expr("INTERVAL 1 DAY")).alias("late"))


@query(
    with_cte("rg", f""", c AS (SELECT id // 4 AS page, id, {CLASS_SQL} AS class FROM (SELECT *, {THIN_SQL} AS thin FROM rg)),
    a AS (SELECT *, CASE WHEN class IN ('table', 'formula') THEN 'data' WHEN class IN ('embedded_image', 'text_scanned', 'unknown') THEN 'vision' WHEN class <> 'ignore' THEN 'editor' END AS agent FROM c)
    SELECT page, id AS region, agent FROM a WHERE agent IS NOT NULL UNION ALL SELECT page, NULL, 'vision' FROM a GROUP BY page HAVING count(agent) = 0""").replace("FROM part) , c", "FROM part), c")
)
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent of every region; a page of which nothing is left goes to vision as a whole."""
    c = F.col("class")
    agent = F.when(c.isin("table", "formula"), "data").when(c.isin("embedded_image", "text_scanned", "unknown"), "vision").when(c != "ignore", "editor")
    r = regions(spark, sf_dir).withColumn("class", region_class()).select(F.floor(F.col("id") / 4).alias("page"), F.col("id").alias("region"), agent.alias("agent"))
    bare = r.groupBy("page").agg(F.count("agent").alias("n")).where("n = 0").select("page", F.lit(None).cast("long").alias("region"), F.lit("vision").alias("agent"))
    return r.where("agent IS NOT NULL").unionByName(bare)


_CLUSTERS = f"""SELECT *, sum({BREAK_SQL}) OVER (PARTITION BY doc_id, page ORDER BY y0, pos)::BIGINT AS cluster FROM (
 SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM bx WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, pos))"""


@query(
    with_cte("bx", f""", c AS (SELECT *, CASE WHEN pk % 4 = 0 THEN 'heading' ELSE 'paragraph' END AS type FROM ({_CLUSTERS})), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, cluster) AS members, row_number() OVER (PARTITION BY doc_id, page, cluster ORDER BY y0, pos) AS k, first_value('t' || pk) OVER (PARTITION BY doc_id, page, cluster ORDER BY y0, pos) AS title FROM c)
    SELECT doc_id, pos, CASE WHEN members >= 2 AND type = 'heading' THEN 'paragraph' ELSE type END AS type, CASE WHEN members >= 2 AND type = 'heading' THEN 'heading' END AS original_type, CASE WHEN members >= 2 THEN CASE WHEN k = 1 THEN 'title' ELSE 'content' END END AS role, CASE WHEN members >= 2 THEN 'callout-p' || page || '-g' || cluster END AS callout, CASE WHEN members >= 2 THEN title END AS title FROM n""").replace("FROM li) , c", "FROM li), c")
)
def callout_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a callout get its id, their role and the first one's text as title; headings become paragraphs that
    remember what they were."""
    rows = boxes(spark, sf_dir).withColumn("px0", F.lag("x0").over(on_page())).withColumn("px1", F.lag("x1").over(on_page())).withColumn("py1", F.lag("y1").over(on_page()))
    rows = rows.withColumn("new", F.expr(BREAK_SQL)).withColumn("cluster", F.sum("new").over(on_page())).withColumn("type", F.when(F.col("pk") % 4 == 0, "heading").otherwise("paragraph"))
    group = Window.partitionBy("doc_id", "page", "cluster")
    order = group.orderBy("y0", "pos")
    rows = rows.withColumns({"inside": F.count("*").over(group) >= 2, "k": F.row_number().over(order), "first": F.first(F.concat(F.lit("t"), _s(F.col("pk")))).over(order)})
    only = lambda x: F.when(F.col("inside"), x)
    demoted = F.col("inside") & (F.col("type") == "heading")
    return rows.select("doc_id", "pos", F.when(demoted, "paragraph").otherwise(F.col("type")).alias("type"), F.when(demoted, "heading").alias("original_type"), only(F.when(F.col("k") == 1, "title").otherwise("content")).alias("role"), only(F.concat(F.lit("callout-p"), _s(F.col("page")), F.lit("-g"), _s(F.col("cluster")))).alias("callout"), only(F.col("first")).alias("title"))


@query(with_cte("bx", "SELECT doc_id, page, string_agg(pos::VARCHAR, ',' ORDER BY y0, x0, pos) AS by_place, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS by_order FROM bx GROUP BY doc_id, page"))
def region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: regions of a page by top and left, and by reading order."""
    g = boxes(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "pos"))).alias("p"), F.array_sort(F.collect_list("pos")).alias("o"))
    return g.select("doc_id", "page", F.array_join(F.transform("p", lambda x: _s(x["pos"])), ",").alias("by_place"), F.array_join(F.transform("o", _s), ",").alias("by_order"))
