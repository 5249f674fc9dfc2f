"""Profiles, rendering, inlines, audio chunks, payloads."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.adapters import lines, md_lines, read, with_cte
from .sections import KIND_SQL, kinds

VERB_SQL = "CASE pk % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'detailed' ELSE 'basic' END"

# Verbosities that an output profile shows, and the verbosity of a mode.
PROFILES = {"html": ("basic", "detailed", "technical"), "pdf": ("basic", "detailed"), "pdf_ua": ("basic", "detailed"), "docx": ("basic", "detailed"), "txt": ("basic",)}
MODES = {"normal": "detailed", "medio": "detailed", "detalhado": "technical", "baixo": "basic", "ocr": "detailed"}

_PROFILE_SQL = "prof(profile, verbosity) AS (VALUES " + ", ".join(str((p, v)) for p, vs in PROFILES.items() for v in vs) + ")"


def verbosity():
    return F.when(F.col("pk") % 4 == 0, "technical").when(F.col("pk") % 4 == 1, "detailed").otherwise("basic")


@query(with_cte("md", f", {_PROFILE_SQL} SELECT doc_id, profile, count(*)::BIGINT AS blocks, sum(length(line))::BIGINT AS chars FROM (SELECT *, {VERB_SQL} AS verbosity FROM md) JOIN prof USING (verbosity) GROUP BY doc_id, profile").replace(") , prof", "), prof"))
def profile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that each profile shows; counts by verbosity first, so profiles multiply groups and not lines."""
    by = md_lines(spark, sf_dir).groupBy("doc_id", verbosity().alias("verbosity")).agg(F.count("*").alias("b"), F.sum(F.length("line")).alias("c"))
    shown = F.create_map(*[x for v in ("basic", "detailed", "technical") for x in (F.lit(v), F.array(*[F.lit(p) for p, vs in PROFILES.items() if v in vs]))])
    return by.withColumn("profile", F.explode(F.try_element_at(shown, F.col("verbosity")))).groupBy("doc_id", "profile").agg(F.sum("b").alias("blocks"), F.sum("c").alias("chars"))


@query(with_cte("md", f", {_PROFILE_SQL} SELECT profile, verbosity, count(*)::BIGINT AS violations FROM (SELECT *, {VERB_SQL} AS verbosity FROM md) CROSS JOIN (SELECT DISTINCT profile FROM prof) WHERE (profile, verbosity) NOT IN (SELECT (profile, verbosity) FROM prof) GROUP BY ALL").replace(") , prof", "), prof"))
def profile_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: blocks that a profile must not show."""
    by = md_lines(spark, sf_dir).groupBy(verbosity().alias("verbosity")).agg(F.count("*").alias("violations"))
    hidden = F.create_map(*[x for v in ("detailed", "technical") for x in (F.lit(v), F.array(*[F.lit(p) for p, vs in PROFILES.items() if v not in vs]))])
    return by.withColumn("profile", F.explode(F.try_element_at(hidden, F.col("verbosity")))).select("profile", "verbosity", "violations")


_PLAIN_SQL = r"CASE kind WHEN 'heading' THEN regexp_replace(line, '^#+\s+', '') WHEN 'list' THEN '- ' || substr(line, 3) WHEN 'ordered' THEN '1. ' || regexp_replace(line, '^\(?\d+\)\s+', '') ELSE replace(line, '**', '') END"


def plain(kind, line):
    return F.when(kind == "heading", F.regexp_replace(line, r"^#+\s+", "")).when(kind == "list", F.concat(F.lit("- "), F.substr(line, F.lit(3)))).when(kind == "ordered", F.concat(F.lit("1. "), F.regexp_replace(line, r"^\(?\d+\)\s+", ""))).otherwise(F.replace(line, F.lit("**"), F.lit("")))


@query(with_cte("md", f"SELECT doc_id, string_agg({_PLAIN_SQL}, chr(10) ORDER BY pos) AS body FROM (SELECT *, {KIND_SQL} AS kind FROM md) GROUP BY doc_id"))
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of plain text in order; a document is the group, so no group outgrows a document."""
    rows = kinds(spark, sf_dir).select("doc_id", F.struct("pos", plain(F.col("kind"), F.col("line")).alias("t")).alias("p"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("body"))


_ESC = "replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(with_cte("md", f"SELECT doc_id, string_agg('<' || tag || '>' || {_ESC} || '</' || tag || '>', '' ORDER BY pos) AS html FROM (SELECT *, CASE kind WHEN 'heading' THEN 'h2' WHEN 'list' THEN 'li' WHEN 'ordered' THEN 'li' WHEN 'row' THEN 'tr' ELSE 'p' END AS tag FROM (SELECT *, {KIND_SQL} AS kind FROM md)) GROUP BY doc_id"))
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, T21."""
    tag = F.when(F.col("kind") == "heading", "h2").when(F.col("kind").isin("list", "ordered"), "li").when(F.col("kind") == "row", "tr").otherwise("p")
    rows = kinds(spark, sf_dir).withColumn("tag", tag).select("doc_id", F.struct("pos", F.concat(F.lit("<"), "tag", F.lit(">"), T.escape_html(F.col("line")), F.lit("</"), "tag", F.lit(">")).alias("t")).alias("p"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("html"))


@query(with_cte("md", f"SELECT doc_id, pos, node, len(w)::BIGINT AS words, greatest(len(w) * 2 - 1, 0)::BIGINT AS inlines FROM (SELECT doc_id, pos, CASE kind WHEN 'heading' THEN 'Header' WHEN 'list' THEN 'BulletList' WHEN 'ordered' THEN 'BulletList' WHEN 'row' THEN 'Table' ELSE 'Para' END AS node, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM (SELECT *, {KIND_SQL} AS kind FROM md))"))
def ast_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node a block; inlines are words and the spaces between."""
    node = F.when(F.col("kind") == "heading", "Header").when(F.col("kind").isin("list", "ordered"), "BulletList").when(F.col("kind") == "row", "Table").otherwise("Para")
    n = F.size(F.filter(F.split("line", " "), lambda x: x != "")).cast("long")
    return kinds(spark, sf_dir).select("doc_id", "pos", node.alias("node"), n.alias("words"), F.greatest(n * 2 - 1, F.lit(0)).cast("long").alias("inlines"))


@query(with_cte("md", f"SELECT doc_id, pos, CASE kind WHEN 'heading' THEN 'heading' WHEN 'list' THEN 'list' WHEN 'ordered' THEN 'list' WHEN 'row' THEN 'table' ELSE 'paragraph' END AS type, {_PLAIN_SQL} AS text FROM (SELECT *, {KIND_SQL} AS kind FROM md)"))
def block_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14, P21."""
    kind = F.when(F.col("kind").isin("list", "ordered"), "list").when(F.col("kind") == "row", "table").otherwise(F.col("kind"))
    return kinds(spark, sf_dir).select("doc_id", "pos", kind.alias("type"), plain(F.col("kind"), F.col("line")).alias("text"))


@query()
def audio_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of lines into chunks of fewer than 1500 characters; a fold inside each row."""

    def pack(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                sizes, now = [], 0
                for line in (text or "").split("\n"):
                    if now and now + 1 + len(line) >= 1500:
                        sizes.append(now)
                        now = len(line)
                    else:
                        now += len(line) + (1 if now else 0)
                out.append([*sizes, now] if now else sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "sizes"])

    d = read(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(pack, "doc_id long, sizes array<long>")
    return d.select("doc_id", F.size("sizes").cast("long").alias("chunks"), F.expr("aggregate(sizes, 0L, (a, x) -> a + x)").alias("chars"))


@query("SELECT d.doc_id, 'generated' AS title, 'no text' AS warning FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def non_textual_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without content rows get one generated section."""
    d, l = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_anti").select("doc_id", F.lit("generated").alias("title"), F.lit("no text").alias("warning"))


@query("SELECT o_orderkey AS id, o_orderpriority AS mode, CASE left(o_orderpriority, 1) WHEN '1' THEN 'technical' WHEN '2' THEN 'basic' ELSE 'detailed' END AS verbosity FROM orders")
def mode_verbosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up with a default, as a map literal."""
    m = F.create_map(F.lit("1"), F.lit(MODES["detalhado"]), F.lit("2"), F.lit(MODES["baixo"]))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("mode"), F.coalesce(F.try_element_at(m, F.substring("o_orderpriority", 1, 1)), F.lit(MODES["normal"])).alias("verbosity"))


@query(
    with_cte("li", """SELECT o_orderkey AS id, o_orderstatus AS engine, coalesce(n, 0)::BIGINT AS pages, coalesce(total, 0)::DOUBLE AS cost, CASE WHEN n IS NULL THEN 'no execution' WHEN open > 0 THEN 'open steps' END AS warning
    FROM orders LEFT JOIN (SELECT doc_id, count(*) AS n, round(sum(price), 2) AS total, count(*) FILTER (ls = 'O') AS open FROM li GROUP BY doc_id) p ON p.doc_id = o_orderkey""")
)
def payload_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, totals and warnings of each document."""
    g = lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"), F.count_if(F.col("ls") == "O").alias("open"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    j = o.join(g, o.o_orderkey == g.doc_id, "left")
    return j.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("engine"), F.coalesce("n", F.lit(0)).cast("long").alias("pages"), F.coalesce("total", F.lit(0.0)).alias("cost"), F.when(F.col("n").isNull(), "no execution").when(F.col("open") > 0, "open steps").alias("warning"))


@query(
    with_cte("ob", """SELECT rule, count(*)::BIGINT AS n FROM (SELECT CASE WHEN dep = pos THEN 'self' WHEN satisfied AND dep IS NOT NULL AND NOT before THEN 'unsatisfied-dependency' WHEN pk % 97 = 0 THEN 'unknown-target' WHEN pos > 7 THEN 'order-range' END AS rule
    FROM (SELECT *, lag(satisfied) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ob)) WHERE rule IS NOT NULL GROUP BY rule""")
)
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: the first broken rule of every obligation."""
    from ..sources.adapters import obligations

    before = F.lag("satisfied").over(Window.partitionBy("doc_id").orderBy("pos"))
    ob = obligations(spark, sf_dir).withColumn("before", before)
    rule = F.when(F.col("dep") == F.col("pos"), "self").when(F.col("satisfied") & F.col("dep").isNotNull() & ~F.col("before"), "unsatisfied-dependency").when(F.col("pk") % 97 == 0, "unknown-target").when(F.col("pos") > 7, "order-range")
    return ob.select(rule.alias("rule")).where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"))
