"""Line grammar, headings, section trees, ids and re-flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.adapters import headings, md_lines, read, with_cte


#: Headings have levels 1 to 6.
LEVELS = 6


def in_order():
    """Lines of a document in order."""
    return Window.partitionBy("doc_id").orderBy("pos")


def before():
    """The lines before a line."""
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


KIND_SQL = r"""CASE WHEN regexp_matches(line, '^#{1,6}\s+') THEN 'heading' WHEN regexp_matches(line, '^\d+(\.\d+){0,2}\s+.+$') AND length(line) <= 120 THEN 'heading'
 WHEN regexp_matches(line, '\p{L}') AND length(line) <= 90 AND NOT regexp_matches(line, '[.;!?]$') AND NOT contains(line, ':') AND line = upper(line) THEN 'heading'
 WHEN regexp_matches(line, '^[-*+]\s+') THEN 'list' WHEN regexp_matches(line, '^\(?\d+\)\s+') THEN 'ordered' WHEN regexp_matches(line, '^\d+\.\s+') THEN 'ordered' WHEN regexp_matches(line, '^\|.*\|$') THEN 'row' ELSE 'paragraph' END"""


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md_lines(spark, sf_dir).withColumn("kind", T.line_kind(F.col("line")))


@query(
    with_cte(
        "md",
        rf"""SELECT doc_id, pos, kind, run, CASE WHEN kind = 'heading' THEN CASE WHEN line LIKE '#%' THEN length(regexp_extract(line, '^#+'))
          WHEN regexp_matches(line, '^\d') THEN least(4, length(regexp_extract(line, '^[\d.]+')) - length(replace(regexp_extract(line, '^[\d.]+'), '.', '')) + 2)
          ELSE CASE WHEN before = 0 THEN 1 ELSE 2 END END END::BIGINT AS level FROM (
          SELECT *, sum(CASE WHEN kind = 'row' AND prev = 'row' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS run,
            coalesce(sum(CASE WHEN kind = 'row' AND prev = 'row' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM (SELECT *, {KIND_SQL} AS kind FROM md)))""",
    )
)
def line_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each line, table runs as one block, heading level by the blocks before it."""
    rows = kinds(spark, sf_dir).withColumn("prev", F.lag("kind").over(in_order()))
    new = F.when((F.col("kind") == "row") & (F.col("prev") == "row"), 0).otherwise(1)
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(in_order())).withColumn("before", F.coalesce(F.sum("new").over(before()), F.lit(0)))
    number = F.regexp_extract("line", r"^[\d.]+", 0)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    level = F.when(F.col("line").startswith("#"), F.length(F.regexp_extract("line", "^#+", 0))).when(F.col("line").rlike(r"^\d"), F.least(F.lit(4), dots + 2)).otherwise(F.when(F.col("before") == 0, 1).otherwise(2))
    return rows.select("doc_id", "pos", "kind", "run", F.when(F.col("kind") == "heading", level).cast("long").alias("level"))


@query(
    with_cte(
        "hd",
        """SELECT doc_id, pos, level, greatest(CASE WHEN level > 1 THEN l1 END, CASE WHEN level > 2 THEN l2 END, CASE WHEN level > 3 THEN l3 END, CASE WHEN level > 4 THEN l4 END, CASE WHEN level > 5 THEN l5 END) AS parent FROM (
        SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS l1, max(CASE WHEN level = 2 THEN pos END) OVER w AS l2, max(CASE WHEN level = 3 THEN pos END) OVER w AS l3, max(CASE WHEN level = 4 THEN pos END) OVER w AS l4, max(CASE WHEN level = 5 THEN pos END) OVER w AS l5
        FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    )
)
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of a heading is the nearest heading before it with a smaller level."""
    hd = headings(spark, sf_dir)
    last = {k: F.max(F.when(F.col("level") == k, F.col("pos"))).over(before()) for k in range(1, LEVELS)}
    return hd.select("doc_id", "pos", "level", F.greatest(*[F.when(F.col("level") > k, v) for k, v in last.items()]).alias("parent"))


@query(
    with_cte(
        "hd",
        """, tree AS (SELECT doc_id, pos, level, greatest(CASE WHEN level > 1 THEN l1 END, CASE WHEN level > 2 THEN l2 END, CASE WHEN level > 3 THEN l3 END, CASE WHEN level > 4 THEN l4 END, CASE WHEN level > 5 THEN l5 END) AS parent FROM (
        SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS l1, max(CASE WHEN level = 2 THEN pos END) OVER w AS l2, max(CASE WHEN level = 3 THEN pos END) OVER w AS l3, max(CASE WHEN level = 4 THEN pos END) OVER w AS l4, max(CASE WHEN level = 5 THEN pos END) OVER w AS l5
        FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
        paths AS (SELECT doc_id, pos, pos::VARCHAR AS path, 1 AS depth FROM tree WHERE parent IS NULL
          UNION ALL SELECT t.doc_id, t.pos, p.path || '/' || t.pos, p.depth + 1 FROM tree t JOIN paths p ON t.doc_id = p.doc_id AND t.parent = p.pos)
        SELECT doc_id, pos, path, depth::BIGINT AS depth FROM paths""",
        True,
    ).replace(", , tree", ", tree").replace("FROM li) , tree", "FROM li), tree")
)
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root, without recursion or joins.

    Of the last headings of each level before a heading, those later than all with a smaller level are its ancestors.
    """
    rows = headings(spark, sf_dir)
    for k in range(1, LEVELS):
        rows = rows.withColumn(f"l{k}", F.max(F.when(F.col("level") == k, F.col("pos"))).over(before()))
    above, latest = [], F.lit(0).cast("long")
    for k in range(1, LEVELS):
        here = F.col(f"l{k}")
        above.append(F.when((F.col("level") > k) & (here > latest), here.cast("string")))
        latest = F.greatest(latest, here)
    parts = F.array_compact(F.array(*above, F.col("pos").cast("string")))
    return rows.select("doc_id", "pos", F.array_join(parts, "/").alias("path"), F.size(parts).cast("long").alias("depth"))


@query(with_cte("hd", "SELECT doc_id, pos, level, prev FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM hd) WHERE level > prev + 1"))
def heading_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading more than one level below the heading before it."""
    return headings(spark, sf_dir).withColumn("prev", F.lag("level").over(in_order())).where("level > prev + 1").select("doc_id", "pos", "level", "prev")


@query(
    with_cte("hd", "SELECT doc_id, bool_or(level > prev + 1) AS skips, count(*) FILTER (level = 1) > 1 AS many_h1, arg_min(level, pos) <> 1 AS wrong_first FROM (SELECT *, lag(level, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM hd) GROUP BY doc_id")
)
def heading_skip_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level before the first heading is 0, so a first heading of level 2 skips."""
    rows = headings(spark, sf_dir).withColumn("prev", F.lag("level", 1, 0).over(in_order()))
    return rows.groupBy("doc_id").agg(F.bool_or(F.col("level") > F.col("prev") + 1).alias("skips"), (F.count_if(F.col("level") == 1) > 1).alias("many_h1"), (F.min_by("level", "pos") != 1).alias("wrong_first"))


@query(
    with_cte(
        "hd",
        """SELECT doc_id, CASE WHEN second IS NOT NULL AND pk1 % 2 = 0 THEN 'CH ' || pk1 || ' - ' || second ELSE 'CH ' || pk1 END AS title FROM (
        SELECT doc_id, arg_min(pk, pos) AS pk1, arg_min(pk, pos) FILTER (level <= 2 AND pos > 1) AS second FROM hd GROUP BY doc_id)""",
    )
)
def canonical_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter heading takes the first later heading of level 1 or 2 as its second part."""
    g = headings(spark, sf_dir).groupBy("doc_id").agg(F.min_by("pk", "pos").alias("pk1"), F.min_by("pk", F.when((F.col("level") <= 2) & (F.col("pos") > 1), F.col("pos"))).alias("s"), F.bool_or((F.col("level") <= 2) & (F.col("pos") > 1)).alias("has"))
    chapter = F.concat(F.lit("CH "), F.col("pk1").cast("string"))
    return g.select("doc_id", F.when(F.col("has") & (F.col("pk1") % 2 == 0), F.concat(chapter, F.lit(" - "), F.col("s").cast("string"))).otherwise(chapter).alias("title"))


@query(with_cte("hd", "SELECT doc_id, pos, CASE WHEN pos = 1 THEN 0 ELSE least(pos - 1, min(level - pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + pos) END::BIGINT AS outline FROM (SELECT doc_id, pos, CASE WHEN pos = 1 THEN 0 ELSE level END AS level FROM hd)"))
def outline_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """out(i) = min(level(i), out(i-1) + 1) as a running minimum of level - position; the first entry is 0."""
    level = F.when(F.col("pos") == 1, 0).otherwise(F.col("level"))
    out = F.min(level - F.col("pos")).over(in_order()) + F.col("pos")
    return headings(spark, sf_dir).select("doc_id", "pos", F.when(F.col("pos") == 1, 0).otherwise(F.least(F.col("pos") - 1, out)).cast("long").alias("outline"))


@query(
    with_cte("md", rf"""SELECT doc_id, pos, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS block_id, kind || '-' || slug || '-' || pos AS indexed_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) AS n FROM (SELECT *, kind || '-' || slug AS base FROM (
    SELECT doc_id, pos, {KIND_SQL} AS kind, substr(regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug FROM md)))""")
)
def block_id_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from the kind and a slug; the n-th repetition of one in a document gets -n, or every one its place."""
    rows = kinds(spark, sf_dir).withColumn("base", F.concat_ws("-", "kind", T.slug(F.col("line"))))
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("pos"))
    return rows.withColumn("n", n).select("doc_id", "pos", F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base")).alias("block_id"), F.concat_ws("-", "base", F.col("pos").cast("string")).alias("indexed_id"))


@query(
    r"""SELECT doc_id, count(*)::BIGINT AS lines, count(*) FILTER (elig)::BIGINT AS joins FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY pos) % 2 = 1 AND glue AS elig FROM (
        SELECT *, sum(CASE WHEN glue THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM (
          SELECT doc_id, pos, NOT regexp_matches(line, '[.!?:;"]$') AND coalesce(regexp_matches(lead(line) OVER (PARTITION BY doc_id ORDER BY pos), '^[a-z]'), false) AS glue FROM (
            SELECT doc_id, k::BIGINT AS pos, array_to_string(w[k * 8 + 1:k * 8 + 8], ' ') AS line FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 7) // 8)) AS k FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))))) GROUP BY doc_id"""
)
def paragraph_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined to the next one; a line is consumed once, so in a run of joinable lines every other one joins."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    rows = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") + 7) / 8).cast("int") - 1)).alias("k"))
    rows = rows.select("doc_id", F.col("k").cast("long").alias("pos"), F.array_join(F.slice("w", F.col("k") * 8 + 1, F.lit(8)), " ").alias("line"))
    glue = ~F.col("line").rlike('[.!?:;"]$') & F.coalesce(F.lead("line").over(in_order()).rlike("^[a-z]"), F.lit(False))
    rows = rows.withColumn("glue", glue).withColumn("grp", F.sum(F.when(F.col("glue"), 0).otherwise(1)).over(before()))
    place = F.row_number().over(Window.partitionBy("doc_id", "grp").orderBy("pos"))
    rows = rows.withColumn("elig", (place % 2 == 1) & F.col("glue"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("elig").alias("joins"))


@query(
    """SELECT source, count(*)::BIGINT AS docs, sum(len(string_split(text, chr(10))))::BIGINT AS blocks, sum(length(text))::BIGINT AS chars, max(len(string_split(text, chr(10))))::BIGINT AS most_blocks FROM documents GROUP BY source"""
)
def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    lines_ = F.size(F.split("text", "\n"))
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(lines_).alias("blocks"), F.sum(F.length("text")).alias("chars"), F.max(lines_).cast("long").alias("most_blocks"))


@query("""SELECT b.docs - a.docs AS docs_delta, b.chars - a.chars AS chars_delta FROM (SELECT count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM documents) a, (SELECT count(*)::BIGINT AS docs, sum(length(html))::BIGINT AS chars FROM pages) b""")
def engine_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of two engines' outputs, b - a, by conditional sums over one union."""
    a = read(spark, sf_dir, "documents").select(F.lit(-1).alias("sign"), F.length("text").alias("n"))
    b = read(spark, sf_dir, "pages").select(F.lit(1).alias("sign"), F.length("html").alias("n"))
    return a.unionByName(b).agg(F.sum("sign").alias("docs_delta"), F.sum(F.col("sign") * F.col("n")).alias("chars_delta"))


@query(
    with_cte("md", r"""SELECT doc_id, pos, regexp_matches(line, '(?m)^#{1,6}\s+') OR regexp_matches(line, '(?m)^\s*[-*+]\s+') OR regexp_matches(line, '(?m)^\s*\d+\.\s+') OR regexp_matches(line, '\*\*.+\*\*') AS markdown,
    regexp_matches(line, '(?i)chain of thought|system prompt') AS leak FROM md""")
)
def markdown_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, T4, T25."""
    return md_lines(spark, sf_dir).select("doc_id", "pos", T.has_markdown(F.col("line")).alias("markdown"), T.leaks(F.col("line")).alias("leak"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')) AS digest FROM documents")
def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, P3 over whole documents."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.sanitize(F.col("text"))).alias("digest"))


@query(
    with_cte("md", r"""SELECT doc_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\*\*(.+?)\*\*', '\1', 'g'), '^\s*#{1,6}\s+', ''), '^\s*[-*+]\s+', ''), '^\s*(?:\d+\.\s+|\d+\)\s+|\(\d+\)\s+)', '')) AS clean FROM md""")
)
def block_text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    return md_lines(spark, sf_dir).select("doc_id", "pos", T.clean_block(F.col("line")).alias("clean"))
