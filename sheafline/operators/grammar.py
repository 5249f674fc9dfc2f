"""Plain text as blocks, and blocks by their type face."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.adapters import lines, with_cte

#: Lines that the adapter deals out; N is the part's number.
TEMPLATES = (
    "# Part N", "### **Deep** N", "Título: Part N", "capítulo 3: Part N", "2.1 numbered N", "ALL CAPS N", "- item N", "* star **N**", "(2) step N", "3) step N", "4. point N", "```sql", "| a N | b |", "| --- | :-: |", "|| x **N** |",
    "", "   ", "Plain **text** of part N.", "Seção: Part N", "- ITEM N", "1.2.3.4 four N", "c1|c2 N|", "||", "| AB N | C |", "| d N | e | f |", "7 lives", "##no heading N", "ends here N!",
)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of plain or marked-up text an order line."""
    k = (F.pmod(F.col("pk") * 3 + F.col("pos") * F.col("ln"), F.lit(len(TEMPLATES))) + 1).cast("int")
    line = F.replace(F.element_at(F.array(*[F.lit(x) for x in TEMPLATES]), k), F.lit("N"), F.col("pk").cast("string"))
    return lines(spark, sf_dir).select("doc_id", "pos", "pk", line.alias("line"))


TX_SQL = ", tx AS (SELECT doc_id, pos, pk, replace((" + str(list(TEMPLATES)) + f")[(pk * 3 + pos * ln) % {len(TEMPLATES)} + 1], 'N', pk::VARCHAR) AS line FROM li)"
_UPPER = r"(regexp_matches(t, '\p{L}') AND length(t) <= 90 AND NOT regexp_matches(t, '[.;!?]$') AND NOT contains(t, ':') AND t = upper(t))"
_NAMED = r"'(?i)^(t[ií]tulo|se[cç][aã]o|cap[ií]tulo(?:\s+\d+)?)\s*:\s*(.+)$'"
_NUMBERED = r"(regexp_matches(t, '^\d+(\.\d+){0,2}\s+.+$') AND length(t) <= 120)"
_LEVEL = rf"CASE WHEN regexp_matches(t, '^#{{1,6}}\s+') THEN length(regexp_extract(t, '^#+')) WHEN regexp_matches(t, {_NAMED}) THEN CASE WHEN regexp_matches(t, '(?i)^t[ií]tulo') THEN 1 ELSE 2 END WHEN {_NUMBERED} THEN least(4, length(regexp_replace(regexp_extract(t, '^[\d.]+'), '\d', '', 'g')) + 2) ELSE CASE WHEN ord = 1 THEN 1 ELSE 2 END END"
_CLEAN = r"trim(regexp_replace(X, '\*\*(.+?)\*\*', '\1', 'g'))"


def _clean(x: str) -> str:
    return _CLEAN.replace("X", x)


def bars(line: Column) -> Column:
    return line.startswith("|") & line.endswith("|")


def cells(line: Column) -> Column:
    """Cells between pipes; all outer pipes go."""
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: T.clean_block(c))


def blocks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, ord, type, level, text) of the blocks of ordered lines (key, pos, line).

    A line alone decides its kind, but for tables: lines between pipes next to each other are one table from the first that
    is no heading; a table of separators only is paragraphs. Lines of a table after its first make no block.
    """
    t = T.strip(F.col("line"))
    rows = rows.select(key, "pos", t.alias("t"))
    t = F.col("t")
    marked, heading = t.rlike(r"^#{1,6}\s+"), T.plain_heading(t, F.lit(False)).isNotNull()
    by = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumns({"bar": bars(t), "head": marked | heading, "rule": ~t.rlike(r"[^|:\-\s]")})
    rows = rows.withColumn("island", F.sum(F.when(F.col("bar"), 0).otherwise(1)).over(by))
    here = Window.partitionBy(key, "island")
    rows = rows.withColumn("begun", F.col("bar") & F.coalesce(F.max(F.col("bar") & ~F.col("head")).over(here.orderBy("pos")), F.lit(False)))
    rows = rows.withColumn("table", F.col("begun") & F.max(F.col("begun") & ~F.col("rule")).over(here))
    rows = rows.withColumn("lead", F.when(F.col("table"), F.row_number().over(Window.partitionBy(key, "island", "table").orderBy("pos")) == 1).otherwise(t != ""))
    rows = rows.withColumn("ord", F.sum(F.col("lead").cast("long")).over(by))
    in_table = F.array_sort(F.collect_list(F.when(F.col("table") & ~F.col("rule"), F.struct("pos", F.array_join(cells(t), " | ").alias("row")))).over(here))
    rows = rows.withColumn("rows", F.when(F.col("table") & F.col("lead"), F.array_join(F.transform(in_table, lambda x: x["row"]), "\n")))
    plain = T.plain_heading(t, F.col("ord") == 1)
    ordered = r"^(?:\(?\d+\)|\d+\.)\s+"
    made = lambda kind, level, text: F.struct(F.lit(kind).alias("type"), level.cast("long").alias("level"), text.alias("text"))
    none = F.lit(None)
    block = (
        F.when(F.col("table"), made("table", none, F.col("rows")))
        .when(marked, made("heading", F.length(F.regexp_extract(t, "^#+", 0)), T.clean_block(F.regexp_replace(t, r"^#{1,6}\s+", ""))))
        .when(heading, made("heading", plain["level"], T.clean_block(plain["text"])))
        .when(t.rlike(r"^[-*+]\s+"), made("list", none, T.clean_block(F.substr(t, F.lit(3)))))
        .when(t.rlike(ordered), made("ordered", none, T.clean_block(F.regexp_replace(t, ordered, ""))))
        .when(t.startswith("```"), made("code", none, t))
        .otherwise(made("paragraph", none, T.clean_block(t)))
    )
    return rows.where("lead").select(key, "pos", "ord", block.alias("b")).select(key, "pos", "ord", "b.*")


@query(
    with_cte("li", TX_SQL + rf""", a AS (SELECT doc_id, pos, trim(line) AS t, line FROM tx), b AS (SELECT *, t LIKE '|%' AND t LIKE '%|' AS bar, regexp_matches(t, '^#{{1,6}}\s+') AS marked, regexp_matches(t, {_NAMED}) OR {_NUMBERED} OR {_UPPER} AS plain, NOT regexp_matches(t, '[^|:\-\s]') AS rule FROM a),
    c AS (SELECT *, sum(CASE WHEN bar THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b), d AS (SELECT *, bar AND bool_or(bar AND NOT marked AND NOT plain) OVER (PARTITION BY doc_id, island ORDER BY pos) AS begun FROM c),
    e AS (SELECT *, begun AND bool_or(begun AND NOT rule) OVER (PARTITION BY doc_id, island) AS tab FROM d), f AS (SELECT *, CASE WHEN tab THEN row_number() OVER (PARTITION BY doc_id, island, tab ORDER BY pos) = 1 ELSE t <> '' END AS lead FROM e),
    g AS (SELECT *, sum(lead::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS ord FROM f),
    r AS (SELECT doc_id, island, string_agg(array_to_string(list_transform(string_split(trim(t, '|'), '|'), lambda x: {_clean("x")}), ' | '), chr(10) ORDER BY pos) AS body FROM g WHERE tab AND NOT rule GROUP BY doc_id, island)
    SELECT doc_id, pos, ord, CASE WHEN tab THEN 'table' WHEN marked OR plain THEN 'heading' WHEN regexp_matches(t, '^[-*+]\s+') THEN 'list' WHEN regexp_matches(t, '^(\(?\d+\)|\d+\.)\s+') THEN 'ordered' WHEN t LIKE '```%' THEN 'code' ELSE 'paragraph' END AS type,
      CASE WHEN NOT tab AND (marked OR plain) THEN ({_LEVEL})::BIGINT END AS level,
      CASE WHEN tab THEN body WHEN marked THEN {_clean("regexp_replace(t, '^#{1,6}" + chr(92) + "s+', '')")} WHEN regexp_matches(t, {_NAMED}) THEN trim(regexp_extract(t, {_NAMED}, 2)) WHEN {_NUMBERED} THEN regexp_replace(t, '^\d+\.\s+', '') WHEN plain AND t LIKE '- %' THEN substr(t, 3) WHEN plain THEN t
        WHEN regexp_matches(t, '^[-*+]\s+') THEN {_clean("substr(t, 3)")} WHEN regexp_matches(t, '^(\(?\d+\)|\d+\.)\s+') THEN regexp_replace(t, '^(\(?\d+\)|\d+\.)\s+', '') WHEN t LIKE '```%' THEN t ELSE {_clean("t")} END AS text
    FROM g LEFT JOIN r USING (doc_id, island) WHERE lead""").replace("FROM lineitem) , tx", "FROM lineitem), tx").replace("FROM lineitem), , tx", "FROM lineitem), tx")
)
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of plain text; a capital line is a first-level heading only where no block stands before."""
    return blocks(text_lines(spark, sf_dir))


@query(
    with_cte("li", TX_SQL + rf""", a AS (SELECT doc_id, pos, trim(line) AS t, pk, 10 + pk % 5 AS size, pk % 7 < 2 AS bold, pk % 11 = 0 AS mono, 1 + pk % 4 AS n FROM tx), m AS (SELECT *, median(size) OVER (PARTITION BY doc_id) AS med FROM a),
    k AS (SELECT *, regexp_matches(t, {_NAMED}) OR {_NUMBERED} OR {_UPPER} AS plain, pos AS ord FROM m)
    SELECT doc_id, pos, CASE WHEN t = '' THEN 'paragraph' WHEN plain THEN 'heading' WHEN length(t) <= 120 AND n <= 3 AND size >= med + 1 AND bold THEN 'heading' WHEN mono AND n > 1 THEN 'code' WHEN regexp_matches(t, '^(([-*+]|•|‣|⁃|→|⇒)\s+|\(?\d+\)|\d+\.\s+)') THEN 'list_item' ELSE 'paragraph' END AS type,
      (CASE WHEN t = '' THEN 1 WHEN plain THEN {_LEVEL.replace("WHEN regexp_matches(t, '^#{1,6}" + chr(92) + "s+') THEN length(regexp_extract(t, '^#+')) ", "")} WHEN length(t) <= 120 AND n <= 3 AND size >= med + 1 AND bold THEN CASE WHEN pos > 1 THEN 2 ELSE 1 END ELSE 1 END)::BIGINT AS level,
      regexp_matches(t, '^([-*+•‣⁃o§→⇒] |\d[.)]([^\d]|$)|\p{{L}}[.)] )') AS region_marker FROM k""").replace("FROM lineitem) , tx", "FROM lineitem), tx").replace("FROM lineitem), , tx", "FROM lineitem), tx")
)
def typographic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a block first, then its size against the document's median, then monospace and list markers."""
    t = T.strip(F.col("line"))
    pk = F.col("pk")
    rows = text_lines(spark, sf_dir).withColumns({"t": t, "size": 10 + pk % 5, "bold": pk % 7 < 2, "mono": pk % 11 == 0, "n": 1 + pk % 4})
    rows = rows.withColumn("med", F.median("size").over(Window.partitionBy("doc_id")))
    t, first = F.col("t"), F.col("pos") == 1
    plain = T.plain_heading(t, first)
    loud = (F.length(t) <= 120) & (F.col("n") <= 3) & (F.col("size") >= F.col("med") + 1) & (F.col("bold") | T.upper_heading(t))
    kind = F.when(t == "", "paragraph").when(plain.isNotNull() | loud, "heading").when(F.col("mono") & (F.col("n") > 1), "code").when(T.list_marker(t), "list_item").otherwise("paragraph")
    level = F.when(t == "", 1).when(plain.isNotNull(), plain["level"]).when(loud & ~first, 2).otherwise(1)
    return rows.select("doc_id", "pos", kind.alias("type"), level.cast("long").alias("level"), T.region_list_marker(t).alias("region_marker"))
