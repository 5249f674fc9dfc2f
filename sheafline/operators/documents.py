"""Canonical documents: rules, audit, export and renderings of blocks with tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.adapters import lines, with_cte

TYPES = ("heading", "paragraph", "code", "list", "table", "table", "image", "math", "note", "quote", "warning")
CELL = "struct<text:string,scope:string,rowspan:int,colspan:int>"
SHOWN = {"txt": ("basic",), "pdf": ("basic", "detailed"), "html": ("basic", "detailed", "technical")}


def _lit(x) -> Column:
    return F.lit(x)


def _s(x) -> Column:
    return x.cast("string")


def canonical_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every type with faults: ids twice, leaked phrases, lost indentation, uneven and blank cells, dead links.

    Every second table has an AST with captions, up to two header rows, spans and a footer, the others rows only.
    """
    pk, pos, n = F.col("pk"), F.col("pos"), _s(F.col("pk"))
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), ((pk + pos) % 11 + 1).cast("int"))
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    paragraph = F.when(pk % 13 == 0, cat("chain of thought ", n)).when(pk % 13 == 1, cat("**bold** ", n)).when(pk % 13 == 2, cat("- item ", n)).otherwise(cat('Plain & <text> "', n, '"'))
    code = F.when(pk % 3 == 0, cat("if x:\nreturn ", n)).when(pk % 3 == 1, cat("def f:\n    return ", n)).otherwise(cat("one line ", n))
    cell = lambda text, col, span=1: F.struct(text.alias("text"), F.when((pk % 3 == 1) & (col == 1), "row").otherwise("col").alias("scope"), F.lit(1).alias("rowspan"), F.lit(span).cast("int").alias("colspan")).cast(CELL)
    row = lambda name, i, span=1: F.array(cell(F.when((pk % 9 == 0) & (i == 1) & F.lit(name == "b"), " ").otherwise(cat(name, _s(i), "-1 ")), F.lit(1), span), cell(cat(name, _s(i), "-2 ", n), F.lit(2)))
    some = lambda name, count: F.transform(F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: row(name, i))
    wide = F.when(pk % 4 == 0, F.array(row("w", F.lit(1), 2))).otherwise(F.array().cast(f"array<array<{CELL}>>"))
    body = F.when(pk % 31 == 0, F.array().cast(f"array<array<{CELL}>>")).otherwise(F.concat(some("b", 1 + pk % 2), wide))
    plain_row = lambda i: F.transform(F.sequence(F.lit(1), F.when((pk % 5 == 0) & (i == 2), 3).otherwise(2)), lambda j: F.when((pk % 7 == 0) & (i == 1) & (j == 2), "").otherwise(cat("r", _s(i), "c", _s(j))))
    is_ast, is_rows = (pk + pos) % 11 == 5, (pk + pos) % 11 == 4
    return lines(spark, sf_dir).select(
        "doc_id", "pos", "pk", F.when(pk % 29 == 0, "blk-1").otherwise(cat("blk-", _s(pos))).alias("id"), kind.alias("type"), (1 + pk % 4).alias("level"),
        F.when(kind == "paragraph", paragraph).when(kind == "code", code).otherwise(cat("Text ", n)).alias("text"), F.when(pk % 2 == 0, cat("Title ", n)).alias("title"),
        F.when(pk % 4 == 0, "technical").when(pk % 4 == 1, "detailed").when(pk % 4 == 2, "basic").alias("verbosity"), F.when(pk % 3 > 0, cat("alt ", n)).alias("alt"), F.when(pk % 2 == 0, cat("long ", n)).alias("long"),
        F.array_compact(F.array(F.when(pk % 5 == 0, cat("blk-", _s(pos + 1))), F.when(pk % 7 == 0, "nowhere"))).alias("links"),
        F.when(is_rows, F.transform(F.sequence(F.lit(1), (1 + pk % 3).cast("int")), plain_row)).alias("rows"),
        F.when(is_ast, F.struct(F.when(pk % 2 == 0, cat("Cap ", n)).alias("caption"), some("h", pk % 3).alias("header"), body.alias("body"), some("f", F.when(pk % 5 == 0, 1).otherwise(0)).alias("footer"))).alias("ast"),
    )


def _row_sql(name: str, i: str, span: int = 1) -> str:
    first = f"CASE WHEN pk % 9 = 0 AND {i} = 1 THEN ' ' ELSE '{name}' || {i} || '-1 ' END" if name == "b" else f"'{name}' || {i} || '-1 '"
    return f"[{{'text': {first}, 'scope': CASE WHEN pk % 3 = 1 THEN 'row' ELSE 'col' END, 'rowspan': 1, 'colspan': {span}}}, {{'text': '{name}' || {i} || '-2 ' || pk, 'scope': 'col', 'rowspan': 1, 'colspan': 1}}]"


def _some_sql(name: str, count: str) -> str:
    return f"list_transform(range(1, {count} + 1), lambda i: {_row_sql(name, 'i')})"


CB_SQL = f""", cb AS (SELECT doc_id, pos, pk, CASE WHEN pk % 29 = 0 THEN 'blk-1' ELSE 'blk-' || pos END AS id, ({list(TYPES)})[(pk + pos) % 11 + 1] AS type, 1 + pk % 4 AS level,
 CASE (pk + pos) % 11 WHEN 1 THEN CASE pk % 13 WHEN 0 THEN 'chain of thought ' || pk WHEN 1 THEN '**bold** ' || pk WHEN 2 THEN '- item ' || pk ELSE 'Plain & <text> "' || pk || '"' END WHEN 2 THEN CASE pk % 3 WHEN 0 THEN 'if x:' || chr(10) || 'return ' || pk WHEN 1 THEN 'def f:' || chr(10) || '    return ' || pk ELSE 'one line ' || pk END ELSE 'Text ' || pk END AS text,
 CASE WHEN pk % 2 = 0 THEN 'Title ' || pk END AS title, CASE pk % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'detailed' WHEN 2 THEN 'basic' END AS verbosity, CASE WHEN pk % 3 > 0 THEN 'alt ' || pk END AS alt, CASE WHEN pk % 2 = 0 THEN 'long ' || pk END AS long,
 list_filter([CASE WHEN pk % 5 = 0 THEN 'blk-' || (pos + 1) END, CASE WHEN pk % 7 = 0 THEN 'nowhere' END], lambda x: x IS NOT NULL) AS links,
 CASE WHEN (pk + pos) % 11 = 4 THEN list_transform(range(1, 2 + pk % 3), lambda i: list_transform(range(1, CASE WHEN pk % 5 = 0 AND i = 2 THEN 4 ELSE 3 END), lambda j: CASE WHEN pk % 7 = 0 AND i = 1 AND j = 2 THEN '' ELSE 'r' || i || 'c' || j END)) END AS rows,
 (pk + pos) % 11 = 5 AS is_ast, CASE WHEN pk % 2 = 0 THEN 'Cap ' || pk END AS caption, {_some_sql("h", "pk % 3")} AS header, CASE WHEN pk % 31 = 0 THEN [] ELSE {_some_sql("b", "(1 + pk % 2)")} || CASE WHEN pk % 4 = 0 THEN [{_row_sql("w", "1", 2)}] ELSE [] END END AS body, {_some_sql("f", "CASE WHEN pk % 5 = 0 THEN 1 ELSE 0 END")} AS footer FROM li)"""


def cb_sql(body: str) -> str:
    return with_cte("li", CB_SQL + body).replace("FROM lineitem) , cb", "FROM lineitem), cb").replace("FROM lineitem), , cb", "FROM lineitem), cb")


def indentation_lost(text: Column) -> Column:
    """Several lines of code, and none after the first but lone braces begins with white space."""
    said = F.filter(F.split(text, "\n"), lambda x: T.strip(x) != "")
    rest = F.filter(F.slice(said, 2, F.greatest(F.size(said), F.lit(1))), lambda x: ~T.strip(x).isin("}", "};", "{"))
    return (F.size(said) > 1) & (F.size(rest) > 0) & ~F.exists(rest, lambda x: x.rlike(r"^[ \t]"))


def _numbered(array: Column, of) -> Column:
    """``of(index, item)`` of every item, nulls left out; indices from 0."""
    return F.array_compact(F.transform(array, lambda x, i: of(i, x)))


def table_rules(block: Column) -> Column:
    """V5: rules that a table breaks, as text with row and section. Rows are compared with the first, widths with spans."""
    at = lambda rule, *where: F.concat_ws(" ", F.lit(rule), block, *where)
    rows, ast = F.col("rows"), F.col("ast")
    none = F.array().cast("array<string>")
    uneven = _numbered(rows, lambda i, r: F.when(F.size(r) != F.size(rows[0]), at("columns", _s(i))))
    blank = F.flatten(F.transform(rows, lambda r, i: _numbered(r, lambda j, c: F.when(T.strip(c) == "", at("blank-cell", _s(i), _s(j))))))
    found = [F.coalesce(uneven, none), F.coalesce(blank, none), F.when(ast.isNotNull() & (F.size(ast["body"]) == 0), F.array(at("ast-body"))).otherwise(none)]
    width = lambda r: F.aggregate(r, F.lit(0), lambda a, c: a + F.when(c["colspan"] >= 1, c["colspan"]).otherwise(1))

    def of_section(part: str) -> list[Column]:
        rs = ast[part]
        no_text = lambda i: lambda j, c: F.when(T.strip(c["text"]) == "", at("ast-blank", F.lit(part), _s(i), _s(j)))
        empty = F.flatten(F.transform(rs, lambda r, i: _numbered(r, no_text(i))))
        other = _numbered(rs, lambda i, r: F.when(width(r) != width(F.get(rs, F.lit(0))), at("ast-width", F.lit(part), _s(i))))
        return [F.coalesce(empty, none), F.coalesce(other, none)]

    for part in ("header", "body", "footer"):
        found += of_section(part)
    return F.concat(*found)


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = canonical_blocks(spark, sf_dir)
    text, kind = F.col("text"), F.col("type")
    own = F.array_compact(F.array(F.when((kind == "paragraph") & T.leaks(text), F.concat(F.lit("leak "), "id")), F.when((kind == "paragraph") & T.has_markdown(text), F.concat(F.lit("markdown "), "id")), F.when((kind == "code") & indentation_lost(text), F.concat(F.lit("code-indent "), "id"))))
    by_block = b.select("doc_id", F.explode(F.concat(own, F.when(kind == "table", table_rules(F.col("id"))).otherwise(F.array().cast("array<string>")))).alias("fault"))
    twice = b.groupBy("doc_id", "id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.explode(F.array_repeat(F.concat(F.lit("duplicate-id "), "id"), (F.col("n") - 1).cast("int"))).alias("fault"))
    links = b.select("doc_id", F.explode("links").alias("id"))
    dead = links.join(b.select("doc_id", "id"), ["doc_id", "id"], "left_anti").select("doc_id", F.concat(F.lit("dead-link "), "id").alias("fault"))
    heads = b.where("type = 'heading'").withColumn("prev", F.lag("level", 1, 0).over(Window.partitionBy("doc_id").orderBy("pos")))
    heads = heads.groupBy("doc_id").agg(F.count_if(F.col("level") == 1).alias("h1"), F.min_by("level", "pos").alias("first"), F.bool_or(F.col("level") > F.col("prev") + 1).alias("skips"))
    whole = F.array_compact(F.array(F.when(F.col("h1") > 1, "many-h1"), F.when(F.col("first") != 1, "first-not-h1"), F.when(F.col("skips"), "heading-skip")))
    return by_block.unionByName(twice).unionByName(dead).unionByName(heads.select("doc_id", F.explode(whole).alias("fault")))


_AST_FAULTS = " UNION ALL ".join(
    f"""SELECT doc_id, unnest(flatten(list_transform(range(1, len({p}) + 1), lambda i: list_filter(list_transform(range(1, len({p}[i]) + 1), lambda j: CASE WHEN trim({p}[i][j].text) = '' THEN 'ast-blank ' || id || ' {p} ' || (i - 1) || ' ' || (j - 1) END), lambda x: x IS NOT NULL)))) FROM cb WHERE is_ast
 UNION ALL SELECT doc_id, unnest(list_filter(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN list_sum(list_transform({p}[i], lambda c: c.colspan)) <> list_sum(list_transform({p}[1], lambda c: c.colspan)) THEN 'ast-width ' || id || ' {p} ' || (i - 1) END), lambda x: x IS NOT NULL)) FROM cb WHERE is_ast"""
    for p in ("header", "body", "footer")
)
FAULTS_SQL = rf""", hd AS (SELECT doc_id, count(*) FILTER (level = 1) AS h1, arg_min(level, pos) AS first, bool_or(level > prev + 1) AS skips FROM (SELECT *, lag(level, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM cb WHERE type = 'heading') GROUP BY doc_id),
 ft(doc_id, fault) AS (SELECT doc_id, 'leak ' || id FROM cb WHERE type = 'paragraph' AND contains(text, 'chain of thought') UNION ALL SELECT doc_id, 'markdown ' || id FROM cb WHERE type = 'paragraph' AND (contains(text, '**') OR text LIKE '- %') UNION ALL SELECT doc_id, 'code-indent ' || id FROM cb WHERE type = 'code' AND contains(text, chr(10)) AND NOT contains(text, chr(10) || ' ')
 UNION ALL SELECT doc_id, unnest(list_filter(list_transform(range(1, len(rows) + 1), lambda i: CASE WHEN len(rows[i]) <> len(rows[1]) THEN 'columns ' || id || ' ' || (i - 1) END), lambda x: x IS NOT NULL)) FROM cb WHERE rows IS NOT NULL
 UNION ALL SELECT doc_id, unnest(flatten(list_transform(range(1, len(rows) + 1), lambda i: list_filter(list_transform(range(1, len(rows[i]) + 1), lambda j: CASE WHEN rows[i][j] = '' THEN 'blank-cell ' || id || ' ' || (i - 1) || ' ' || (j - 1) END), lambda x: x IS NOT NULL)))) FROM cb WHERE rows IS NOT NULL
 UNION ALL SELECT doc_id, 'ast-body ' || id FROM cb WHERE is_ast AND len(body) = 0 UNION ALL {_AST_FAULTS}
 UNION ALL SELECT doc_id, unnest(list_transform(range(1, n), lambda i: 'duplicate-id ' || id)) FROM (SELECT doc_id, id, count(*) AS n FROM cb GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT doc_id, 'dead-link ' || l FROM (SELECT doc_id, unnest(links) AS l FROM cb) x WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.doc_id = x.doc_id AND cb.id = x.l)
 UNION ALL SELECT doc_id, unnest(list_filter([CASE WHEN h1 > 1 THEN 'many-h1' END, CASE WHEN first <> 1 THEN 'first-not-h1' END, CASE WHEN skips THEN 'heading-skip' END], lambda x: x IS NOT NULL)) FROM hd)"""


@query(cb_sql(FAULTS_SQL + " SELECT doc_id, fault, count(*)::BIGINT AS n FROM ft GROUP BY ALL"))
def document_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a document breaks, with the block and cell."""
    return faults(spark, sf_dir).groupBy("doc_id", "fault").agg(F.count("*").alias("n"))


WARN_SQL = """, wn(doc_id, w) AS (SELECT doc_id, 'image-alt ' || id FROM cb WHERE type = 'image' AND alt IS NULL UNION ALL SELECT doc_id, 'table-header ' || id FROM cb WHERE is_ast AND len(header) = 0 AND len(body) > 1 UNION ALL SELECT doc_id, 'table-ast ' || id FROM cb WHERE len(rows) > 1)"""


@query(
    cb_sql(FAULTS_SQL + WARN_SQL + """ SELECT doc_id, severity, count(*)::BIGINT AS n, string_agg(what, '; ' ORDER BY what) AS listed FROM (SELECT doc_id, 'BLOCKER' AS severity, fault AS what FROM ft UNION ALL SELECT doc_id, 'WARNING', w FROM wn
    UNION ALL SELECT o_orderkey, 'BLOCKER', 'no-sections' FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM li)) GROUP BY ALL""")
)
def document_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules and documents without sections block; images without text and tables without headers are warned of."""
    b = canonical_blocks(spark, sf_dir)
    warn = F.array_compact(F.array(
        F.when((F.col("type") == "image") & F.col("alt").isNull(), F.concat(F.lit("image-alt "), "id")), F.when((F.size("ast.header") == 0) & (F.size("ast.body") > 1), F.concat(F.lit("table-header "), "id")), F.when(F.col("ast").isNull() & (F.size("rows") > 1), F.concat(F.lit("table-ast "), "id")),
    ))
    named = lambda df, severity, c: df.select("doc_id", F.lit(severity).alias("severity"), F.col(c).alias("what"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    empty = orders.join(b.select("doc_id"), "doc_id", "left_anti").withColumn("w", F.lit("no-sections"))
    every = named(faults(spark, sf_dir), "BLOCKER", "fault").unionByName(named(b.select("doc_id", F.explode(warn).alias("w")), "WARNING", "w")).unionByName(named(empty, "BLOCKER", "w"))
    return every.groupBy("doc_id", "severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("what")), "; ").alias("listed"))


_PROFILES = ", ".join(str((p, v)) for p, vs in SHOWN.items() for v in vs)


@query(
    cb_sql(FAULTS_SQL + f""", pf(profile, verbosity) AS (VALUES {_PROFILES}) SELECT doc_id, profile, count(*) FILTER (coalesce(cb.verbosity, 'basic') IN (SELECT verbosity FROM pf q WHERE q.profile = p.profile))::BIGINT AS shown, count(*) FILTER (coalesce(cb.verbosity, 'basic') NOT IN (SELECT verbosity FROM pf q WHERE q.profile = p.profile))::BIGINT AS hidden
    FROM cb CROSS JOIN (SELECT DISTINCT profile FROM pf) p WHERE doc_id NOT IN (SELECT doc_id FROM ft) GROUP BY ALL""")
)
def export_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a blocker, and for each profile the blocks that it shows and must not show."""
    ok = canonical_blocks(spark, sf_dir).join(faults(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")
    v = F.coalesce("verbosity", F.lit("basic"))
    by = ok.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.count_if(v.isin(*vs)).alias(p) for p, vs in SHOWN.items()])
    return by.select("doc_id", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.col(p).alias("shown")) for p in SHOWN])).alias("x")).select("doc_id", "x.profile", "x.shown", (F.col("n") - F.col("x.shown")).alias("hidden"))


def tidy(section: Column) -> Column:
    """Rows without blank cells, and no rows without cells; texts stripped."""
    rows = F.transform(section, lambda r: F.filter(F.transform(r, lambda c: F.struct(T.strip(c["text"]).alias("text"), c["scope"].alias("scope"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"))), lambda c: c["text"] != ""))
    return F.filter(rows, lambda r: F.size(r) > 0)


def with_table(b: DataFrame) -> DataFrame:
    """head, body, foot and caption of every table; rows become a body; the first of several rows is the header if there is none."""
    typed = lambda r: F.transform(r, lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("scope"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan")))
    none = F.array().cast(f"array<array<{CELL}>>")
    body = tidy(F.coalesce(F.col("ast.body"), F.transform("rows", typed), none))
    b = b.withColumns({"h0": tidy(F.coalesce(F.col("ast.header"), none)), "b0": body, "foot": tidy(F.coalesce(F.col("ast.footer"), none)), "caption": F.col("ast.caption")})
    infer = (F.size("h0") == 0) & (F.size("b0") >= 2)
    head = F.when(infer, F.slice("b0", 1, 1)).otherwise(F.col("h0"))
    return b.withColumns({"head": head, "body": F.when(infer, F.slice("b0", 2, F.greatest(F.size("b0"), F.lit(1)))).otherwise(F.col("b0")), "table": (F.col("type") == "table") & (F.size("b0") > 0)})


TABLE_SQL = """, t0 AS (SELECT *, list_filter(list_transform(CASE WHEN is_ast THEN header ELSE [] END, lambda r: list_filter(r, lambda c: trim(c.text) <> '')), lambda r: len(r) > 0) AS h0, list_filter(list_transform(CASE WHEN is_ast THEN body ELSE list_transform(coalesce(rows, []), lambda r: list_transform(r, lambda x: {'text': x, 'scope': NULL, 'rowspan': 1, 'colspan': 1})) END, lambda r: list_filter(r, lambda c: trim(c.text) <> '')), lambda r: len(r) > 0) AS b0,
  list_filter(list_transform(CASE WHEN is_ast THEN footer ELSE [] END, lambda r: list_filter(r, lambda c: trim(c.text) <> '')), lambda r: len(r) > 0) AS foot FROM cb),
 tt AS (SELECT * EXCLUDE (header, body), CASE WHEN len(h0) = 0 AND len(b0) >= 2 THEN b0[1:1] ELSE h0 END AS head, CASE WHEN len(h0) = 0 AND len(b0) >= 2 THEN b0[2:] ELSE b0 END AS body, type = 'table' AND len(b0) > 0 AS tab FROM t0),
 tn AS (SELECT *, CASE WHEN len(head) > 0 THEN list_transform(range(1, coalesce(list_max(list_transform(head, lambda r: len(r))), 0) + 1), lambda j: array_to_string(list_filter(list_transform(head, lambda r: trim(r[j].text)), lambda x: x IS NOT NULL), ' - ')) ELSE [] END AS names FROM tt),
 tl AS (SELECT *, array_to_string((CASE WHEN is_ast AND caption IS NOT NULL THEN ['Tabela: ' || caption] ELSE [] END) || list_transform(range(1, len(body) + 1), lambda i: 'Linha ' || i || ': ' || CASE WHEN len(names) > 0 AND len(names) = len(body[i]) THEN array_to_string(list_transform(range(1, len(names) + 1), lambda j: names[j] || ': ' || trim(body[i][j].text)), '; ') ELSE array_to_string(list_transform(body[i], lambda c: trim(c.text)), ' | ') END)
  || list_transform(foot, lambda r: 'Rodape: ' || array_to_string(list_transform(r, lambda c: trim(c.text)), ' | ')), chr(10)) AS linear FROM tn)"""


def linear(b: DataFrame) -> DataFrame:
    """Lines of a table: its caption, rows with the merged headers if as many, the footer."""
    said = lambda r: F.transform(r, lambda c: c["text"])
    width = F.array_max(F.transform("head", lambda r: F.size(r)))
    names = F.when(F.size("head") > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.array_join(F.array_compact(F.transform("head", lambda r: F.get(r, j)["text"])), " - "))).otherwise(F.array().cast("array<string>"))
    row = lambda i, r: F.concat(F.lit("Linha "), _s(i + 1), F.lit(": "), F.when((F.size("names") > 0) & (F.size("names") == F.size(r)), F.array_join(F.zip_with("names", said(r), lambda a, x: F.concat(a, F.lit(": "), x)), "; ")).otherwise(F.array_join(said(r), " | ")))
    b = with_table(b).withColumn("names", names)
    parts = F.concat(F.array_compact(F.array(F.concat(F.lit("Tabela: "), "caption"))), F.transform("body", lambda r, i: row(i, r)), F.transform("foot", lambda r: F.concat(F.lit("Rodape: "), F.array_join(said(r), " | "))))
    return b.withColumn("linear", F.array_join(parts, "\n"))


@query(cb_sql(TABLE_SQL + " SELECT doc_id, pos, linear, len(names)::BIGINT AS columns FROM tl WHERE tab"))
def linearized_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read out line by line, with several header rows merged."""
    return linear(canonical_blocks(spark, sf_dir)).where("table").select("doc_id", "pos", "linear", F.size("names").cast("long").alias("columns"))


def _joined(rows: DataFrame, name: str) -> DataFrame:
    """Texts (pos, t) of a document in order, one to a line."""
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("p")).select("doc_id", F.trim(F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias(name))


@query(
    cb_sql(TABLE_SQL + """ SELECT doc_id, trim(string_agg(CASE WHEN type = 'heading' THEN coalesce(title, text) WHEN type = 'list' THEN '- ' || text WHEN type = 'table' THEN CASE WHEN tab THEN linear END WHEN type = 'image' THEN coalesce(alt, text) ELSE text END, chr(10) ORDER BY pos)) AS body
    FROM tl WHERE coalesce(verbosity, 'basic') = 'basic' GROUP BY doc_id""")
)
def text_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain text of the blocks that the text profile shows."""
    kind = F.col("type")
    line = F.when(kind == "heading", F.coalesce("title", "text")).when(kind == "list", F.concat(F.lit("- "), "text")).when(kind == "table", F.when(F.col("table"), F.col("linear"))).when(kind == "image", F.coalesce("alt", "text")).otherwise(F.col("text"))
    b = linear(canonical_blocks(spark, sf_dir).where("coalesce(verbosity, 'basic') = 'basic'")).withColumn("t", line)
    # A document of which the profile shows only empty tables has no text.
    shown = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("pos", "t")))).alias("p"))
    return shown.select("doc_id", F.when(F.size("p") > 0, F.trim(F.array_join(F.transform("p", lambda x: x["t"]), "\n"))).alias("body"))


def html_rows(section: Column, tag: str) -> Column:
    """Rows of a table section; header cells have a scope, spans of more than one are written."""
    span = lambda c, name: F.when(c[name] > 1, F.concat(F.lit(f' {name}="'), _s(c[name]), F.lit('"'))).otherwise("")
    scope = (lambda c: F.concat(F.lit(' scope="'), F.coalesce(c["scope"], F.lit("col")), F.lit('"'))) if tag == "th" else lambda c: F.lit("")
    cell = lambda c: F.concat(F.lit(f"<{tag}"), scope(c), span(c, "rowspan"), span(c, "colspan"), F.lit(">"), T.escape_html(c["text"]), F.lit(f"</{tag}>"))
    return F.array_join(F.transform(section, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), "")


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _rows_sql(section: str, tag: str) -> str:
    scope = "' scope=\"' || coalesce(c.scope, 'col') || '\"' || " if tag == "th" else ""
    return f"array_to_string(list_transform({section}, lambda r: '<tr>' || array_to_string(list_transform(r, lambda c: '<{tag}' || {scope} CASE WHEN c.colspan > 1 THEN ' colspan=\"' || c.colspan || '\"' ELSE '' END || '>' || {_esc('trim(c.text)')} || '</{tag}>'), '') || '</tr>'), '')"


_HTML_SQL = rf"""CASE type WHEN 'heading' THEN '<h' || level || ' id="' || id || '">' || {_esc("coalesce(title, text)")} || '</h' || level || '>' WHEN 'paragraph' THEN '<p id="' || id || '">' || {_esc("text")} || '</p>' WHEN 'code' THEN '<pre id="' || id || '"><code>' || {_esc("text")} || '</code></pre>' WHEN 'list' THEN '<ul id="' || id || '"><li>' || {_esc("text")} || '</li></ul>'
 WHEN 'table' THEN CASE WHEN tab THEN '<table id="' || id || '">' || CASE WHEN is_ast AND caption IS NOT NULL THEN '<caption>' || {_esc("caption")} || '</caption>' ELSE '' END || CASE WHEN len(head) > 0 THEN '<thead>' || {_rows_sql("head", "th")} || '</thead>' ELSE '' END || CASE WHEN len(body) > 0 THEN '<tbody>' || {_rows_sql("body", "td")} || '</tbody>' ELSE '' END || CASE WHEN len(foot) > 0 THEN '<tfoot>' || {_rows_sql("foot", "td")} || '</tfoot>' ELSE '' END || '</table>' ELSE '' END
 WHEN 'image' THEN '<figure id="' || id || '"><img alt="' || {_esc("coalesce(alt, text)")} || '" src="">' || CASE WHEN long IS NOT NULL THEN '<details><summary>Descrição da imagem</summary><p>' || {_esc("long")} || '</p></details>' ELSE '' END || '</figure>' WHEN 'math' THEN '<p id="' || id || '"><math>' || {_esc("text")} || '</math></p>'
 ELSE '<details id="' || id || '"><summary>' || {_esc("coalesce(title, upper(type[1]) || type[2:])")} || '</summary><p>' || {_esc("text")} || '</p></details>' END"""


def html_block() -> Column:
    """The element of a block for the interactive profile."""
    esc = lambda c: T.escape_html(F.col(c) if isinstance(c, str) else c)
    at = F.concat(F.lit(' id="'), esc("id"), F.lit('">'))
    tag = lambda name, inner: F.concat(F.lit(f"<{name}"), at, inner, F.lit(f"</{name}>"))
    part = lambda section, name, cell: F.when(F.size(section) > 0, F.concat(F.lit(f"<{name}>"), html_rows(F.col(section), cell), F.lit(f"</{name}>"))).otherwise("")
    wrap = lambda a, x, z: F.concat(F.lit(a), x, F.lit(z))
    kind, h = F.col("type"), F.concat(F.lit("h"), _s(F.least(F.lit(6), F.greatest(F.lit(1), F.col("level")))))
    table = tag("table", F.concat(F.coalesce(wrap("<caption>", esc("caption"), "</caption>"), F.lit("")), part("head", "thead", "th"), part("body", "tbody", "td"), part("foot", "tfoot", "td")))
    image = tag("figure", F.concat(wrap('<img alt="', esc(F.coalesce("alt", "text")), '" src="">'), F.coalesce(wrap("<details><summary>Descrição da imagem</summary><p>", esc("long"), "</p></details>"), F.lit(""))))
    aside = tag("details", F.concat(wrap("<summary>", esc(F.coalesce("title", F.initcap("type"))), "</summary>"), wrap("<p>", esc("text"), "</p>")))
    return (
        F.when(kind == "heading", F.concat(F.lit("<"), h, at, esc(F.coalesce("title", "text")), F.lit("</"), h, F.lit(">")))
        .when(kind == "paragraph", tag("p", esc("text")))
        .when(kind == "code", tag("pre", wrap("<code>", esc("text"), "</code>")))
        .when(kind == "list", tag("ul", wrap("<li>", esc("text"), "</li>")))
        .when(kind == "table", F.when(F.col("table"), table).otherwise(""))
        .when(kind == "image", image)
        .when(kind == "math", tag("p", wrap("<math>", esc("text"), "</math>")))
        .otherwise(aside)
    )


@query(
    cb_sql(TABLE_SQL + f""", hb AS (SELECT doc_id, pos, {_HTML_SQL} AS el, CASE WHEN type = 'heading' THEN '<li class="lvl-' || level || '"><a href="#' || id || '">' || {_esc("coalesce(title, text)")} || '</a></li>' END AS toc FROM tl)
    SELECT doc_id, '<main>' || coalesce('<nav class="toc" aria-label="Sumário"><strong>Sumário</strong><ul>' || string_agg(toc, '' ORDER BY pos) || '</ul></nav>', '') || string_agg(el, chr(10) ORDER BY pos) || '</main>' AS html FROM hb GROUP BY doc_id""")
)
def html_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main part of a page: contents from the headings, then the elements of all blocks, tables with their sections."""
    entry = F.when(F.col("type") == "heading", F.concat(F.lit('<li class="lvl-'), _s(F.col("level")), F.lit('"><a href="#'), "id", F.lit('">'), T.escape_html(F.coalesce("title", "text")), F.lit("</a></li>")))
    b = with_table(canonical_blocks(spark, sf_dir)).select("doc_id", F.struct("pos", html_block().alias("t"), entry.alias("toc")).alias("p")).groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    toc = F.array_compact(F.transform("p", lambda x: x["toc"]))
    nav = F.when(F.size(toc) > 0, F.concat(F.lit('<nav class="toc" aria-label="Sumário"><strong>Sumário</strong><ul>'), F.array_join(toc, ""), F.lit("</ul></nav>"))).otherwise("")
    return b.select("doc_id", F.concat(F.lit("<main>"), nav, F.array_join(F.transform("p", lambda x: x["t"]), "\n"), F.lit("</main>")).alias("html"))


_NODE = {"heading": "Header", "paragraph": "Para", "code": "CodeBlock", "list": "BulletList", "table": "Table", "image": "Para", "math": "Math", "note": "BlockQuote", "quote": "BlockQuote", "warning": "BlockQuote"}


@query(
    cb_sql(TABLE_SQL + f""" SELECT doc_id, pos, CASE type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NODE.items())} END AS node, CASE WHEN type = 'heading' THEN level END AS level, CASE WHEN type IN ('heading', 'code') THEN id ELSE '' END AS id,
    CASE WHEN type IN ('table', 'math', 'code') THEN '' ELSE array_to_string(list_filter(string_split(CASE WHEN type = 'image' THEN coalesce(alt, text) ELSE text END, ' '), lambda x: x <> ''), '␠') END AS inlines, CASE WHEN type = 'table' THEN list_max(list_transform(head || body || foot, lambda r: len(r)))::BIGINT END AS columns,
    CASE WHEN type = 'table' THEN array_to_string(list_transform(flatten(head || body || foot), lambda c: CASE WHEN c.scope = 'row' THEN 'R' WHEN c.scope = 'col' THEN 'L' ELSE 'D' END), '') END AS aligned FROM tl WHERE type <> 'table' OR tab""")
)
def ast_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node a block: its kind, level and id, the words with the spaces between them, and a table's columns and alignments."""
    kind = F.col("type")
    node = F.try_element_at(F.create_map(*[F.lit(x) for kv in _NODE.items() for x in kv]), kind)
    words = F.filter(F.split(F.when(kind == "image", F.coalesce("alt", "text")).otherwise(F.col("text")), " "), lambda x: x != "")
    rows = F.concat("head", "body", "foot")
    side = lambda c: F.when(c["scope"].isin("row", "rowgroup"), "R").when(c["scope"].isin("col", "colgroup"), "L").otherwise("D")
    b = with_table(canonical_blocks(spark, sf_dir)).where("type <> 'table' OR table")
    return b.select(
        "doc_id", "pos", node.alias("node"), F.when(kind == "heading", F.col("level")).alias("level"), F.when(kind.isin("heading", "code"), F.col("id")).otherwise("").alias("id"), F.when(kind.isin("table", "math", "code"), "").otherwise(F.array_join(words, "␠")).alias("inlines"),
        F.when(kind == "table", F.array_max(F.transform(rows, lambda r: F.size(r)))).cast("long").alias("columns"), F.when(kind == "table", F.array_join(F.transform(F.flatten(rows), side), "")).alias("aligned"),
    )


@query(
    cb_sql(""", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM cb WHERE type = 'heading'), o AS (SELECT doc_id, pos, CASE WHEN k = 1 THEN 0 ELSE least(k - 1, min(CASE WHEN k = 1 THEN 0 ELSE level END - k) OVER (PARTITION BY doc_id ORDER BY k) + k) END AS outline FROM r)
    SELECT doc_id, pos, CASE type WHEN 'heading' THEN 'Heading ' || level WHEN 'code' THEN 'Courier New' WHEN 'list' THEN 'List Bullet' WHEN 'table' THEN 'Table Grid' WHEN 'quote' THEN 'Quote' ELSE 'Normal' END AS style, outline::BIGINT AS outline, text FROM cb LEFT JOIN o USING (doc_id, pos)""")
)
def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles for word-processor rows, levels capped at 9, and bookmarks that never go down more than one level."""
    kind = F.col("type")
    b = canonical_blocks(spark, sf_dir).withColumn("head", kind == "heading")
    by = Window.partitionBy("doc_id", "head").orderBy("pos")
    b = b.withColumn("k", F.row_number().over(by)).withColumn("l", F.when(F.col("k") == 1, 0).otherwise(F.col("level")))
    outline = F.when(F.col("k") == 1, 0).otherwise(F.least(F.col("k") - 1, F.min(F.col("l") - F.col("k")).over(by) + F.col("k")))
    style = F.when(F.col("head"), F.concat(F.lit("Heading "), _s(F.least(F.col("level"), F.lit(9))))).when(kind == "code", "Courier New").when(kind == "list", "List Bullet").when(kind == "table", "Table Grid").when(kind == "quote", "Quote").otherwise("Normal")
    return b.select("doc_id", "pos", style.alias("style"), F.when(F.col("head"), outline).cast("long").alias("outline"), "text")
