"""Text helpers, inputs, logs and visual tables (T11-T13, T16, T18, T23-T25, M5, DT2, S7, S8, S10, S12, S14, S15, A7, P15, P16, X4, A16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.adapters import lines, read, with_cte
from .items import elements, items_sql

CUT = "\x01"
DESCRIPTION = r"\[DESCRIÇÃO:\s*(.*?)\]"
# Marks of emphasis, of mathematics and of code.
EMPHASIS = r"(\*\*\*.*?\*\*\*|\*\*.*?\*\*|\*.*?\*)"
MATH = ("=", "+", "-", "*", "/", "^", "√", "∫", "∑", "π", "θ", "²", "³", "log", "sin", "cos", "tan")
CODE = ("class ", "public ", "private ", "protected ", "return ", "if (", "else")
# Spoken names of region classes and of callout labels.
SPOKEN = {"code_block": "código-fonte", "list_block": "lista", "callout_box": "box", "embedded_image": "imagem"}
CALLOUTS = {"note": "nota", "quote": "citação", "sidebar": "barra lateral", "warning": "aviso", "tip": "dica", "important": "importante", "admonition": "aviso", "caution": "aviso"}

#: Lines of the adapter; N is the part's number.
SAID = (
    "# Part N", "## Sub N", "### Deep N", "- item N", "* star *N*", "3. point N", "plain **N** and ***all* of it", "see [DESCRIÇÃO: a chart N] here", "[descrição:  map N ]", "", "x = N + 2 - sin(3)", "class A { public int n = N; return n; }", "N * 2 / 3",
    "pagina N de 9000000", "a; b; N", "c, d, N", "p | q | N", "t\tu\tN", "prompt: N", "chain of thought N", "|---|:--:|", "lonely, N",
)


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def said_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of prose, code, tables and descriptions."""
    k = (F.pmod(F.col("pk") * 5 + F.col("pos"), F.lit(len(SAID))) + 1).cast("int")
    return lines(spark, sf_dir).select("doc_id", "pos", "pk", F.replace(F.element_at(F.array(*[F.lit(x) for x in SAID]), k), F.lit("N"), F.col("pk").cast("string")).alias("line"))


SAID_SQL = ", sl AS (SELECT doc_id, pos, pk, replace(([" + ", ".join("'" + x.replace("'", "''").replace("\t", "' || chr(9) || '") + "'" for x in SAID) + f"])[(pk * 5 + pos) % {len(SAID)} + 1], 'N', pk::VARCHAR) AS line FROM li)"


def sl_sql(body: str) -> str:
    return with_cte("li", SAID_SQL + body).replace("FROM lineitem), , sl", "FROM lineitem), sl").replace("FROM lineitem) , sl", "FROM lineitem), sl")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a document as one text; every third line ends a paragraph."""
    p = said_lines(spark, sf_dir).withColumn("t", F.concat("line", F.when(F.col("pos") % 3 == 0, "\n\n").otherwise("\n")))
    return p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


_TEXT_SQL = ", tx AS (SELECT doc_id, string_agg(line || CASE WHEN pos % 3 = 0 THEN chr(10) || chr(10) ELSE chr(10) END, '' ORDER BY pos) AS text FROM sl GROUP BY doc_id)"


def split_paragraph(p: Column) -> Column:
    """(kind, text) of a paragraph: a description, a heading of three levels, or its lines."""
    item = lambda kind, t: F.struct(F.lit(kind).alias("kind"), T.strip(t).alias("text"))
    head = lambda kind, t, n: F.array(item(kind, F.substr(t, F.lit(n))))
    whole = rf"(?ius)^{DESCRIPTION}$"
    parts = lambda t: F.filter(F.transform(F.split(F.regexp_replace(t, rf"(?iu){DESCRIPTION}", f"{CUT}$1{CUT}"), CUT), lambda x, i: F.struct(F.when(i % 2 == 1, "description").otherwise("text").alias("kind"), T.strip(x).alias("text"))), lambda x: x["text"] != "")
    line = lambda t: F.when(t.rlike(rf"(?iu){DESCRIPTION}"), parts(t)).when(t.rlike(r"^[-*] "), head("bullet", t, 3)).when(t.rlike(r"^\d+\.\s"), F.array(item("number", F.regexp_replace(t, r"^\d+\. ", "")))).otherwise(F.array(item("text", t)))
    of_lines = F.flatten(F.transform(F.filter(F.transform(F.split(p, "\n"), lambda t: T.strip(t)), lambda t: t != ""), line))
    return F.when(p.rlike(whole), F.array(item("description", F.regexp_extract(p, whole, 1)))).when(p.startswith("### "), head("h3", p, 5)).when(p.startswith("## "), head("h2", p, 4)).when(p.startswith("# "), head("h1", p, 3)).otherwise(of_lines)


_D = r"\[DESCRIÇÃO:\s*(.*?)\]"


@query(
    sl_sql(_TEXT_SQL + rf""", pp AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '') AS ps FROM tx),
    it AS (SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN regexp_matches(p, '(?is)^{_D}$') THEN [{{'kind': 'description', 'text': trim(regexp_extract(p, '(?is)^{_D}$', 1))}}] WHEN p LIKE '### %' THEN [{{'kind': 'h3', 'text': p[5:]}}] WHEN p LIKE '## %' THEN [{{'kind': 'h2', 'text': p[4:]}}] WHEN p LIKE '# %' THEN [{{'kind': 'h1', 'text': p[3:]}}]
      ELSE flatten(list_transform(list_filter(list_transform(string_split(p, chr(10)), lambda t: trim(t, ' ' || chr(9))), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '(?i){_D}') THEN list_filter(list_transform(string_split(regexp_replace(t, '(?i){_D}', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x, i: {{'kind': CASE WHEN i % 2 = 0 THEN 'description' ELSE 'text' END, 'text': trim(x)}}), lambda x: x.text <> '')
        WHEN regexp_matches(t, '^[-*] ') THEN [{{'kind': 'bullet', 'text': trim(t[3:])}}] WHEN regexp_matches(t, '^\d+\.\s') THEN [{{'kind': 'number', 'text': regexp_replace(t, '^\d+\. ', '')}}] ELSE [{{'kind': 'text', 'text': t}}] END)) END)) AS x FROM pp)
    SELECT doc_id, unnest(range(0, len(x)))::BIGINT AS ord, unnest(list_transform(x, lambda y: y.kind)) AS kind, unnest(list_transform(x, lambda y: y.text)) AS text FROM it""")
)
def described_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text as descriptions, headings, bullets, numbers and lines, in order, without leaving its row."""
    ps = F.filter(F.transform(F.split("text", "\n\n"), lambda p: T.strip(p)), lambda p: p != "")
    return texts(spark, sf_dir).select("doc_id", F.posexplode(F.flatten(F.transform(ps, split_paragraph))).alias("ord", "x")).select("doc_id", F.col("ord").cast("long").alias("ord"), "x.kind", "x.text")


_E = EMPHASIS


@query(
    sl_sql(rf""" SELECT doc_id, pos, array_to_string(string_split(regexp_replace(line, '{_E}', chr(1) || '\1' || chr(1), 'g'), chr(1)), '¦') AS parts, {" + ".join(f"contains(line, '{x}')::INT" for x in MATH)} > 2 AS math,
    (contains(line, chr(10)) OR length(line) >= 90 OR pos > 3) AND {" + ".join(f"contains(line, '{x}')::INT" for x in CODE)} >= 2 AND regexp_matches(line, '[{{}};()]') AS code,
    CASE WHEN regexp_matches(line, '(?i)pagina \d+ de \d+') THEN (floor(regexp_extract(line, '(?i)pagina (\d+) de', 1)::DOUBLE * 100 / regexp_extract(line, '(?i)de (\d+)', 1)::DOUBLE))::BIGINT END AS percent,
    array_to_string(list_filter([CASE WHEN contains(line, 'chain of thought') THEN 'leak' END, CASE WHEN regexp_matches(line, '^#{{1,6}}\s+|^\s*[-*+]\s+|^\s*\d+\.\s+|\*\*.+\*\*') THEN 'markdown' END], lambda x: x IS NOT NULL), ',') AS output_faults FROM sl""")
)
def line_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emphasis parts; mathematics (over two of 17 marks); code (two tokens, a code mark, long or late);
    the percentage that a progress line states; faults of output text."""
    line = F.col("line")
    hits = lambda words: sum((line.contains(w).cast("int") for w in words), F.lit(0))
    long = line.contains("\n") | (F.length(line) >= 90) | (F.col("pos") > 3)
    page = r"(?i)pagina (\d+) de (\d+)"
    percent = F.when(line.rlike(page), F.floor(F.regexp_extract(line, page, 1).cast("double") * 100 / F.regexp_extract(line, page, 2).cast("double")))
    output = F.array_join(F.array_compact(F.array(F.when(T.leaks(line), "leak"), F.when(T.has_markdown(line), "markdown"))), ",")
    parts = F.array_join(F.split(F.regexp_replace(line, EMPHASIS, f"{CUT}$1{CUT}"), CUT), "¦")
    return said_lines(spark, sf_dir).select("doc_id", "pos", parts.alias("parts"), (hits(MATH) > 2).alias("math"), (long & (hits(CODE) >= 2) & line.rlike("[{};()]")).alias("code"), percent.alias("percent"), output.alias("output_faults"))


_CLASSES = ("code_block", "list_block", "callout_box", "embedded_image", "text_clean")
_LABELS = ("DocItemLabel.NOTE", "quote", " Sidebar ", "warning", "tip", "important", "admonition", "grouplabel.caution", "other")


@query(
    f"""WITH s(class, said) AS (VALUES {", ".join(str(x) for x in SPOKEN.items())}), c(label, name) AS (VALUES {", ".join(str(x) for x in CALLOUTS.items())}), r AS (SELECT p_partkey AS id, p_name, ({list(_CLASSES)})[p_partkey % 5 + 1] AS class, regexp_replace(regexp_replace(lower(trim(({list(_LABELS)})[p_partkey % 9 + 1])), '^docitemlabel\\.', ''), '^grouplabel\\.', '') AS label FROM part)
    SELECT id, CASE WHEN said IS NULL THEN p_name ELSE 'Início de ' || coalesce(name, said) || ':' || chr(10) || p_name || chr(10) || 'Fim de ' || coalesce(name, said) END AS marked FROM r LEFT JOIN s USING (class) LEFT JOIN c USING (label)"""
)
def marked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that open and close a region; the label of a callout has its own words."""
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % k + 1).cast("int"))
    label = F.regexp_replace(F.regexp_replace(F.lower(F.trim(pick(_LABELS, 9))), r"^docitemlabel\.", ""), r"^grouplabel\.", "")
    said = F.try_element_at(_map(SPOKEN), pick(_CLASSES, 5))
    name = F.coalesce(F.try_element_at(_map(CALLOUTS), label), said)
    marked = F.concat_ws("\n", F.concat(F.lit("Início de "), name, F.lit(":")), "p_name", F.concat(F.lit("Fim de "), name))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(said.isNull(), F.col("p_name")).otherwise(marked).alias("marked"))


AS_OF = "2023-07-01 00:00:00"
# Ages in seconds after which something is stale.
AGES = {"processing": 3600, "token": 7 * 86400, "temporary": 7200, "document": 3600, "page": 86400, "layout": 300}


@query(
    f"""SELECT event_id, {", ".join(f"date_diff('second', ts, TIMESTAMP '{AS_OF}') > {age} AS {name}" for name, age in AGES.items())}, CASE WHEN bytes < 1048576 THEN round_even(bytes / 1024, 0)::BIGINT || ' KB' ELSE printf('%.1f MB', bytes / 1048576) END AS size
    FROM (SELECT event_id, ts, event_id % 4000 * 1024.0 AS bytes FROM events)"""
)
def stale_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT2, M5, R5, R6: the six age rules at a stated time, and sizes in whole KB or in MB with one decimal."""
    age = F.timestamp_diff("SECOND", F.col("ts").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))
    size = (F.col("event_id") % 4000 * 1024).cast("double")
    text = F.when(size < 1048576, F.concat(F.bround(size / 1024, 0).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.format_string("%.1f MB", F.bround(size / 1048576, 1)))
    return read(spark, sf_dir, "events").select("event_id", *[(age > limit).alias(name) for name, limit in AGES.items()], text.alias("size"))


MOST_PAGES, FALLBACK_PAGES = 50, 10


@query(
    f"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents), w AS (SELECT *, list_filter(ps, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') AS kept FROM p)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE least(len(ps), {MOST_PAGES}) END::BIGINT AS pages, CASE WHEN doc_id % 3 = 0 THEN 'whole' WHEN len(ps) > {MOST_PAGES} THEN 'cut' ELSE 'split' END AS how, md5(array_to_string(kept[1:{FALLBACK_PAGES}], chr(10) || chr(10))) AS fallback FROM w"""
)
def input_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, up to the limit of 50 that the feature sets; other files are one page; the plain-text
    fallback is the first ten pages with text. Lines stand for pages, every third document for a file of another type."""
    whole = F.col("doc_id") % 3 == 0
    full = F.filter("ps", lambda x: T.strip(x) != "")
    d = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ps"))
    return d.select("doc_id", F.when(whole, 1).otherwise(F.least(F.size("ps"), F.lit(MOST_PAGES))).cast("long").alias("pages"), F.when(whole, "whole").when(F.size("ps") > MOST_PAGES, "cut").otherwise("split").alias("how"), F.md5(F.array_join(F.slice(full, 1, FALLBACK_PAGES), "\n\n")).alias("fallback"))


# Statistics of a planner's log.
STATISTICS = {
    "expanded": r"Expanded ([0-9]+) state", "evaluated": r"Evaluated ([0-9]+) state", "generated": r"Generated ([0-9]+) state", "dead_ends": r"Dead ends: ([0-9]+) state",
    "search_seconds": r"Search time: ([0-9.]+)s", "total_seconds": r"Total time: ([0-9.]+)s", "plan_cost": r"Plan cost: ([0-9]+)", "plan_length": r"Plan length: ([0-9]+) step",
}


@query(
    with_cte("li", f""", lg AS (SELECT doc_id, string_agg(CASE pos % 4 WHEN 0 THEN 'Expanded ' || pk || ' state(s).' WHEN 1 THEN 'Evaluated ' || pk || ' state(s), Generated ' || pk * 2 || ' state(s).' WHEN 2 THEN 'Dead ends: ' || pk % 5 || ' state(s). Search time: 0.' || pk || 's' ELSE 'Total time: 1.' || pk || 's Plan cost: ' || pk || ' Plan length: ' || pos || ' step(s).' END, chr(10) ORDER BY pos) AS log,
    list('sas_plan.' || pk) AS files FROM li GROUP BY doc_id) SELECT doc_id, {", ".join(f"list_last(regexp_extract_all(log, '{p}', 1))::DOUBLE AS {k}" for k, p in STATISTICS.items())}, list_max(list_transform(files, lambda f: regexp_extract(f, '[0-9]+$')::BIGINT)) AS last_plan FROM lg""").replace("FROM lineitem) , lg", "FROM lineitem), lg").replace("FROM lineitem), , lg", "FROM lineitem), lg")
)
def planner_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last match of each of eight statistics in a log, null if it has none; the plan file of the greatest number."""
    pk = F.col("pk")
    n = lambda x: x.cast("string")
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    kind = F.col("pos") % 4
    line = F.when(kind == 0, say("Expanded ", n(pk), " state(s).")).when(kind == 1, say("Evaluated ", n(pk), " state(s), Generated ", n(pk * 2), " state(s).")).when(kind == 2, say("Dead ends: ", n(pk % 5), " state(s). Search time: 0.", n(pk), "s")).otherwise(say("Total time: 1.", n(pk), "s Plan cost: ", n(pk), " Plan length: ", n(F.col("pos")), " step(s)."))
    g = lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))).alias("p"), F.collect_list(say("sas_plan.", n(pk))).alias("files"))
    g = g.select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("log"), "files")
    last = lambda p: F.try_element_at(F.regexp_extract_all("log", F.lit(p), F.lit(1)), F.lit(-1)).cast("double")
    return g.select("doc_id", *[last(p).alias(k) for k, p in STATISTICS.items()], F.array_max(F.transform("files", lambda f: F.regexp_extract(f, "[0-9]+$", 0).cast("long"))).alias("last_plan"))


def visual_rows(lines_: Column) -> Column:
    """Rows of the delimiter that a text's lines are cut by: pipes, then tabs, then the better of ; and , (; if equal).

    A delimiter counts if its rows, of two cells or more each, times the widest make four.
    """
    said = F.filter(F.transform(lines_, lambda x: T.strip(x)), lambda x: x != "")
    cut = lambda x, d: F.filter(F.transform(F.split(x, d), lambda c: T.strip(c)), lambda c: c != "")
    wide = lambda rows: F.filter(rows, lambda r: F.size(r) >= 2)
    separator = lambda x: F.replace(F.regexp_replace(x, r"^\|+|\|+$", ""), F.lit(" "), F.lit("")).rlike(r"^:?-{2,}:?(\|:?-{2,}:?)*$")
    pipes = wide(F.transform(F.filter(said, lambda x: x.contains("|") & ~separator(x)), lambda x: cut(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|")))
    by = lambda d: wide(F.transform(F.filter(said, lambda x: x.contains(d) & ~x.contains("|")), lambda x: cut(x, d)))
    score = lambda rows: F.size(rows) * F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    enough = lambda rows: F.when(score(rows) >= 4, rows)
    points = lambda rows: F.when(score(rows) >= 4, score(rows)).otherwise(0)
    return F.coalesce(enough(pipes), enough(by("\t")), F.when(points(by(";")) >= points(by(",")), enough(by(";"))).otherwise(enough(by(","))))


def _by_sql(d: str) -> str:
    return f"list_filter(list_transform(list_filter(said, lambda x: contains(x, {d}) AND NOT contains(x, '|')), lambda x: list_filter(list_transform(string_split(x, {d}), lambda c: trim(c)), lambda c: c <> '')), lambda r: len(r) >= 2)"


@query(
    sl_sql(rf""", tl AS (SELECT doc_id, list_filter(list(trim(line, ' ' || chr(9)) ORDER BY pos), lambda x: x <> '') AS said FROM sl GROUP BY doc_id),
    c AS (SELECT doc_id, list_filter(list_transform(list_filter(said, lambda x: contains(x, '|') AND NOT regexp_matches(replace(trim(x, '|'), ' ', ''), '^:?-{{2,}}:?(\|:?-{{2,}}:?)*$')), lambda x: list_filter(list_transform(string_split(trim(x, '|'), '|'), lambda c: trim(c)), lambda c: c <> '')), lambda r: len(r) >= 2) AS p, {_by_sql("chr(9)")} AS t, {_by_sql("';'")} AS s, {_by_sql("','")} AS k FROM tl),
    n AS (SELECT *, len(p) * coalesce(list_max(list_transform(p, lambda r: len(r))), 0) AS np, len(t) * coalesce(list_max(list_transform(t, lambda r: len(r))), 0) AS nt, len(s) * coalesce(list_max(list_transform(s, lambda r: len(r))), 0) AS ns, len(k) * coalesce(list_max(list_transform(k, lambda r: len(r))), 0) AS nk FROM c),
    b AS (SELECT doc_id, CASE WHEN np >= 4 THEN p WHEN nt >= 4 THEN t WHEN ns >= 4 AND ns >= nk THEN s WHEN nk >= 4 THEN k END AS rows FROM n)
    SELECT doc_id, array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10)) AS rows, len(rows)::BIGINT AS n_rows, list_max(list_transform(rows, lambda r: len(r)))::BIGINT AS n_columns, coalesce(len(rows) >= 2, false) AS structured FROM b""")
)
def visual_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read from the text of an element that has no structure; two rows of two cells are structure."""
    d = said_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("p")).select("doc_id", visual_rows(F.transform("p", lambda x: x["line"])).alias("r"))
    width = F.array_max(F.transform("r", lambda x: F.size(x)))
    n = F.when(F.col("r").isNotNull(), F.size("r")).cast("long")
    return d.select("doc_id", F.when(F.col("r").isNotNull(), F.array_join(F.transform("r", lambda x: F.array_join(x, " | ")), "\n")).alias("rows"), n.alias("n_rows"), width.cast("long").alias("n_columns"), F.coalesce((n >= 2) & (width >= 2), F.lit(False)).alias("structured"))


# Texts and labels that stand for no content.
PLACEHOLDERS = ("body", "_root_", "root", "unspecified", "group")
TEXTUAL = ("heading", "title", "paragraph", "list_item", "table", "code", "formula")


@query(
    items_sql(f""", v AS (SELECT doc_id, pos, type, raw_label, CASE WHEN doc_id % 3 > 0 THEN coalesce(text, '') ELSE 'Body' END AS t, page FROM els),
    m AS (SELECT *, NOT bool_or(type IN {TEXTUAL} AND t <> '' AND lower(t) NOT IN {PLACEHOLDERS}) OVER (PARTITION BY doc_id) AS visual, type = 'picture' AND t = '' AS blank, type IN ('group', 'unknown', 'paragraph') AND (t = '' OR lower(t) IN {PLACEHOLDERS} OR raw_label IN ('body', 'unspecified', 'group')) AS stand_in FROM v),
    w AS (SELECT *, bool_or(blank) OVER (PARTITION BY doc_id) AS any_blank, bool_or(stand_in) OVER (PARTITION BY doc_id) AS any_stand_in, min(pos) OVER (PARTITION BY doc_id) AS first, min(coalesce(page, 1)) OVER (PARTITION BY doc_id) = max(coalesce(page, 1)) OVER (PARTITION BY doc_id) AS one_page FROM m)
    SELECT doc_id, pos, CASE WHEN any_blank THEN 'picture' WHEN any_stand_in THEN 'placeholder' ELSE 'first' END AS why FROM w WHERE CASE WHEN any_blank THEN blank WHEN NOT visual THEN false WHEN any_stand_in THEN stand_in ELSE one_page AND pos = first END""").replace("FROM said) , v", "FROM said), v")
)
def pictures_to_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank pictures; in a document without text the elements that stand for one, else the first of a single page."""
    t = F.when(F.col("doc_id") % 3 > 0, F.coalesce("text", F.lit(""))).otherwise("Body")
    e = elements(spark, sf_dir).withColumn("t", t)
    empty = F.lower("t").isin(*PLACEHOLDERS)
    doc = Window.partitionBy("doc_id")
    e = e.withColumns({
        "visual": ~F.max(F.col("type").isin(*TEXTUAL) & (F.col("t") != "") & ~empty).over(doc), "blank": (F.col("type") == "picture") & (F.col("t") == ""),
        "stand_in": F.col("type").isin("group", "unknown", "paragraph") & ((F.col("t") == "") | empty | F.col("raw_label").isin("body", "unspecified", "group")), "one_page": F.min(F.coalesce("page", F.lit(1))).over(doc) == F.max(F.coalesce("page", F.lit(1))).over(doc),
    })
    e = e.withColumns({"any_blank": F.max("blank").over(doc), "any_stand_in": F.max("stand_in").over(doc), "first": F.min("pos").over(doc)})
    chosen = F.when(F.col("any_blank"), F.col("blank")).when(~F.col("visual"), False).when(F.col("any_stand_in"), F.col("stand_in")).otherwise(F.col("one_page") & (F.col("pos") == F.col("first")))
    return e.where(chosen).select("doc_id", "pos", F.when(F.col("any_blank"), "picture").when(F.col("any_stand_in"), "placeholder").otherwise("first").alias("why"))


PROMPTS = {("ocr", "image"): "ocr-image.txt", ("*", "image"): "image.txt", ("*", "table"): "table.txt", ("*", "scanned"): "scanned.txt", ("ocr", "*"): "ocr.txt"}


@query(
    f"""WITH p(mode, region, file) AS (VALUES {", ".join(str((*k, v)) for k, v in PROMPTS.items())}), q AS (SELECT p_partkey AS id, (['ocr', 'normal', 'detailed'])[p_partkey % 3 + 1] AS mode, (['image', 'table', 'formula', 'scanned'])[p_size % 4 + 1] AS region FROM part)
    SELECT id, coalesce(a.file, b.file, c.file, 'default.txt') AS file FROM q LEFT JOIN p a ON a.mode = q.mode AND a.region = q.region LEFT JOIN p b ON b.mode = '*' AND b.region = q.region LEFT JOIN p c ON c.mode = q.mode AND c.region = '*'"""
)
def prompt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of a mode and region, else of the region, else of the mode, else the default; keys of one map."""
    files = _map({f"{mode}/{region}": file for (mode, region), file in PROMPTS.items()})
    mode = F.element_at(F.array(*[F.lit(x) for x in ("ocr", "normal", "detailed")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    region = F.element_at(F.array(*[F.lit(x) for x in ("image", "table", "formula", "scanned")]), (F.col("p_size") % 4 + 1).cast("int"))
    at = lambda m, r: F.try_element_at(files, F.concat_ws("/", m, r))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.coalesce(at(mode, region), at(F.lit("*"), region), at(mode, F.lit("*")), F.lit("default.txt")).alias("file"))
