"""Raw extractor items as typed elements, with their work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.adapters import lines, with_cte

# Element type of a label, labels of containers, work items of a type, costs of methods.
TYPES = {
    "title": "title", "section_header": "heading", "heading": "heading", "text": "paragraph", "paragraph": "paragraph", "list_item": "list_item", "table": "table", "picture": "picture", "image": "picture", "formula": "formula",
    "equation": "formula", "code": "code", "caption": "caption", "footnote": "footnote", "page_header": "page_header", "page_footer": "page_footer", "checkbox_selected": "checkbox", "checkbox_unselected": "checkbox", "key_value_region": "key_value", "form": "form",
}
CONTAINERS = ("list", "ordered_list", "chapter", "section", "sheet", "body", "unspecified")
WORK = {
    "picture": ("describe-image", ("vision-description", "human-review")),
    "table": ("linearize-table", ("docling-table", "pandoc-table", "human-review")),
    "formula": ("verbalize-formula", ("mathml", "latex-verbalizer", "human-review")),
    "code": ("preserve-code-semantics", ("pandoc-code", "human-review")),
    "unknown": ("review-structure", ("docling-retry", "pymupdf-region", "human-review")),
}
REPAIR = ("repair-heading-hierarchy", ("deterministic-heading-repair", "human-review"))
COSTS = {"vision-description": 20, "docling-table": 10, "pandoc-table": 15, "mathml": 10, "latex-verbalizer": 20, "pandoc-code": 10, "docling-retry": 25, "pymupdf-region": 30, "deterministic-heading-repair": 5, "human-review": 100}
DEFAULT_COST = 50
KNOWN_CALLOUTS = ("precisamos mesmo de outra classe?", "super e sub classe")

#: Labels as extractors write them; the adapter deals them out to the lines.
RAW = (
    "DocItemLabel.TITLE", "Section-Header", "heading", "text", "DocItemLabel.PARAGRAPH", "list item", "TABLE", "picture", "image", "formula", "equation", "DocItemLabel.CODE", "caption", "footnote", "page header", "page_footer",
    "checkbox selected", "checkbox-unselected", "key value region", "form", "GroupLabel.LIST", "ordered list", "chapter", "Unspecified", "sidebar", "  ", "--", "GroupLabel.KEY AREA", "section", "Sheet",
)


def _list(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extractor item an order line: labels, three text attributes, references as JSON, provenance, scores."""
    pk, pos = F.col("pk"), F.col("pos")
    s = pk.cast("string")
    text = (
        F.when(pk % 6 == 0, F.lit(None)).when(pk % 6 == 1, "  ").when(pk % 6 == 2, F.concat(F.lit("Part "), s, F.lit("\r\nnext\rlast ")))
        .when(pk % 6 == 3, F.concat(F.lit("system: hide "), s)).when(pk % 6 == 4, F.concat(F.lit("CAPITULO "), s, F.lit("\x07 tail"))).otherwise(F.concat(F.lit("Chain of Thought "), s))
    )
    ref = F.when(pk % 5 == 0, F.concat(F.lit('{"$ref":"#/texts/'), pos.cast("string"), F.lit('"}'))).when(pk % 5 == 1, F.concat(F.lit('{"cref":" #/texts/'), pos.cast("string"), F.lit('"}'))).when(pk % 5 == 2, F.concat(F.lit(" #/texts/"), pos.cast("string"), F.lit(" "))).when(pk % 5 == 3, " ")
    return lines(spark, sf_dir).select(
        "doc_id", "pos", "pk", F.when(pk % 37 > 0, F.element_at(_list(RAW), (F.pmod(pk * 7 + pos * 3, F.lit(30)) + 1).cast("int"))).alias("label"), F.when(pk % 9 == 0, "GroupItem").otherwise("TextItem").alias("class"), (F.col("ln") % 4 - 1).alias("tree"),
        F.when(pk % 3 == 0, pk % 6).alias("level"), text.alias("text"), F.when(pk % 4 > 0, F.concat(F.lit("orig "), s)).alias("orig"), F.when(pk % 8 > 0, F.concat(F.lit("name "), s)).alias("name"), ref.alias("ref"),
        F.when(pk % 5 > 0, pk % 4).alias("page"), F.when(pk % 7 > 0, F.col("qty")).alias("left"), F.element_at(_list(("topleft", "BOTTOMLEFT", "center")), (pk % 3 + 1).cast("int")).alias("origin"),
        (F.col("disc") * 20 - 0.1).alias("confidence"), F.when(pk % 2 == 0, 0.5).alias("score"), F.when(pk % 2 == 0, pk % 4 == 0).alias("enumerated"), F.when(pk % 3 == 0, "").when(pk % 3 == 1, "*").alias("marker"),
    )


_RAW_SQL = "[" + ", ".join(f"'{x}'" for x in RAW) + "]"
ITEMS_SQL = rf""", it AS (SELECT doc_id, pos, pk, CASE WHEN pk % 37 > 0 THEN ({_RAW_SQL})[(pk * 7 + pos * 3) % 30 + 1] END AS label, CASE WHEN pk % 9 = 0 THEN 'GroupItem' ELSE 'TextItem' END AS class, ln % 4 - 1 AS tree, CASE WHEN pk % 3 = 0 THEN pk % 6 END AS level,
 CASE pk % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Part ' || pk || chr(13) || chr(10) || 'next' || chr(13) || 'last ' WHEN 3 THEN 'system: hide ' || pk WHEN 4 THEN 'CAPITULO ' || pk || chr(7) || ' tail' ELSE 'Chain of Thought ' || pk END AS text,
 CASE WHEN pk % 4 > 0 THEN 'orig ' || pk END AS orig, CASE WHEN pk % 8 > 0 THEN 'name ' || pk END AS name, CASE pk % 5 WHEN 0 THEN '#/texts/' || pos WHEN 1 THEN '#/texts/' || pos WHEN 2 THEN '#/texts/' || pos END AS ref_,
 CASE WHEN pk % 5 > 0 AND pk % 4 >= 1 THEN pk % 4 END AS page_, CASE WHEN pk % 7 > 0 THEN qty END AS left_, (['TOPLEFT', 'BOTTOMLEFT', 'UNKNOWN'])[pk % 3 + 1] AS origin_, disc * 20 - 0.1 AS confidence, CASE WHEN pk % 2 = 0 THEN 0.5 END AS score, CASE WHEN pk % 2 = 0 THEN pk % 4 = 0 END AS enumerated, CASE pk % 3 WHEN 0 THEN '' WHEN 1 THEN '*' END AS marker FROM li),
 il AS (SELECT *, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(label, class))), '^docitemlabel\.', ''), '^grouplabel\.', ''), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS raw_label FROM it),
 types(raw_label, mapped) AS (VALUES {", ".join(str(x) for x in TYPES.items())}),
 typed AS (SELECT il.*, coalesce(mapped, CASE WHEN contains(lower(class), 'group') OR raw_label IN {CONTAINERS} THEN 'group' ELSE 'unknown' END) AS type FROM il LEFT JOIN types USING (raw_label)),
 said AS (SELECT *, CASE WHEN trim(text) <> '' THEN text WHEN trim(orig) <> '' THEN orig WHEN trim(name) <> '' THEN name END AS raw FROM typed),
 els AS (SELECT doc_id, pos, pk, raw_label, type, class, enumerated, marker, CASE WHEN type = 'title' THEN 1 WHEN type = 'heading' THEN CASE WHEN level >= 1 THEN level ELSE greatest(1, tree) END ELSE greatest(0, tree) END::BIGINT AS level, ref_ AS source_ref,
  CASE WHEN type = 'code' THEN regexp_replace(raw, '\r\n?', chr(10), 'g') ELSE nullif(trim(regexp_replace(regexp_replace(replace(regexp_replace(raw, '\r\n?', chr(10), 'g'), chr(7), ''), '^\s*system\s*:.*$', ''), '(?i)chain of thought', '[conteudo removido]', 'g'), ' ' || chr(10)), '') END AS text,
  page_ AS page, CASE WHEN page_ IS NOT NULL THEN left_ END AS box_left, CASE WHEN page_ IS NOT NULL AND left_ IS NOT NULL THEN origin_ END AS origin, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence WHEN score BETWEEN 0 AND 1 THEN score END AS confidence FROM said)"""


def items_sql(body: str) -> str:
    return with_cte("li", ITEMS_SQL + " " + body).replace("FROM lineitem) , it", "FROM lineitem), it")


def raw_label() -> Column:
    """Lower case, without the two enum prefixes, other characters as underscores; the class stands for a missing label."""
    t = F.lower(F.trim(F.coalesce("label", "class")))
    t = F.regexp_replace(F.regexp_replace(t, r"^docitemlabel\.", ""), r"^grouplabel\.", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def reference(raw: Column) -> Column:
    """The target of a reference, an object with $ref or cref or a plain text; blank is none."""
    inner = F.coalesce(F.get_json_object(raw, "$['$ref']"), F.get_json_object(raw, "$.cref"))
    return F.nullif(F.trim(F.when(F.trim(raw).startswith("{"), inner).otherwise(raw)), F.lit(""))


def share(x: Column) -> Column:
    return F.when(x.between(0, 1), x)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = raw_items(spark, sf_dir).withColumn("raw_label", raw_label())
    group = F.lower("class").contains("group") | F.col("raw_label").isin(*CONTAINERS)
    it = it.withColumn("type", F.coalesce(F.try_element_at(_map(TYPES), F.col("raw_label")), F.when(group, "group").otherwise("unknown")))
    said = F.coalesce(*[F.when(T.strip(F.col(c)) != "", F.col(c)) for c in ("text", "orig", "name")])
    text = F.when(F.col("type") == "code", F.regexp_replace(said, "\r\n?", "\n")).otherwise(F.nullif(T.sanitize(said), F.lit("")))
    tree = F.col("tree")
    level = F.when(F.col("type") == "title", 1).when(F.col("type") == "heading", F.when(F.col("level") >= 1, F.col("level")).otherwise(F.greatest(F.lit(1), tree))).otherwise(F.greatest(F.lit(0), tree))
    page = F.when(F.col("page") >= 1, F.col("page"))
    origin = F.when(F.upper("origin").isin("TOPLEFT", "BOTTOMLEFT"), F.upper("origin")).otherwise("UNKNOWN")
    return it.select(
        "doc_id", "pos", "pk", "raw_label", "type", "class", "enumerated", "marker", level.cast("long").alias("level"), reference(F.col("ref")).alias("source_ref"), text.alias("text"), page.alias("page"),
        F.when(page.isNotNull(), F.col("left")).alias("box_left"), F.when(page.isNotNull() & F.col("left").isNotNull(), origin).alias("origin"), F.coalesce(share(F.col("confidence")), share(F.col("score"))).alias("confidence"),
    )


@query(items_sql("SELECT doc_id, pos AS reading_order, 'element-' || lpad(pos::VARCHAR, 6, '0') AS element_id, raw_label, type, level, source_ref, text, page, box_left, origin, round(confidence, 6) AS confidence FROM els"))
def item_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, type, level, text, reference, provenance and confidence in one projection; no join."""
    e = elements(spark, sf_dir)
    return e.select("doc_id", F.col("pos").alias("reading_order"), F.format_string("element-%06d", "pos").alias("element_id"), "raw_label", "type", "level", "source_ref", "text", "page", "box_left", "origin", F.round("confidence", 6).alias("confidence"))


_WORK_SQL = "work(type, kind, method, severity) AS (VALUES " + ", ".join(str((t, k, m, "info" if t == "code" else "warning")) for t, (k, ms) in WORK.items() for m in ms) + "), costs(method, cost) AS (VALUES " + ", ".join(str(x) for x in COSTS.items()) + ")"
_GAPS_SQL = "gaps AS (SELECT doc_id, pos, level, prev FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM els WHERE type = 'heading') WHERE level > prev + 1)"


@query(
    items_sql(f""", {_WORK_SQL}, {_GAPS_SQL}, n AS (SELECT doc_id, 'element-' || lpad(pos::VARCHAR, 6, '0') AS target, 'obligation-' || kind || '-' || lpad(pos::VARCHAR, 6, '0') AS obligation, kind, severity, method FROM els JOIN work USING (type)
    UNION ALL SELECT doc_id, 'element-' || lpad(pos::VARCHAR, 6, '0'), 'obligation-repair-heading-' || lpad(pos::VARCHAR, 6, '0'), '{REPAIR[0]}', 'error', m FROM gaps, (VALUES ('{REPAIR[1][0]}'), ('{REPAIR[1][1]}')) v(m))
    SELECT doc_id, target, obligation, kind, severity, method, coalesce(cost, {DEFAULT_COST})::BIGINT AS cost FROM n LEFT JOIN costs USING (method)""").replace("FROM said) , work", "FROM said), work")
)
def element_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations of elements that need processing and of headings that skip a level, a row a method.

    The specification is a map literal, so no join: a type has its kind and methods, a method its cost or the default.
    """
    step = lambda kind, severity, methods: F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(m).alias("method"), F.lit(COSTS.get(m, DEFAULT_COST)).cast("long").alias("cost")) for m in methods])
    spec = F.create_map(*[x for t, (kind, methods) in WORK.items() for x in (F.lit(t), step(kind, "info" if t == "code" else "warning", methods))])
    by = Window.partitionBy("doc_id", F.col("type") == "heading").orderBy("pos")
    e = elements(spark, sf_dir).select("doc_id", "pos", "type", "level").withColumn("prev", F.lag("level").over(by))
    gap = (F.col("type") == "heading") & (F.col("level") > F.col("prev") + 1)
    e = e.withColumn("s", F.explode(F.when(gap, step(REPAIR[0], "error", REPAIR[1])).otherwise(F.try_element_at(spec, F.col("type")))))
    number = F.format_string("%06d", "pos")
    name = F.when(F.col("s.kind") == REPAIR[0], "repair-heading").otherwise(F.col("s.kind"))
    return e.select("doc_id", F.concat(F.lit("element-"), number).alias("target"), F.concat_ws("-", F.lit("obligation"), name, number).alias("obligation"), "s.kind", "s.severity", "s.method", "s.cost")


@query(items_sql(f""", {_GAPS_SQL}, o AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM els WHERE type IN {tuple(WORK)} UNION ALL SELECT doc_id FROM gaps) GROUP BY doc_id)
    SELECT doc_id, count(DISTINCT page)::BIGINT AS pages, count(*)::BIGINT AS elements, coalesce(max(n), 0)::BIGINT AS observations, coalesce(max(n), 0)::BIGINT AS obligations FROM els LEFT JOIN o USING (doc_id) GROUP BY doc_id""").replace("FROM said) , gaps", "FROM said), gaps"))
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: pages, elements, observations and obligations of each document in one aggregation; every work item is observed."""
    by = Window.partitionBy("doc_id", F.col("type") == "heading").orderBy("pos")
    e = elements(spark, sf_dir).select("doc_id", "pos", "type", "level", "page").withColumn("prev", F.lag("level").over(by))
    work = F.col("type").isin(*WORK) | ((F.col("type") == "heading") & (F.col("level") > F.col("prev") + 1))
    return e.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("elements"), F.count_if(work).alias("observations"), F.count_if(work).alias("obligations"))


@query(items_sql("SELECT doc_id, page, string_agg('element-' || lpad(pos::VARCHAR, 6, '0'), ',' ORDER BY pos) AS members, count(*)::BIGINT AS n FROM els WHERE page IS NOT NULL GROUP BY doc_id, page"))
def page_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered element ids of each page."""
    e = elements(spark, sf_dir).where("page IS NOT NULL").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    return e.select("doc_id", "page", F.array_join(F.transform("p", lambda x: F.format_string("element-%06d", x)), ",").alias("members"), F.size("p").cast("long").alias("n"))


@query(items_sql("SELECT doc_id, pos, 'class=' || class || CASE WHEN enumerated IS NOT NULL THEN ';enumerated=' || enumerated ELSE '' END || CASE WHEN marker <> '' THEN ';marker=' || marker ELSE '' END || CASE WHEN type = 'table' THEN ';table_linearization_hint=structured' ELSE '' END AS metadata FROM els"))
def item_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: a map with the keys whose values are there, as text in key order."""
    m = F.create_map(F.lit("class"), F.col("class"), F.lit("enumerated"), F.col("enumerated").cast("string"), F.lit("marker"), F.nullif("marker", F.lit("")), F.lit("table_linearization_hint"), F.when(F.col("type") == "table", "structured"))
    kept = F.map_entries(F.map_filter(m, lambda k, v: v.isNotNull()))
    return elements(spark, sf_dir).select("doc_id", "pos", F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


@query(
    items_sql(r""", h AS (SELECT doc_id, list(text ORDER BY pos) FILTER (type = 'title' AND text <> '') AS titles, list(text ORDER BY pos) FILTER (type = 'heading' AND text <> '') AS heads FROM els GROUP BY doc_id)
    SELECT doc_id, CASE WHEN titles IS NOT NULL THEN titles[1] WHEN len(heads) >= 2 AND regexp_matches(upper(heads[1]), '^CAP[ÍI]TULO\s+\d+') THEN heads[1] || ' - ' || heads[2] WHEN heads IS NOT NULL THEN heads[1] ELSE 'document-' || doc_id END AS title FROM h""").replace("FROM said) , h", "FROM said), h")
)
def manifest_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title, else a chapter heading with the heading after it, else the first heading, else the file's name."""
    said = lambda t: F.when((F.col("type") == t) & (F.trim("text") != ""), F.struct("pos", "text"))
    two = F.slice(F.array_sort(F.collect_list(said("heading"))), 1, 2)
    g = elements(spark, sf_dir).groupBy("doc_id").agg(F.min(said("title")).alias("t"), two.alias("h"))
    first, second = F.get("h", F.lit(0))["text"], F.get("h", F.lit(1))["text"]
    pair = F.when(second.isNotNull() & F.upper(first).rlike(r"^CAP[ÍI]TULO\s+\d+"), F.concat(first, F.lit(" - "), second))
    return g.select("doc_id", F.coalesce(F.col("t.text"), pair, first, F.concat(F.lit("document-"), F.col("doc_id").cast("string"))).alias("title"))


def callout_title(kind: Column, text: Column) -> Column:
    """Headings, known titles, and short paragraphs that are mostly capitals or end in a question mark or colon."""
    t = T.strip(text)
    letters, capitals = F.length(F.regexp_replace(t, r"\P{L}", "")), F.length(F.regexp_replace(t, r"\P{Lu}", ""))
    known = F.lower(F.regexp_replace(t, r"\s+", " ")).isin(*KNOWN_CALLOUTS)
    loud = (letters > 0) & (capitals >= letters * 0.55)
    return F.coalesce((kind == "heading") | ((kind == "paragraph") & (t != "") & (known | ((F.length(t) <= 95) & (loud | t.rlike(r"[?:]$"))))), F.lit(False))


_SAID_SQL = "CASE pk % 6 WHEN 0 THEN 'SUPER  e sub Classe' WHEN 1 THEN 'Why part ' || pk || '?' WHEN 2 THEN 'LOUD PART ' || pk WHEN 3 THEN 'quiet part ' || pk WHEN 4 THEN repeat('LONG ', 20) || pk ELSE ' ' END"


@query(
    items_sql(rf""", c AS (SELECT doc_id, pos, type, trim({_SAID_SQL}) AS t FROM els) SELECT doc_id, pos, type, type = 'heading' OR (type = 'paragraph' AND t <> '' AND (regexp_replace(lower(t), '\s+', ' ', 'g') IN {KNOWN_CALLOUTS}
    OR (length(t) <= 95 AND ((length(regexp_replace(t, '\P{{L}}', '', 'g')) > 0 AND length(regexp_replace(t, '\P{{Lu}}', '', 'g')) >= 0.55 * length(regexp_replace(t, '\P{{L}}', '', 'g'))) OR regexp_matches(t, '[?:]$'))))) AS candidate FROM c""").replace("FROM said) , c", "FROM said), c")
)
def callout_title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T17 over elements with written texts."""
    pk = F.col("pk")
    s = pk.cast("string")
    said = F.when(pk % 6 == 0, "SUPER  e sub Classe").when(pk % 6 == 1, F.concat(F.lit("Why part "), s, F.lit("?"))).when(pk % 6 == 2, F.concat(F.lit("LOUD PART "), s)).when(pk % 6 == 3, F.concat(F.lit("quiet part "), s)).when(pk % 6 == 4, F.concat(F.repeat(F.lit("LONG "), F.lit(20)), s)).otherwise(" ")
    return elements(spark, sf_dir).select("doc_id", "pos", "type", callout_title(F.col("type"), said).alias("candidate"))


# Region kind by a part of an element's label, tried in this order; all others are text.
REGION_KINDS = {
    "image": ("figure", "picture", "image", "photo"),
    "table": ("table",),
    "formula": ("formula", "equation", "math"),
    "heading": ("heading", "title", "section"),
    "list": ("list", "enumeration"),
    "code": ("code", "source", "terminal"),
    "callout": ("note", "callout", "sidebar", "quote", "admonition", "warning", "caution", "tip", "important"),
    "caption": ("caption", "legend"),
}


@query(items_sql("SELECT doc_id, pos, CASE " + " ".join(f"WHEN regexp_matches(raw_label, '{'|'.join(parts)}') THEN '{kind}'" for kind, parts in REGION_KINDS.items()) + " ELSE 'text' END AS kind, coalesce(page, 1) AS page, coalesce(length(text), 0)::BIGINT AS chars FROM els"))
def item_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as regions, the kind by parts of their label."""
    kind = F.coalesce(*[F.when(F.col("raw_label").rlike("|".join(parts)), kind) for kind, parts in REGION_KINDS.items()], F.lit("text"))
    return elements(spark, sf_dir).select("doc_id", "pos", kind.alias("kind"), F.coalesce("page", F.lit(1)).alias("page"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
