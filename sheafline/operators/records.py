"""Rules and measures of whole records (V1-V3, P14, P15, A9, A10, A13, A14, K2, K3, J13, R1, S4, S5, O4, W8, W11, DT3)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.adapters import lines, read, with_cte
from .documents import canonical_blocks, cb_sql
from .folds import per_document
from .grammar import TX_SQL, text_lines
from .items import elements, items_sql
from .planning import EXTERNAL_SQL, edges, external_plans, graph, graph_sql, on_cycles


def _s(x):
    return x.cast("string")


def _li(body: str) -> str:
    return with_cte("li", body).replace("FROM lineitem) , ", "FROM lineitem), ").replace("FROM lineitem), , ", "FROM lineitem), ")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with parents of every sort: near, unknown, themselves, in circles; some ids twice; summaries with faults."""
    pk, pos = F.col("pk"), F.col("pos")
    parent = F.when(pk % 43 == 0, 99).when(pk % 47 == 0, pos).when(pk % 59 == 0, pos + 1).when((pk % 3 == 0) & (pos > 1), pos - 1)
    return lines(spark, sf_dir).select("doc_id", "pos", "pk", parent.alias("parent"), F.when(pk % 61 == 0, "e1").otherwise(F.concat(F.lit("e"), _s(pos))).alias("id"))


_PARENTS_SQL = ", pa AS (SELECT doc_id, pos, pk, CASE WHEN pk % 43 = 0 THEN 99 WHEN pk % 47 = 0 THEN pos WHEN pk % 59 = 0 THEN pos + 1 WHEN pk % 3 = 0 AND pos > 1 THEN pos - 1 END AS parent, CASE WHEN pk % 61 = 0 THEN 'e1' ELSE 'e' || pos END AS id FROM li)"


@query(
    graph_sql(_PARENTS_SQL + """, pe AS (SELECT p.doc_id, p.pos, p.parent FROM pa p JOIN pa q ON q.doc_id = p.doc_id AND q.pos = p.parent WHERE p.parent <> p.pos),
    up AS (SELECT doc_id, pos, parent FROM pe UNION SELECT u.doc_id, u.pos, e.parent FROM up u JOIN pe e ON e.doc_id = u.doc_id AND e.pos = u.parent),
    rc AS (SELECT doc_id, pos, dep FROM dk UNION SELECT r.doc_id, r.pos, e.dep FROM rc r JOIN dk e ON e.doc_id = r.doc_id AND e.pos = r.dep),
    v(doc_id, rule) AS (SELECT doc_id, 'unknown-parent' FROM pa WHERE parent IS NOT NULL AND (doc_id, parent) NOT IN (SELECT (doc_id, pos) FROM pa) UNION ALL SELECT doc_id, 'self-parent' FROM pa WHERE parent = pos UNION ALL SELECT doc_id, 'parent-cycle' FROM up WHERE pos = parent
      UNION ALL SELECT doc_id, 'duplicate-id' FROM pa GROUP BY doc_id, id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'unknown-dependency' FROM de WHERE (doc_id, dep) NOT IN (SELECT (doc_id, pos) FROM dg) UNION ALL SELECT doc_id, 'self-dependency' FROM de WHERE pos = dep UNION ALL SELECT doc_id, 'dependency-cycle' FROM rc WHERE pos = dep
      UNION ALL SELECT a.doc_id, 'open-predecessor' FROM dg a JOIN dk e USING (doc_id, pos) JOIN dg b ON b.doc_id = e.doc_id AND b.pos = e.dep WHERE a.satisfied AND NOT b.satisfied UNION ALL SELECT doc_id, 'attempt-method' FROM dg WHERE pk % 53 = 0 UNION ALL SELECT doc_id, 'unknown-artifact' FROM dg WHERE pk % 67 = 0
      UNION ALL SELECT doc_id, 'summary' FROM li GROUP BY doc_id HAVING doc_id % 12 = 5 UNION ALL SELECT doc_id, 'time-order' FROM li GROUP BY doc_id HAVING doc_id % 14 = 3)
    SELECT doc_id, rule, count(*)::BIGINT AS n FROM v GROUP BY ALL""", True)
)
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, J3, A12, G2, J6, J4, DT3: every broken reference, order, identity and count of a manifest, with how often."""
    p, g, e = parents(spark, sf_dir), graph(spark, sf_dir), edges(spark, sf_dir)
    said = lambda df, rule: df.select("doc_id", F.lit(rule).alias("rule"))
    orphans = p.where("parent IS NOT NULL").join(p.select("doc_id", F.col("pos").alias("parent")), ["doc_id", "parent"], "left_anti")
    chain = p.select("doc_id", "pos", F.when(F.col("parent").isNotNull() & (F.col("parent") != F.col("pos")), F.array(F.col("parent").cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("deps"))
    on = lambda rows: per_document(rows, "doc_id", ("pos", "deps"), on_cycles, "found", pa.list_(pa.int64()), "array<long>").select("doc_id", F.explode("found"))
    # What a manifest says of itself: counts, times, admissible methods and artifacts, some of them wrong.
    ms = g.withColumn("used", F.when(F.col("pk") % 53 == 0, F.array(F.lit("no-method"))).otherwise(F.slice("methods", 1, 1)))
    heads = g.groupBy("doc_id").agg(F.count("*").alias("n")).withColumns({"stated": F.col("n") + F.when(F.col("doc_id") % 12 == 5, 1).otherwise(0), "took": F.when(F.col("doc_id") % 14 == 3, -1).otherwise(1)})
    artifacts = F.array_except(F.when(F.col("pk") % 67 == 0, F.array(F.lit("a1"), F.lit("a9"))).otherwise(F.array(F.lit("a1"))), F.array(F.lit("a1"), F.lit("a2")))
    found = [
        said(orphans, "unknown-parent"), said(p.where("parent = pos"), "self-parent"), said(on(chain), "parent-cycle"), said(p.groupBy("doc_id", "id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate-id"),
        said(e.where("dep_satisfied IS NULL"), "unknown-dependency"), said(e.where("dep = pos"), "self-dependency"), said(on(g.select("doc_id", "pos", "deps")), "dependency-cycle"), said(e.where("satisfied AND NOT dep_satisfied"), "open-predecessor"),
        said(ms.where(F.size(F.array_except("used", "methods")) > 0), "attempt-method"), said(g.where(F.size(artifacts) > 0), "unknown-artifact"), said(heads.where("stated <> n"), "summary"), said(heads.where("took < 0"), "time-order"),
    ]
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    return every.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


STATUSES = ("extracted", "planned", "processing", "completed", "failed")


@query(
    _li(f""", r AS (SELECT doc_id, pos, CASE WHEN pk % 7 = 0 THEN 'XYZ' ELSE sha256(pk::VARCHAR) END AS sha, pk % 5 AS revision, (['extracted', 'planned', 'processing', 'done', 'failed'])[pk % 5 + 1] AS status, disc * 20 - 0.1 AS confidence, CASE WHEN pk % 11 = 0 THEN 'p' ELSE 'pt-BR' END AS language, qty - 3 AS page, CASE WHEN pk % 13 = 0 THEN '' ELSE 't' END AS title, pk % 17 - 1 AS cost, CASE WHEN pk % 19 > 0 THEN 'target' END AS target FROM li),
    v AS (SELECT doc_id, unnest(list_filter([CASE WHEN NOT regexp_matches(sha, '^[a-f0-9]{{64}}$') THEN 'sha256' END, CASE WHEN revision < 1 THEN 'revision' END, CASE WHEN status NOT IN {STATUSES} THEN 'status' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN length(language) < 2 THEN 'language' END, CASE WHEN page < 1 THEN 'page_number' END, CASE WHEN length(title) < 1 THEN 'title' END, CASE WHEN cost < 0 THEN 'cost' END, CASE WHEN target IS NULL THEN 'target_ids' END], lambda x: x IS NOT NULL)) AS rule FROM r)
    SELECT rule, count(*)::BIGINT AS n, min(doc_id)::BIGINT AS first_doc FROM v GROUP BY rule""")
)
def field_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: fields out of their range, pattern, set of values or length; each row is read once."""
    pk = F.col("pk")
    status = F.element_at(F.array(*[F.lit(x) for x in ("extracted", "planned", "processing", "done", "failed")]), (pk % 5 + 1).cast("int"))
    rules = {
        "sha256": ~F.when(pk % 7 == 0, "XYZ").otherwise(F.sha2(_s(pk), 256)).rlike("^[a-f0-9]{64}$"), "revision": pk % 5 < 1, "status": ~status.isin(*STATUSES), "confidence": ~(F.col("disc") * 20 - 0.1).between(0, 1),
        "language": F.length(F.when(pk % 11 == 0, "p").otherwise("pt-BR")) < 2, "page_number": F.col("qty") - 3 < 1, "title": F.length(F.when(pk % 13 == 0, "").otherwise("t")) < 1, "cost": pk % 17 - 1 < 0, "target_ids": F.when(pk % 19 > 0, "target").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))
    return lines(spark, sf_dir).select("doc_id", F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    graph_sql(EXTERNAL_SQL + """, t AS (SELECT doc_id, count(*) AS n, count(DISTINCT idx) AS d, min(idx) AS lo, max(idx) AS hi, arg_max(action, (idx, action)) AS last, sum(cost) AS cost, count(*) FILTER (action = 'execute-obligation') AS run, count(*) FILTER (action <> 'execute-obligation' AND (pos IS NOT NULL OR method IS NOT NULL)) AS extra,
      count(*) FILTER (action = 'execute-obligation' AND pos IS NULL) AS bare FROM xp GROUP BY doc_id)
    SELECT doc_id, n::BIGINT AS steps, lo = 0 AND hi = n - 1 AND d = n AS contiguous, last = 'complete-job' AS completes, (coalesce(cost, 0) + CASE WHEN doc_id % 6 = 1 THEN 5 ELSE 0 END) = coalesce(cost, 0) AS total_agrees, run::BIGINT AS executions, extra = 0 AND bare = 0 AS fields_agree FROM t""")
)
def plan_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices from 0 without gaps, the last action, the stated total, and fields that only executions have."""
    run = F.col("action") == "execute-obligation"
    g = external_plans(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("steps"), F.count_distinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.max_by("action", F.struct("idx", "action")).alias("last"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.count_if(run).alias("executions"), F.count_if(~run & (F.col("pos").isNotNull() | F.col("method").isNotNull())).alias("extra"), F.count_if(run & F.col("pos").isNull()).alias("bare"))
    stated = F.col("cost") + F.when(F.col("doc_id") % 6 == 1, 5).otherwise(0)
    return g.select("doc_id", "steps", ((F.col("lo") == 0) & (F.col("hi") == F.col("steps") - 1) & (F.col("d") == F.col("steps"))).alias("contiguous"), (F.col("last") == "complete-job").alias("completes"), (stated == F.col("cost")).alias("total_agrees"), "executions", ((F.col("extra") == 0) & (F.col("bare") == 0)).alias("fields_agree"))


# Callout types that warn, and what stands for a missing text.
WARNINGS = ("warning", "aviso", "importante", "caution")


@query(
    items_sql(f""", c AS (SELECT *, CASE WHEN pk % 4 = 0 THEN 'callout-' || pk % 8 END AS callout, CASE WHEN pk % 12 = 0 THEN 'title' ELSE 'content' END AS role, (['note', 'Aviso', 'caution'])[pk % 3 + 1] AS ctype, coalesce(text, '') AS t FROM els),
    b AS (SELECT *, CASE WHEN callout IS NOT NULL AND role <> 'title' THEN CASE WHEN lower(ctype) IN {WARNINGS} THEN 'warning' ELSE 'note' END WHEN type IN ('title', 'heading') THEN 'heading' WHEN type = 'list_item' THEN 'list' WHEN type = 'table' THEN 'table' WHEN type = 'picture' THEN 'image' WHEN type = 'code' THEN 'code' ELSE 'paragraph' END AS block FROM c)
    SELECT doc_id, pos, block, CASE WHEN block = 'heading' THEN CASE WHEN type = 'title' THEN 1 ELSE greatest(1, level) END END::BIGINT AS level, CASE WHEN block IN ('note', 'warning', 'list', 'code') THEN t WHEN block = 'table' THEN CASE WHEN t <> '' THEN t ELSE 'Tabela detectada' END WHEN block = 'image' THEN CASE WHEN t <> '' THEN t ELSE 'Imagem detectada sem descricao textual.' END
      WHEN type = 'formula' THEN CASE WHEN t <> '' THEN t ELSE 'Formula detectada.' END ELSE CASE WHEN t <> '' THEN t ELSE raw_label END END AS text, CASE WHEN block IN ('note', 'warning') THEN row_number() OVER (PARTITION BY doc_id, coalesce(page, 1), block IN ('note', 'warning'), callout ORDER BY pos) = 1 END AS titled FROM b""").replace("FROM said) , c", "FROM said), c")
)
def element_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of an element, with the texts that stand for missing ones; content of a callout comes before all
    types, and the first block of a callout on a page keeps its title."""
    pk, kind = F.col("pk"), F.col("type")
    e = elements(spark, sf_dir).withColumns({"t": F.coalesce("text", F.lit("")), "callout": F.when(pk % 4 == 0, F.concat(F.lit("callout-"), _s(pk % 8))), "role": F.when(pk % 12 == 0, "title").otherwise("content"), "ctype": F.element_at(F.array(F.lit("note"), F.lit("Aviso"), F.lit("caution")), (pk % 3 + 1).cast("int"))})
    inside = F.col("callout").isNotNull() & (F.col("role") != "title")
    plain = F.when(kind.isin("title", "heading"), "heading").when(kind == "list_item", "list").when(kind == "table", "table").when(kind == "picture", "image").when(kind == "code", "code").otherwise("paragraph")
    e = e.withColumn("block", F.when(inside, F.when(F.lower("ctype").isin(*WARNINGS), "warning").otherwise("note")).otherwise(plain)).withColumn("aside", F.col("block").isin("note", "warning"))
    b, t = F.col("block"), F.col("t")
    instead = F.when(b == "table", "Tabela detectada").when(b == "image", "Imagem detectada sem descricao textual.").when(kind == "formula", "Formula detectada.").otherwise(F.col("raw_label"))
    text = F.when(F.col("aside") | b.isin("list", "code") | (t != ""), t).otherwise(instead)
    first = F.row_number().over(Window.partitionBy("doc_id", F.coalesce("page", F.lit(1)), "aside", "callout").orderBy("pos")) == 1
    return e.select("doc_id", "pos", "block", F.when(b == "heading", F.when(kind == "title", 1).otherwise(F.greatest(F.lit(1), F.col("level")))).cast("long").alias("level"), text.alias("text"), F.when(F.col("aside"), first).alias("titled"))


_SAID = "CASE type WHEN 'table' THEN coalesce(array_to_string(flatten(rows), chr(10)), '') WHEN 'image' THEN coalesce(alt, '') WHEN 'list' THEN text ELSE text END"


@query(
    cb_sql(f""", m AS (SELECT doc_id, count(*) FILTER (type = 'heading' AND level = 1) AS sections, count(*) AS blocks, sum(length({_SAID})) + count(*) - 1 AS chars, count(*) FILTER (verbosity IS DISTINCT FROM 'technical') AS blocks2, coalesce(sum(length({_SAID})) FILTER (verbosity IS DISTINCT FROM 'technical'), 0) + greatest(0, count(*) FILTER (verbosity IS DISTINCT FROM 'technical') - 1) AS chars2, count(*) FILTER (type = 'heading' AND level = 1 AND verbosity IS DISTINCT FROM 'technical') AS sections2 FROM cb GROUP BY doc_id)
    SELECT doc_id, sections::BIGINT AS sections, blocks::BIGINT AS blocks, chars::BIGINT AS chars, (sections2 - sections)::BIGINT AS sections_delta, (blocks2 - blocks)::BIGINT AS blocks_delta, (chars2 - chars)::BIGINT AS chars_delta FROM m""")
)
def document_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-level sections, blocks and length of all text joined by line ends, and the differences to a second
    engine that leaves technical blocks out; one aggregation holds both."""
    kind = F.col("type")
    said = F.when(kind == "table", F.coalesce(F.array_join(F.flatten("rows"), "\n"), F.lit(""))).when(kind == "image", F.coalesce("alt", F.lit(""))).otherwise(F.col("text"))
    top, second = (kind == "heading") & (F.col("level") == 1), F.coalesce(F.col("verbosity") != "technical", F.lit(True))
    b = canonical_blocks(spark, sf_dir).withColumn("n", F.length(said))
    g = b.groupBy("doc_id").agg(F.count_if(top).alias("sections"), F.count("*").alias("blocks"), (F.sum("n") + F.count("*") - 1).alias("chars"), F.count_if(top & second).alias("s2"), F.count_if(second).alias("b2"), (F.coalesce(F.sum(F.when(second, F.col("n"))), F.lit(0)) + F.greatest(F.lit(0), F.count_if(second) - 1)).alias("c2"))
    return g.select("doc_id", "sections", "blocks", "chars", (F.col("s2") - F.col("sections")).alias("sections_delta"), (F.col("b2") - F.col("blocks")).alias("blocks_delta"), (F.col("c2") - F.col("chars")).alias("chars_delta"))


@query(
    _li(TX_SQL + r""", k AS (SELECT doc_id, pos, pk, pos % 2 AS page, trim(line) AS original, CASE WHEN pk % 5 = 0 THEN NULL WHEN pk % 5 = 1 THEN '' ELSE upper(left(trim(line), 4)) END AS answer, pk % 3 = 0 AS by_model FROM tx),
    f AS (SELECT *, CASE WHEN by_model THEN coalesce(nullif(answer, ''), original) ELSE original END AS body FROM k),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, lower(regexp_replace(body, '\s+', ' ', 'g')) ORDER BY pos) AS r FROM f WHERE body <> '')
    SELECT doc_id, page, count(*)::BIGINT AS parts, string_agg(CASE WHEN by_model THEN '[' || body || ']' ELSE body END, chr(10) || chr(10) ORDER BY pos) AS text FROM n WHERE r = 1 GROUP BY doc_id, page""")
)
def consolidated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a page's tasks, the original where a task failed or said nothing; the first of equal outputs
    stays, marks are put around a model's afterwards, and parts are joined by an empty line. A page is the group."""
    pk = F.col("pk")
    original = T.strip(F.col("line"))
    answer = F.when(pk % 5 == 0, F.lit(None)).when(pk % 5 == 1, "").otherwise(F.upper(F.left(original, F.lit(4))))
    model = pk % 3 == 0
    rows = text_lines(spark, sf_dir).select("doc_id", "pos", (F.col("pos") % 2).alias("page"), model.alias("by_model"), F.when(model, F.coalesce(F.nullif(answer, F.lit("")), original)).otherwise(original).alias("body")).where("body <> ''")
    same = F.lower(F.regexp_replace("body", r"\s+", " "))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page", same).orderBy("pos"))).where("r = 1")
    part = F.when(F.col("by_model"), F.concat(F.lit("["), "body", F.lit("]"))).otherwise(F.col("body"))
    g = first.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))).alias("p"))
    return g.select("doc_id", "page", F.size("p").cast("long").alias("parts"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


_BROKEN = ("the end of-", "line N goes on", "next one.", "=== Pagina 3 ===", "  indented more", "Capital start", "quoted;", "half-", "", "so it was")


@query(
    _li(", bl AS (SELECT doc_id, pos, replace((" + str(list(_BROKEN)) + f")[(pk + pos) % {len(_BROKEN)} + 1], 'N', pk::VARCHAR) AS line FROM li)" + r""", a AS (SELECT *, ltrim(lead(line) OVER (PARTITION BY doc_id ORDER BY pos)) AS nxt, regexp_matches(line, '^=== Pagina \d+ ===$') AS mark FROM bl),
    b AS (SELECT *, CASE WHEN mark OR nxt IS NULL OR NOT regexp_matches(nxt, '^[a-z]') THEN NULL WHEN line LIKE '%-' THEN line[:-2] || nxt WHEN line <> '' AND NOT regexp_matches(line, '[.!?:;"]$') THEN line || ' ' || nxt END AS glued FROM a),
    c AS (SELECT *, coalesce(sum(CASE WHEN glued IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY pos) AS k FROM c)
    SELECT doc_id, string_agg(CASE WHEN k % 2 = 1 AND glued IS NOT NULL THEN glued ELSE line END, chr(10) ORDER BY pos) AS text FROM d WHERE k % 2 = 1 GROUP BY doc_id""")
)
def rejoined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cut by a hyphen are glued and broken lines joined, a line being taken once; page marks never go on. In a run
    of lines that could go on, every second one has been taken by the one before."""
    k = (F.pmod(F.col("pk") + F.col("pos"), F.lit(len(_BROKEN))) + 1).cast("int")
    line = F.replace(F.element_at(F.array(*[F.lit(x) for x in _BROKEN]), k), F.lit("N"), _s(F.col("pk")))
    by = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines(spark, sf_dir).select("doc_id", "pos", line.alias("line")).withColumn("next", F.ltrim(F.lead("line").over(by)))
    x = F.col("line")
    goes = F.col("next").rlike("^[a-z]") & ~x.rlike(r"^=== Pagina \d+ ===$")
    glued = F.when(~F.coalesce(goes, F.lit(False)), None).when(x.endswith("-"), F.concat(F.substr(x, F.lit(1), F.length(x) - 1), "next")).when((x != "") & ~x.rlike('[.!?:;"]$'), F.concat_ws(" ", x, "next"))
    rows = rows.withColumn("glued", glued).withColumn("grp", F.coalesce(F.sum(F.when(F.col("glued").isNull(), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "grp").orderBy("pos"))).where("k % 2 = 1")
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("glued", "line").alias("t")))).alias("p"))
    return g.select("doc_id", F.array_join(F.transform("p", lambda y: y["t"]), "\n").alias("text"))


@query(
    """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, ts, event_type AS stage, CASE WHEN event_id % 3 > 0 THEN floor(value)::BIGINT END AS progress FROM events),
    c AS (SELECT *, coalesce(max(CASE WHEN stage = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM e)
    SELECT user_id, day, arg_max(progress, (ts, event_id)) FILTER (progress IS NOT NULL) AS progress, arg_max(stage, (ts, event_id)) AS stage, count(*) FILTER (stage = 'error')::BIGINT AS n_errors, coalesce(string_agg(CASE WHEN stage = 'error' THEN 'e' || event_id END, ',' ORDER BY ts, event_id), '') AS errors,
      CASE WHEN arg_max(stage, (ts, event_id)) IN ('error', 'purchase', 'click') THEN strftime(max(ts), '%Y-%m-%d %H:%M:%S') END AS ended FROM c WHERE gone = 0 GROUP BY user_id, day"""
)
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each field that isn't null, errors appended in order, an end for done, failed and cancelled
    tasks, and nothing after a cancel."""
    by = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 3 > 0, F.floor("value")).alias("progress"))
    live = e.withColumn("gone", F.coalesce(F.bool_or(F.col("stage") == "click").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("NOT gone")
    at = F.struct("ts", "event_id")
    g = live.groupBy("user_id", "day").agg(
        F.max(F.when(F.col("progress").isNotNull(), F.struct("ts", "event_id", "progress"))).alias("p"), F.max_by("stage", at).alias("stage"), F.max("ts").alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("stage") == "error", F.struct("ts", "event_id")))).alias("e"),
    )
    errors = F.array_join(F.transform("e", lambda x: F.concat(F.lit("e"), _s(x["event_id"]))), ",")
    return g.select("user_id", "day", "p.progress", "stage", F.size("e").cast("long").alias("n_errors"), errors.alias("errors"), F.when(F.col("stage").isin("error", "purchase", "click"), F.date_format("last", "yyyy-MM-dd HH:mm:ss")).alias("ended"))


@query(
    _li(TX_SQL + r""", s AS (SELECT t.doc_id, t.pos, t.pk, t.line, sk % 3 AS block, 10 + t.pk % 5 AS size, length(t.line) AS n, qty AS x0, disc * 2000 + 5 AS w FROM tx t JOIN li USING (doc_id, pos)),
    b AS (SELECT doc_id, block, string_agg(line, chr(10) ORDER BY pos) AS text, count(*)::BIGINT AS n_lines, sum(n)::BIGINT AS chars, CASE WHEN sum(n) > 0 THEN sum(size * n) / sum(n)::DOUBLE END AS mean_size, median(size) AS median_size, bool_and(pk % 2 = 0) AS mono, max(w) AS width, count(*) * 12.0 AS height,
      sum(length(regexp_replace(line, '\P{Lu}', '', 'g'))) AS upper, sum(length(regexp_replace(line, '\P{L}', '', 'g'))) AS letters FROM s GROUP BY doc_id, block)
    SELECT doc_id, block, md5(text) AS text, n_lines, chars, round(mean_size, 9) AS mean_size, median_size, mono, round(chars / greatest(1, width * height), 9) AS density, CASE WHEN letters > 0 THEN round(upper / letters::DOUBLE, 9) ELSE 0 END AS upper_ratio, least(1.0, 0.5 + CASE WHEN chars > 20 THEN 0.4 ELSE 0 END) AS confidence FROM b""")
)
def region_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a block joined in order, their lines and characters, the mean size by characters and the
    median, monospace, density in the block's box, share of capitals and a confidence by length."""
    n = F.length("line")
    letters = lambda keep: F.sum(F.length(F.regexp_replace("line", keep, "")))
    s = text_lines(spark, sf_dir).join(lines(spark, sf_dir).select("doc_id", "pos", (F.col("sk") % 3).alias("block"), (F.col("disc") * 2000 + 5).alias("w")), ["doc_id", "pos"]).withColumn("size", 10 + F.col("pk") % 5)
    g = s.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("p"), F.count("*").alias("n_lines"), F.sum(n).cast("long").alias("chars"), F.try_divide(F.sum(F.col("size") * n), F.sum(n)).alias("mean_size"), F.median("size").alias("median_size"), F.bool_and(F.col("pk") % 2 == 0).alias("mono"), F.max("w").alias("width"), letters(r"\P{Lu}").alias("upper"), letters(r"\P{L}").alias("letters"))
    density = F.col("chars") / F.greatest(F.lit(1.0), F.col("width") * F.col("n_lines") * 12.0)
    ratio = F.when(F.col("letters") > 0, F.round(F.col("upper") / F.col("letters"), 9)).otherwise(0.0)
    return g.select("doc_id", "block", F.md5(F.array_join(F.transform("p", lambda x: x["line"]), "\n")).alias("text"), "n_lines", "chars", F.round("mean_size", 9).alias("mean_size"), "median_size", "mono", F.round(density, 9).alias("density"), ratio.alias("upper_ratio"), F.least(F.lit(1.0), 0.5 + F.when(F.col("chars") > 20, 0.4).otherwise(0.0)).alias("confidence"))


@query("SELECT doc_id, left(text, 200) AS summary, md5(right(text, 1000)) AS tail FROM documents")
def text_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of 200 and a tail of 1000 characters of every text; the limits are the feature."""
    return read(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(200)).alias("summary"), F.md5(F.right("text", F.lit(1000))).alias("tail"))
