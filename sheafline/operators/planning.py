"""Plans over obligations with lists of dependencies."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import lines, with_cte
from .folds import per_document
from .items import COSTS, WORK

KINDS = tuple(kind for kind, _ in WORK.values())
METHODS = {kind: methods for kind, methods in WORK.values()}


def _list(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _cost(method: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COSTS.items() for x in kv]), method), F.lit(50)).cast("long")


def _methods(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, ms in METHODS.items() for x in (F.lit(k), _list(ms))]), kind)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations with near, far, backward, unknown and self dependencies, methods that are away and attempts that failed."""
    pk, pos, d = F.col("pk"), F.col("pos"), F.col("doc_id")
    deps = F.array_distinct(F.array_compact(F.array(
        F.when((pk % 2 == 0) & (pos > 1), pos - 1), F.when((pk % 3 == 0) & (pos > 2), F.floor(pos / 2)), F.when((pk % 5 == 0) & (pos > 2), F.lit(1).cast("long")), F.when(pk % 41 == 0, pos + 2), F.when(pk % 89 == 0, pos),
    )))
    kind = F.element_at(_list(KINDS), (F.pmod(pk + pos, F.lit(5)) + 1).cast("int"))
    away = F.array_compact(F.array(F.when(d % 4 == 0, "human-review"), F.when(d % 3 == 0, "mathml")))
    rows = lines(spark, sf_dir).select("doc_id", "pos", "pk", deps.alias("deps"), kind.alias("kind"), ((pk + F.col("ln")) % 3 == 0).alias("satisfied"), (pk % 4 == 0).alias("selected"), away.alias("away"), F.when(d % 2 == 0, "queued").otherwise("processing").alias("lifecycle"))
    ms = _methods(F.col("kind"))
    tried = F.when(pk % 31 == 0, ms).when(pk % 6 == 0, F.slice(ms, 1, 1)).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"methods": ms, "tried": tried})


_METHODS_SQL = "km(kind, method, ord, cost) AS (VALUES " + ", ".join(str((k, m, i, COSTS.get(m, 50))) for k, ms in METHODS.items() for i, m in enumerate(ms)) + ")"
GRAPH_SQL = f""", {_METHODS_SQL}, dg AS (SELECT doc_id, pos, pk, ({list(KINDS)})[(pk + pos) % 5 + 1] AS kind, (pk + ln) % 3 = 0 AS satisfied, pk % 4 = 0 AS selected, CASE WHEN doc_id % 2 = 0 THEN 'queued' ELSE 'processing' END AS lifecycle FROM li),
 de AS (SELECT DISTINCT doc_id, pos, dep FROM (SELECT doc_id, pos, unnest([CASE WHEN pk % 2 = 0 AND pos > 1 THEN pos - 1 END, CASE WHEN pk % 3 = 0 AND pos > 2 THEN pos // 2 END, CASE WHEN pk % 5 = 0 AND pos > 2 THEN 1 END, CASE WHEN pk % 41 = 0 THEN pos + 2 END, CASE WHEN pk % 89 = 0 THEN pos END]) AS dep FROM li) WHERE dep IS NOT NULL),
 dk AS (SELECT e.* FROM de e JOIN dg t ON t.doc_id = e.doc_id AND t.pos = e.dep),
 tr AS (SELECT doc_id, pos, method FROM dg JOIN km USING (kind) WHERE pk % 31 = 0 OR (pk % 6 = 0 AND ord = 0)),
 aw AS (SELECT DISTINCT doc_id, m AS method FROM li, (VALUES ('human-review', 4), ('mathml', 3)) v(m, k) WHERE doc_id % k = 0),
 roots AS (SELECT doc_id, pos FROM (SELECT *, bool_or(selected) OVER (PARTITION BY doc_id) AS any_selected FROM dg) WHERE CASE WHEN any_selected THEN selected ELSE NOT satisfied END)"""
CLOSURE_SQL = ", closure AS (SELECT doc_id, pos FROM roots UNION SELECT e.doc_id, e.dep FROM closure c JOIN dk e ON e.doc_id = c.doc_id AND e.pos = c.pos)"


def graph_sql(body: str, recursive: bool = False) -> str:
    return with_cte("li", GRAPH_SQL + body, recursive).replace("FROM lineitem) , km", "FROM lineitem), km")


def closure_of(rows: list[dict]) -> list[int]:
    """Positions of the selected rows, else of the open ones, and all that they depend on."""
    deps = {r["pos"]: r["deps"] for r in rows}
    stack = [r["pos"] for r in rows if r["selected"]] or [r["pos"] for r in rows if not r["satisfied"]]
    seen = set(stack)
    while stack:
        for d in deps[stack.pop()]:
            if d in deps and d not in seen:
                seen.add(d)
                stack.append(d)
    return sorted(seen)


def on_cycles(rows: list[dict]) -> list[int]:
    """Positions that reach themselves: strong components of several nodes, and nodes with an edge to themselves."""
    deps = {r["pos"]: [d for d in r["deps"]] for r in rows}
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    path: list[int] = []
    out: list[int] = []
    for start in deps:
        if start in index:
            continue
        work = [(start, iter(deps[start]))]
        index[start] = low[start] = len(index)
        path.append(start)
        while work:
            node, rest = work[-1]
            for d in rest:
                if d not in deps:
                    continue
                if d not in index:
                    index[d] = low[d] = len(index)
                    path.append(d)
                    work.append((d, iter(deps[d])))
                    break
                if low[d] >= 0:  # still on the path
                    low[node] = min(low[node], index[d])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    at = path.index(node)
                    part, path[at:] = path[at:], []
                    for x in part:
                        low[x] = -1
                    if len(part) > 1 or node in deps[node]:
                        out += part
    return sorted(out)


def _positions(rows: DataFrame, fold) -> DataFrame:
    found = per_document(rows, "doc_id", ("pos", "deps", "selected", "satisfied"), fold, "found", pa.list_(pa.int64()), "array<long>")
    return found.select("doc_id", F.explode("found").alias("pos"))


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(graph(spark, sf_dir), closure_of)


@query(graph_sql(CLOSURE_SQL + " SELECT doc_id, pos FROM closure", True))
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots and all that they depend on, to any depth; unknown dependencies are left to the checks.

    A document's obligations are one array, so the closure is one exchange and a walk, whatever its depth.
    """
    return closure(spark, sf_dir)


@query(graph_sql(", reach AS (SELECT doc_id, pos, dep FROM dk UNION SELECT r.doc_id, r.pos, e.dep FROM reach r JOIN dk e ON e.doc_id = r.doc_id AND e.pos = r.dep) SELECT doc_id, pos FROM reach WHERE pos = dep", True))
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations that depend on themselves through any number of others, in every document."""
    return _positions(graph(spark, sf_dir), on_cycles)


@query(graph_sql(CLOSURE_SQL + " SELECT doc_id, count(DISTINCT kind)::BIGINT AS kinds, count(DISTINCT method)::BIGINT AS methods, string_agg(DISTINCT method, ',' ORDER BY method) AS names FROM closure JOIN dg USING (doc_id, pos) JOIN km USING (kind) GROUP BY doc_id", True))
def closure_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct kinds and methods of the closure."""
    g = closure(spark, sf_dir).join(graph(spark, sf_dir).select("doc_id", "pos", "kind", "methods"), ["doc_id", "pos"])
    g = g.groupBy("doc_id").agg(F.size(F.collect_set("kind")).cast("long").alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("methods")))).alias("m"))
    return g.select("doc_id", "kinds", F.size("m").cast("long").alias("methods"), F.array_join("m", ",").alias("names"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dependency with the states of both ends; an unknown one has no state."""
    g = graph(spark, sf_dir)
    e = g.select("doc_id", "pos", "satisfied", "selected", F.explode("deps").alias("dep"))
    return e.join(g.select("doc_id", F.col("pos").alias("dep"), F.col("satisfied").alias("dep_satisfied")), ["doc_id", "dep"], "left")


@query(graph_sql(" SELECT a.doc_id, a.pos, e.dep FROM dg a JOIN dk e USING (doc_id, pos) JOIN dg b ON b.doc_id = e.doc_id AND b.pos = e.dep WHERE a.satisfied AND NOT b.satisfied"))
def unsatisfied_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satisfied obligations that depend on open ones."""
    return edges(spark, sf_dir).where("satisfied AND NOT dep_satisfied").select("doc_id", "pos", "dep")


@query(
    graph_sql(""", u AS (SELECT e.doc_id, e.pos, count(*) FILTER (b.pos IS NULL OR NOT b.satisfied) AS open FROM de e LEFT JOIN dg b ON b.doc_id = e.doc_id AND b.pos = e.dep GROUP BY ALL)
    SELECT doc_id, count(*) FILTER (selected AND NOT satisfied AND coalesce(open, 0) = 0)::BIGINT AS ready, bool_and(NOT selected OR satisfied) AS all_selected_satisfied, bool_and(NOT satisfied OR coalesce(open, 0) = 0) AS causally_consistent FROM dg LEFT JOIN u USING (doc_id, pos) GROUP BY doc_id""")
)
def planning_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is ready, whether all that is selected is done, and whether what is done had its predecessors done."""
    open_ = edges(spark, sf_dir).groupBy("doc_id", "pos").agg(F.count_if(~F.coalesce("dep_satisfied", F.lit(False))).alias("open"))
    g = graph(spark, sf_dir).join(open_, ["doc_id", "pos"], "left").withColumn("free", F.coalesce("open", F.lit(0)) == 0)
    return g.groupBy("doc_id").agg(F.count_if(F.col("selected") & ~F.col("satisfied") & F.col("free")).alias("ready"), F.bool_and(~F.col("selected") | F.col("satisfied")).alias("all_selected_satisfied"), F.bool_and(~F.col("satisfied") | F.col("free")).alias("causally_consistent"))


def best_method() -> Column:
    """O2: of the methods that are there and untried the cheapest, of equals the one that sorts first."""
    left = F.array_except("methods", F.array_union("away", "tried"))
    return F.array_min(F.transform(left, lambda m: F.struct(_cost(m).alias("cost"), m.alias("method"))))


def plan(rows: list[dict]) -> list[dict]:
    """Steps in which the ready obligation that sorts first is always next, or one row with the reason for none."""
    none = lambda why: [{"step": 0, "action": why, "pos": None, "method": None, "cost": 0}]
    wanted = set(closure_of(rows))
    by = {r["pos"]: r for r in rows if r["pos"] in wanted}
    if any(r["satisfied"] and not all(d in by and by[d]["satisfied"] for d in r["deps"]) for r in by.values()):
        return none("inconsistent")
    if any(not r["satisfied"] and r["best"] is None for r in by.values()):
        return none("no-method")
    waits = {p: {d for d in r["deps"] if not (d in by and by[d]["satisfied"])} for p, r in by.items() if not r["satisfied"]}
    after: dict[int, list[int]] = {}
    for p, ds in waits.items():
        for d in ds:
            after.setdefault(d, []).append(p)
    ready = [p for p, ds in waits.items() if not ds]
    heapq.heapify(ready)
    out = [{"action": "start-job", "pos": None, "method": None, "cost": 0}] if rows[0]["lifecycle"] == "queued" else []
    done = 0
    while ready:
        p = heapq.heappop(ready)
        done += 1
        out.append({"action": "execute-obligation", "pos": p, "method": by[p]["best"]["method"], "cost": by[p]["best"]["cost"]})
        for q in after.get(p, ()):
            waits[q].discard(p)
            if not waits[q]:
                heapq.heappush(ready, q)
    if done < len(waits):
        return none("no-order")
    return [{"step": i, **s} for i, s in enumerate([*out, {"action": "complete-job", "pos": None, "method": None, "cost": 0}])]


STEP = pa.struct([("step", pa.int64()), ("action", pa.string()), ("pos", pa.int64()), ("method", pa.string()), ("cost", pa.int64())])
STEPS = "array<struct<step:long,action:string,pos:long,method:string,cost:long>>"


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph(spark, sf_dir).withColumn("best", best_method())
    found = per_document(rows, "doc_id", ("pos", "deps", "selected", "satisfied", "lifecycle", "best"), plan, "steps", pa.list_(STEP), STEPS)
    return found.select("doc_id", F.explode("steps").alias("s")).select("doc_id", "s.*")


@query()
def nominal_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of all documents; the choice of methods is an expression, only the order is a fold."""
    return plans(spark, sf_dir)


def external_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of another planner, with faults of every sort. idx is the step's place."""
    pk, d = F.col("pk"), F.col("doc_id")
    g = graph(spark, sf_dir).where((~F.col("satisfied")) | (pk % 13 == 0))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(pk * 7 % 11, "pos"))
    method = F.when(pk % 17 == 0, "no-method").when(pk % 5 == 0, "human-review").otherwise(F.col("methods")[0])
    steps = g.select("doc_id", n.cast("long").alias("idx"), F.lit("execute-obligation").alias("action"), "pos", F.when(pk % 19 == 0, "other").otherwise(F.col("kind")).alias("step_kind"), method.alias("method"), (_cost(method) + F.when(pk % 23 == 0, 1).otherwise(0)).alias("cost"))
    docs = g.groupBy("doc_id").agg(F.count("*").alias("n"))
    job = lambda action, idx: F.struct(idx.cast("long").alias("idx"), F.lit(action).alias("action"))
    ends = docs.select("doc_id", F.explode(F.array_compact(F.array(F.when(d % 11 > 0, job("start-job", F.lit(0))), F.when(d % 7 > 0, job("complete-job", F.when(d % 9 == 0, F.lit(1)).otherwise(F.col("n") + 1)))))).alias("s")).select("doc_id", "s.*")
    # Every ninth document completes beside its first step, before the rest.
    return steps.unionByName(ends, allowMissingColumns=True)


EXTERNAL_SQL = """, xs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pk * 7 % 11, pos)::BIGINT AS idx, 'execute-obligation' AS action, pos, CASE WHEN pk % 19 = 0 THEN 'other' ELSE kind END AS step_kind,
  CASE WHEN pk % 17 = 0 THEN 'no-method' WHEN pk % 5 = 0 THEN 'human-review' ELSE (SELECT method FROM km WHERE km.kind = dg.kind AND ord = 0) END AS method, pk FROM dg WHERE NOT satisfied OR pk % 13 = 0),
 xc AS (SELECT xs.* EXCLUDE (pk), coalesce((SELECT max(cost) FROM km WHERE km.method = xs.method), 50) + CASE WHEN pk % 23 = 0 THEN 1 ELSE 0 END AS cost FROM xs),
 xd AS (SELECT doc_id, count(*) AS n FROM xs GROUP BY doc_id),
 xp AS (SELECT * FROM xc UNION ALL BY NAME SELECT doc_id, 0 AS idx, 'start-job' AS action FROM xd WHERE doc_id % 11 > 0 UNION ALL BY NAME SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 1 ELSE n + 1 END AS idx, 'complete-job' AS action FROM xd WHERE doc_id % 7 > 0)"""


@query(
    graph_sql(EXTERNAL_SQL + """, begun AS (SELECT doc_id, min(idx) FILTER (action = 'start-job') AS s, min(idx) FILTER (action = 'complete-job') AS c, max(idx) AS last FROM xp GROUP BY doc_id),
    x AS (SELECT xp.*, g.kind, g.satisfied, g.lifecycle, s, c, last FROM xp LEFT JOIN dg g USING (doc_id, pos) JOIN begun USING (doc_id)),
    late AS (SELECT DISTINCT x.doc_id, x.pos FROM x JOIN de e USING (doc_id, pos) LEFT JOIN dg b ON b.doc_id = e.doc_id AND b.pos = e.dep LEFT JOIN xp y ON y.doc_id = e.doc_id AND y.pos = e.dep WHERE NOT coalesce(b.satisfied, false) AND NOT coalesce(y.idx < x.idx, false)),
    bad AS (SELECT doc_id, idx, pos, unnest(list_filter([CASE WHEN satisfied THEN 'already' END, CASE WHEN (doc_id, pos) IN (SELECT (doc_id, pos) FROM late) THEN 'dependency' END, CASE WHEN step_kind <> kind THEN 'kind' END,
      CASE WHEN method NOT IN (SELECT method FROM km WHERE km.kind = x.kind) THEN 'inadmissible' END, CASE WHEN (doc_id, method) IN (SELECT (doc_id, method) FROM aw) THEN 'unavailable' END, CASE WHEN (doc_id, pos, method) IN (SELECT (doc_id, pos, method) FROM tr) THEN 'tried' END,
      CASE WHEN cost <> coalesce((SELECT max(cost) FROM km WHERE km.method = x.method), 50) THEN 'cost' END, CASE WHEN lifecycle = 'queued' AND s IS NULL THEN 'not-processing' END, CASE WHEN idx > c THEN 'after-complete' END], lambda z: z IS NOT NULL)) AS rule FROM x WHERE action = 'execute-obligation')
    SELECT * FROM bad UNION ALL SELECT doc_id, 0, NULL, 'start-state' FROM begun WHERE s IS NOT NULL AND doc_id % 2 = 1 UNION ALL SELECT doc_id, last, NULL, 'no-complete' FROM begun WHERE c IS NULL
    UNION ALL SELECT doc_id, c, NULL, 'incomplete' FROM begun WHERE c IS NOT NULL AND EXISTS (SELECT 1 FROM dg LEFT JOIN xp y USING (doc_id, pos) WHERE dg.doc_id = begun.doc_id AND dg.selected AND NOT dg.satisfied AND NOT coalesce(y.idx < begun.c, false))""")
)
def plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of every step, not only the first.

    The dependency rule joins each dependency with the step that runs it; the others need the step and its obligation only.
    """
    g, x = graph(spark, sf_dir), external_plans(spark, sf_dir)
    doc = Window.partitionBy("doc_id")
    at = lambda action: F.min(F.when(F.col("action") == action, F.col("idx"))).over(doc)
    x = x.withColumns({"s": at("start-job"), "c": at("complete-job"), "last": F.max("idx").over(doc)})
    runs = x.where("pos IS NOT NULL").select("doc_id", "pos", F.col("idx").alias("run"))
    waits = edges(spark, sf_dir).where("NOT coalesce(dep_satisfied, false)").select("doc_id", "pos", "dep")
    waits = waits.join(runs.select("doc_id", F.col("pos").alias("dep"), F.col("run").alias("dep_run")), ["doc_id", "dep"], "left").join(runs, ["doc_id", "pos"])
    late = waits.where("NOT coalesce(dep_run < run, false)").select("doc_id", "pos").distinct().withColumn("late", F.lit(True))
    one = x.join(g.select("doc_id", "pos", "kind", "methods", "tried", "away", "satisfied", "selected", "lifecycle"), ["doc_id", "pos"], "left").join(late, ["doc_id", "pos"], "left")
    run = F.col("action") == "execute-obligation"
    rules = {
        "already": F.col("satisfied"), "dependency": F.col("late"), "kind": F.col("step_kind") != F.col("kind"), "inadmissible": ~F.array_contains("methods", F.col("method")), "unavailable": F.array_contains("away", F.col("method")),
        "tried": F.array_contains("tried", F.col("method")), "cost": F.col("cost") != _cost(F.col("method")), "not-processing": (F.col("lifecycle") == "queued") & F.col("s").isNull(), "after-complete": F.col("idx") > F.col("c"),
    }
    bad = one.where(run).select("doc_id", "idx", "pos", F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))).alias("rule"))
    open_ = g.where("selected AND NOT satisfied").join(runs, ["doc_id", "pos"], "left").groupBy("doc_id").agg(F.max(F.coalesce("run", F.lit(1 << 40))).alias("done"))
    docs = x.groupBy("doc_id").agg(F.first("s").alias("s"), F.first("c").alias("c"), F.first("last").alias("last")).join(open_, "doc_id", "left")
    rule = lambda test, idx, name: F.when(test, F.struct(idx.cast("long").alias("idx"), F.lit(name).alias("rule")))
    whole = F.array_compact(F.array(rule(F.col("s").isNotNull() & (F.col("doc_id") % 2 == 1), F.lit(0), "start-state"), rule(F.col("c").isNull(), F.col("last"), "no-complete"), rule(F.col("done") >= F.col("c"), F.col("c"), "incomplete")))
    return bad.unionByName(docs.select("doc_id", F.explode(whole).alias("r")).select("doc_id", "r.idx", F.lit(None).cast("long").alias("pos"), "r.rule"))


def two_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An internal and an external plan of each document: other orders, other methods, a step or a plan that is missing."""
    d = F.col("doc_id")
    g = graph(spark, sf_dir).withColumn("best", best_method()).where("best IS NOT NULL")
    by_name = F.array_min(F.array_except("methods", F.array_union("away", "tried")))
    m2 = F.when(d % 5 == 0, by_name).otherwise(F.col("best.method"))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    left = g.select("doc_id", F.lit("left").alias("side"), F.col("pos").alias("ord"), "pos", "kind", F.col("best.method").alias("method"), F.col("best.cost").alias("cost"))
    right = g.withColumn("n", n).where((d % 13 > 0) & ~((d % 17 == 0) & (F.col("pos") == 1))).select("doc_id", F.lit("right").alias("side"), F.when(d % 3 == 0, -F.col("pos")).otherwise(F.col("pos")).alias("ord"), "pos", "kind", m2.alias("method"), _cost(m2).alias("cost"))
    return left.unionByName(right)


_TWO_SQL = """, cand AS (SELECT doc_id, pos, kind, method, cost FROM dg JOIN km USING (kind) WHERE (doc_id, method) NOT IN (SELECT (doc_id, method) FROM aw) AND (doc_id, pos, method) NOT IN (SELECT (doc_id, pos, method) FROM tr)),
 p1 AS (SELECT doc_id, pos, kind, arg_min(method, (cost, method)) AS method, min(cost) AS cost, min(method) AS by_name FROM cand GROUP BY ALL),
 p2 AS (SELECT doc_id, pos, kind, CASE WHEN doc_id % 5 = 0 THEN by_name ELSE method END AS method FROM p1 WHERE doc_id % 13 > 0 AND NOT (doc_id % 17 = 0 AND pos = 1)),
 st AS (SELECT doc_id, 'left' AS side, pos AS ord, pos, kind, method, cost FROM p1 UNION ALL SELECT doc_id, 'right', CASE WHEN doc_id % 3 = 0 THEN -pos ELSE pos END, pos, kind, method, (SELECT max(cost) FROM km WHERE km.method = p2.method) FROM p2),
 sg AS (SELECT *, 'execute-obligation(' || pos || ',' || kind || ',' || method || ')@' || cost AS sig FROM st)"""


@query(
    graph_sql(_TWO_SQL + """, a AS (SELECT doc_id, list(sig ORDER BY ord) AS seq, list(sig ORDER BY sig) AS bag, list(pos ORDER BY pos) AS pos, list(pos || method ORDER BY pos) AS how, sum(cost) AS cost FROM sg WHERE side = 'left' GROUP BY doc_id),
    b AS (SELECT doc_id, list(sig ORDER BY ord) AS seq, list(sig ORDER BY sig) AS bag, list(pos ORDER BY pos) AS pos, list(pos || method ORDER BY pos) AS how, sum(cost) AS cost FROM sg WHERE side = 'right' GROUP BY doc_id),
    df AS (SELECT doc_id, sig, count(*) FILTER (side = 'left') - count(*) FILTER (side = 'right') AS n FROM sg GROUP BY ALL), ds AS (SELECT doc_id, string_agg(sig, ' ' ORDER BY sig) FILTER (n > 0) AS l, string_agg(sig, ' ' ORDER BY sig) FILTER (n < 0) AS r FROM df GROUP BY doc_id)
    SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'inconclusive' WHEN a.bag = b.bag AND a.seq = b.seq THEN 'identical' WHEN a.bag = b.bag THEN 'equivalent' ELSE 'different' END AS verdict, (b.cost - a.cost)::BIGINT AS cost_delta, a.pos = b.pos AS same_executed, a.how = b.how AS same_methods, a.seq = b.seq AS same_sequence,
      CASE WHEN b.doc_id IS NOT NULL THEN coalesce(l, '') END AS only_left, CASE WHEN b.doc_id IS NOT NULL THEN coalesce(r, '') END AS only_right FROM a LEFT JOIN b USING (doc_id) JOIN ds ON ds.doc_id = a.doc_id""")
)
def plan_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical, equivalent (another order), different, or inconclusive where a side has no plan.

    Signatures are the five fields of a step. One aggregation holds both plans of a document; the multiset difference of
    two sorted lists counts each signature.
    """
    sig = F.concat(F.lit("execute-obligation("), F.concat_ws(",", F.col("pos").cast("string"), "kind", "method"), F.lit(")@"), F.col("cost").cast("string"))
    s = two_plans(spark, sf_dir).withColumn("sig", sig)
    of = lambda side, *cols: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct(*cols))))
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("cost")))
    g = s.groupBy("doc_id").agg(*[x for k in ("left", "right") for x in (of(k, "ord", "sig").alias(f"{k}_seq"), of(k, "pos", "method").alias(f"{k}_how"), total(k).alias(f"{k}_cost"))])
    g = g.where("size(left_seq) > 0")
    seq = lambda k: F.transform(f"{k}_seq", lambda x: x["sig"])
    pos = lambda k: F.transform(f"{k}_how", lambda x: x["pos"])
    g = g.withColumns({"l": F.array_sort(seq("left")), "r": F.array_sort(seq("right")), "same_sequence": seq("left") == seq("right"), "solved": F.size("right_seq") > 0})
    g = g.withColumns({"bag": F.col("l") == F.col("r"), "same_executed": pos("left") == pos("right"), "same_methods": F.col("left_how") == F.col("right_how")})
    # Each obligation is executed once, so a signature stands once in a plan and the difference of the sets is that of the multisets.
    only = lambda a, b: F.when(F.col("solved"), F.array_join(F.array_sort(F.array_except(a, b)), " "))
    verdict = F.when(~F.col("solved"), "inconclusive").when(F.col("bag") & F.col("same_sequence"), "identical").when(F.col("bag"), "equivalent").otherwise("different")
    known = lambda c: F.when(F.col("solved"), F.col(c)).alias(c)
    return g.select("doc_id", verdict.alias("verdict"), (F.col("right_cost") - F.col("left_cost")).alias("cost_delta"), known("same_executed"), known("same_methods"), known("same_sequence"), only("l", "r").alias("only_left"), only("r", "l").alias("only_right"))


FACTS_SQL = CLOSURE_SQL + """, sel AS (SELECT dg.* FROM closure JOIN dg USING (doc_id, pos)), fx AS (
  SELECT doc_id, pos, 0 AS a, '' AS b, unnest(['(selected o' || pos || ')', '(kind-of o' || pos || ' ' || kind || ')', CASE WHEN satisfied THEN '(satisfied o' || pos || ')' ELSE '(pending o' || pos || ')' END]) AS fact, unnest([1, 2, 3]) AS c FROM sel
  UNION ALL SELECT doc_id, pos, 1, lpad(dep::VARCHAR, 9, '0'), '(depends-on o' || pos || ' o' || dep || ')', 0 FROM sel JOIN dk USING (doc_id, pos)
  UNION ALL SELECT doc_id, pos, 2, method, f.fact, f.c FROM (SELECT sel.*, method, cost FROM sel JOIN km USING (kind)) s, LATERAL (SELECT unnest([CASE WHEN (doc_id, method) NOT IN (SELECT (doc_id, method) FROM aw) THEN '(available ' || method || ')' END, '(supports ' || method || ' ' || kind || ')', '(admissible ' || method || ' o' || pos || ')',
    '(= (execution-cost ' || method || ' o' || pos || ') ' || cost || ')', CASE WHEN (doc_id, pos, method) IN (SELECT (doc_id, pos, method) FROM tr) THEN '(tried o' || pos || ' ' || method || ')' END]) AS fact, unnest([1, 2, 3, 4, 5]) AS c) f WHERE f.fact IS NOT NULL),
 f1 AS (SELECT doc_id, fact, min((pos, a, b, c)) AS place FROM fx GROUP BY ALL)"""


@query(graph_sql(FACTS_SQL + " SELECT doc_id, string_agg(fact, chr(10) ORDER BY place) AS init, count(*)::BIGINT AS facts FROM f1 GROUP BY doc_id", True))
def compiled_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the closure's obligations in their order, each kept at its first place, as one text a document."""
    g = closure(spark, sf_dir).join(graph(spark, sf_dir), ["doc_id", "pos"])
    name = lambda p: F.concat(F.lit("o"), p.cast("string"))
    say = lambda *parts: F.concat(F.lit("("), F.concat_ws(" ", *parts), F.lit(")"))
    o = name(F.col("pos"))
    state = F.when(F.col("satisfied"), "satisfied").otherwise("pending")
    head = F.array(say(F.lit("selected"), o), say(F.lit("kind-of"), o, "kind"), say(state, o))
    known = F.array_intersect(F.sort_array("deps"), "every")
    waits = F.transform(known, lambda d: say(F.lit("depends-on"), o, name(d)))
    by_method = F.transform(F.sort_array("methods"), lambda m: F.array_compact(F.array(
        F.when(~F.array_contains("away", m), say(F.lit("available"), m)), say(F.lit("supports"), m, "kind"), say(F.lit("admissible"), m, o),
        say(F.lit("="), say(F.lit("execution-cost"), m, o), _cost(m).cast("string")), F.when(F.array_contains("tried", m), say(F.lit("tried"), o, m)),
    )))
    size = graph(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("pos").alias("every"))
    rows = g.join(size, "doc_id").select("doc_id", "pos", F.concat(head, waits, F.flatten(by_method)).alias("f"))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "f"))).alias("p"))
    facts = F.array_distinct(F.flatten(F.transform("p", lambda x: x["f"])))  # the first of equal facts stays
    return rows.select("doc_id", F.array_join(facts, "\n").alias("init"), F.size(facts).cast("long").alias("facts"))


def execute(rows: list[dict], steps: list[dict], fails: set[str] | frozenset[str] = frozenset(), dry: bool = False) -> dict:
    """Replay a plan's steps in their order on the obligations' states.

    The first step that breaks a precondition, or whose method fails, ends the run. A failed method is recorded as an
    attempt; if the obligation has methods left a new plan is due. A dry run changes nothing that is kept.
    """
    by = {r["pos"]: {**r, "tried": set(r["tried"])} for r in rows}
    running = rows[0]["lifecycle"] == "processing"
    done: list[int] = []
    artifacts: list[str] = []
    for s in steps:
        why, replan = None, False
        if s["action"] == "start-job":
            why, running = ("start-state" if running else None), True
        elif s["action"] == "complete-job":
            why = "incomplete" if any(r["wanted"] and not r["satisfied"] for r in by.values()) else None
        else:
            r = by.get(s["pos"])
            tests = (("unknown", r is None), ("not-processing", not running), ("unselected", r and not r["wanted"]), ("already", r and r["satisfied"]), ("inadmissible", r and s["method"] not in r["methods"]), ("tried", r and s["method"] in r["tried"]), ("dependency", r and not all(d in by and by[d]["satisfied"] for d in r["deps"])))
            why = next((name for name, broken in tests if broken), None)
            if why is None and not dry and s["method"] in fails:
                r["tried"].add(s["method"])
                why, replan = "failed", bool(set(r["methods"]) - r["tried"])
            elif why is None:
                r["satisfied"] = True
                done.append(s["pos"])
                if f"artifact-{s['method']}" not in artifacts:  # artifacts are appended once an id
                    artifacts.append(f"artifact-{s['method']}")
        if why:
            return {"status": "dry-run-completed" if dry else "replan-required" if replan else "failed", "failed_step": s["step"], "reason": why, "succeeded": len(done), "artifacts": len(artifacts)}
    return {"status": "dry-run-completed" if dry else "completed", "failed_step": None, "reason": None, "succeeded": len(done), "artifacts": len(artifacts)}


REPORT = pa.struct([("status", pa.string()), ("failed_step", pa.int64()), ("reason", pa.string()), ("succeeded", pa.int64()), ("artifacts", pa.int64())])
#: Handlers that fail when a plan is executed live.
FAILING = frozenset({"docling-retry", "pandoc-code"})


def run_document(rows: list[dict]) -> list[dict]:
    wanted = set(closure_of(rows))
    rows = [{**r, "wanted": r["pos"] in wanted} for r in rows]
    steps = plan(rows)
    return [] if steps[0]["action"] in ("inconsistent", "no-method", "no-order") else [execute(rows, steps, FAILING)]


@query()
def plan_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plan replayed in plan order with handlers of which some fail; a report a document."""
    rows = graph(spark, sf_dir).withColumn("best", best_method())
    found = per_document(rows, "doc_id", ("pos", "deps", "selected", "satisfied", "lifecycle", "best", "methods", "tried"), run_document, "report", pa.list_(REPORT), "array<struct<status:string,failed_step:long,reason:string,succeeded:long,artifacts:long>>")
    return found.select("doc_id", F.explode("report").alias("r")).select("doc_id", "r.*")


# What every problem text must hold.
REQUIRED = ("(:domain accessible)", "(:goal (completed))", "(:metric minimize (total-cost))", "(= (total-cost) 0)")


@query(
    graph_sql(FACTS_SQL + """, tx AS (SELECT doc_id, list(fact ORDER BY place) AS f FROM f1 GROUP BY doc_id), pt AS (SELECT doc_id, '(define (problem p' || doc_id || ')' || chr(10) || '; (not (counted' || chr(10) || '(:domain accessible)' || chr(10) || '(:init' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '(queued)' ELSE '(processing)' END || CASE WHEN doc_id % 10 = 3 THEN '(queued)' ELSE '' END
      || chr(10) || '(= (total-cost) 0)' || chr(10) || array_to_string(list_filter(f, lambda x: NOT (doc_id % 10 = 4 AND x LIKE '(selected%')), chr(10)) || CASE WHEN doc_id % 10 = 1 THEN '' WHEN doc_id % 10 = 5 THEN '))))(((' ELSE ')' END || chr(10) || '(:goal (completed))' || chr(10) || CASE WHEN doc_id % 10 = 2 THEN '' ELSE '(:metric minimize (total-cost))' END || ')' AS t, list_filter(f, lambda x: x LIKE '(selected%') AS sel FROM tx),
    ck AS (SELECT *, list_transform(list_transform(string_split(t, chr(10)), lambda x: string_split(x, ';')[1]), lambda x: (length(x) - length(replace(x, '(', ''))) - (length(x) - length(replace(x, ')', '')))) AS net FROM pt)
    SELECT doc_id, list_reduce(net, lambda a, x: CASE WHEN a < 0 THEN a ELSE a + x END)::BIGINT AS balance, len(list_filter(['(:domain accessible)', '(:goal (completed))', '(:metric minimize (total-cost))', '(= (total-cost) 0)'], lambda x: NOT contains(t, x)))::BIGINT AS missing, len(list_filter(sel, lambda x: NOT contains(t, x)))::BIGINT AS unselected, contains(t, '(queued)') AND contains(t, '(processing)') AS two_states FROM ck""", True)
)
def problem_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance of parentheses line by line, comments apart, which stops where it turns negative; fragments that
    must be there; every selected obligation; not both states. A tenth of the texts has each fault."""
    d = F.col("doc_id")
    facts = F.split("init", "\n")
    chosen = F.filter(facts, lambda x: x.startswith("(selected"))
    kept = F.when(d % 10 == 4, F.filter(facts, lambda x: ~x.startswith("(selected"))).otherwise(facts)
    state = F.concat(F.when(d % 2 == 0, "(queued)").otherwise("(processing)"), F.when(d % 10 == 3, "(queued)").otherwise(""))
    end = F.when(d % 10 == 1, "").when(d % 10 == 5, "))))(((").otherwise(")")
    text = F.concat_ws("\n", F.concat(F.lit("(define (problem p"), d.cast("string"), F.lit(")")), F.lit("; (not (counted"), F.lit(REQUIRED[0]), F.lit("(:init"), state, F.lit(REQUIRED[3]), F.concat(F.array_join(kept, "\n"), end), F.lit(REQUIRED[1]), F.concat(F.when(d % 10 == 2, "").otherwise(REQUIRED[2]), F.lit(")")))
    p = compiled_problems(spark, sf_dir).select("doc_id", text.alias("t"), chosen.alias("sel"))
    times = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    net = F.transform(F.split("t", "\n"), lambda x: times(F.substring_index(x, ";", 1), "(") - times(F.substring_index(x, ";", 1), ")"))
    balance = F.aggregate(net, F.lit(0), lambda a, x: F.when(a < 0, a).otherwise(a + x))
    absent = lambda xs: F.size(F.filter(xs, lambda x: ~F.col("t").contains(x))).cast("long")
    return p.select("doc_id", balance.cast("long").alias("balance"), absent(_list(REQUIRED)).alias("missing"), absent(F.col("sel")).alias("unselected"), (F.col("t").contains("(queued)") & F.col("t").contains("(processing)")).alias("two_states"))
