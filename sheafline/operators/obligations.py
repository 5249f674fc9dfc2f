"""Methods of obligations, symbols and the binding of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import lines, methods, with_cte

@query(with_cte("me", "SELECT doc_id, pos, method, cost FROM me WHERE available AND NOT tried"))
def candidate_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available methods that weren't tried."""
    return methods(spark, sf_dir).where("available AND NOT tried").select("doc_id", "pos", "method", "cost")


@query(with_cte("me", "SELECT doc_id, pos, arg_min(method, (cost, method)) AS method, min(cost)::BIGINT AS cost FROM me WHERE available AND NOT tried GROUP BY doc_id, pos"))
def cheapest_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, A4: the least cost, then the method that sorts first."""
    m = candidate_methods(spark, sf_dir).groupBy("doc_id", "pos").agg(F.min(F.struct("cost", "method")).alias("m"))
    return m.select("doc_id", "pos", "m.method", "m.cost")


@query(with_cte("me", "SELECT doc_id, sum(cost)::BIGINT AS total_cost, count(*)::BIGINT AS steps FROM (SELECT doc_id, pos, min(cost) AS cost FROM me WHERE available AND NOT tried GROUP BY doc_id, pos) GROUP BY doc_id"))
def plan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: costs are separable, so the cheapest plan is the sum of the cheapest methods."""
    return cheapest_method(spark, sf_dir).groupBy("doc_id").agg(F.sum("cost").alias("total_cost"), F.count("*").alias("steps"))


@query(with_cte("me", "SELECT doc_id, pos, string_agg(method, ',' ORDER BY cost, method) AS methods FROM me WHERE available AND NOT tried AND method <> 'm2' GROUP BY doc_id, pos"))
def replan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after one failed attempt with m2."""
    c = candidate_methods(spark, sf_dir).where("method <> 'm2'").groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("cost", "method"))).alias("c"))
    return c.select("doc_id", "pos", F.array_join(F.transform("c", lambda x: x["method"]), ",").alias("methods"))


@query(with_cte("me", "SELECT doc_id, pos, string_agg(method, ',' ORDER BY method) AS bad FROM (SELECT doc_id, pos, CASE WHEN cost % 13 = 0 THEN 'x-' || method ELSE method END AS method FROM me) WHERE method LIKE 'x-%' GROUP BY doc_id, pos"))
def cost_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost keys that are no admissible method (injected where the cost is a multiple of 13)."""
    m = methods(spark, sf_dir).withColumn("key", F.when(F.col("cost") % 13 == 0, F.concat(F.lit("x-"), "method")).otherwise(F.col("method")))
    keys = m.groupBy("doc_id", "pos").agg(F.collect_set("key").alias("k")).withColumn("bad", F.array_sort(F.array_except("k", F.array(F.lit("m1"), F.lit("m2"), F.lit("m3")))))
    return keys.where("size(bad) > 0").select("doc_id", "pos", F.array_join("bad", ",").alias("bad"))


def symbol(value):
    """K7: lower case, letters, digits and single hyphens, a letter first."""
    s = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s.rlike("^[a-z]"), s).otherwise(F.concat(F.lit("x-"), F.coalesce(F.nullif(s, F.lit("")), F.lit("item"))))


_NAME_SQL = "CASE pk % 6 WHEN 0 THEN 'Part ' || pk % 4 WHEN 1 THEN 'part_' || pk % 4 WHEN 2 THEN 'PART--' || pk % 4 WHEN 3 THEN '9 lives ' || pk % 3 WHEN 4 THEN '__' ELSE 'ok' END"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = F.col("pk")
    with_rest = lambda text, k: F.concat(F.lit(text), (pk % k).cast("string"))
    name = F.when(pk % 6 == 0, with_rest("Part ", 4)).when(pk % 6 == 1, with_rest("part_", 4)).when(pk % 6 == 2, with_rest("PART--", 4)).when(pk % 6 == 3, with_rest("9 lives ", 3)).when(pk % 6 == 4, "__").otherwise("ok")
    return lines(spark, sf_dir).select("doc_id", name.alias("value")).distinct()


@query(
    with_cte("li", f""", v AS (SELECT DISTINCT doc_id, {_NAME_SQL} AS value FROM li), n AS (SELECT *, trim(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM v), y AS (SELECT doc_id, value, CASE WHEN regexp_matches(s, '^[a-z]') THEN s ELSE 'x-' || coalesce(nullif(s, ''), 'item') END AS sym FROM n)
    SELECT doc_id, value, CASE WHEN row_number() OVER (PARTITION BY doc_id, sym ORDER BY value) > 1 THEN sym || '-' || left(sha256(value), 8) ELSE sym END AS symbol FROM y""").replace("FROM lineitem) , v", "FROM lineitem), v")
)
def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: symbols of each document's names; of names with one symbol the first keeps it, others get eight digits of their hash."""
    n = F.row_number().over(Window.partitionBy("doc_id", "sym").orderBy("value"))
    rows = names(spark, sf_dir).withColumn("sym", symbol(F.col("value"))).withColumn("n", n)
    return rows.select("doc_id", "value", F.when(F.col("n") > 1, F.concat_ws("-", "sym", F.substring(F.sha2("value", 256), 1, 8))).otherwise(F.col("sym")).alias("symbol"))


@query(
    with_cte("li", f""", v AS (SELECT DISTINCT doc_id, {_NAME_SQL} AS value FROM li), n AS (SELECT *, trim(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM v), y AS (SELECT doc_id, value, CASE WHEN regexp_matches(s, '^[a-z]') THEN s ELSE 'x-' || coalesce(nullif(s, ''), 'item') END AS sym FROM n),
    t AS (SELECT doc_id, value, CASE WHEN row_number() OVER (PARTITION BY doc_id, sym ORDER BY value) > 1 THEN sym || '-' || left(sha256(value), 8) ELSE sym END AS symbol FROM y), used(symbol) AS (VALUES ('ok'), ('x-item'), ('part-1'), ('part-2'), ('nothing'))
    SELECT doc_id, symbol, value FROM (SELECT DISTINCT doc_id FROM li) CROSS JOIN used LEFT JOIN t USING (doc_id, symbol)""").replace("FROM lineitem) , v", "FROM lineitem), v")
)
def symbols_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names behind the symbols that a plan uses; a symbol without a name is unknown."""
    used = F.explode(F.array(*[F.lit(x) for x in ("ok", "x-item", "part-1", "part-2", "nothing")]))
    steps = lines(spark, sf_dir).select("doc_id").distinct().select("doc_id", used.alias("symbol"))
    return steps.join(symbol_table(spark, sf_dir), ["doc_id", "symbol"], "left").select("doc_id", "symbol", "value")


_BIND_SQL = """, head AS (SELECT doc_id, 'manifest-' || doc_id AS manifest, 1 + doc_id % 3 AS revision, sha256('manifest:' || doc_id || ':' || count(*)) AS sha, count(*) AS n FROM li GROUP BY doc_id),
 plan AS (SELECT doc_id, CASE WHEN doc_id % 11 = 1 THEN 'other' ELSE 'accessible' END AS domain, CASE WHEN doc_id % 11 = 2 THEN '2.1' ELSE '2.2' END AS version, sha256(CASE WHEN doc_id % 11 = 3 THEN 'edited' ELSE 'domain' END) AS domain_sha, sha256(CASE WHEN doc_id % 11 = 4 THEN 'edited' ELSE 'description' END) AS description_sha,
  CASE WHEN doc_id % 11 = 5 THEN 'manifest-0' ELSE 'manifest-' || doc_id END AS manifest, CASE WHEN doc_id % 11 = 6 THEN 9 ELSE 1 + doc_id % 3 END AS revision, sha256('manifest:' || doc_id || ':' || (n + CASE WHEN doc_id % 11 = 7 THEN 1 ELSE 0 END)) AS sha, n + CASE WHEN doc_id % 11 = 8 THEN 1 ELSE 0 END AS last FROM head)"""


@query(
    with_cte("li", _BIND_SQL + """ SELECT p.doc_id, left(sha256(p.manifest || ':' || p.revision || ':' || p.sha), 16) AS plan_id, array_to_string(list_filter([CASE WHEN p.domain <> 'accessible' THEN 'domain' END, CASE WHEN p.version <> '2.2' THEN 'version' END, CASE WHEN p.domain_sha <> sha256('domain') THEN 'domain-hash' END,
    CASE WHEN p.description_sha <> sha256('description') THEN 'description-hash' END, CASE WHEN p.manifest <> h.manifest THEN 'manifest' END, CASE WHEN p.revision <> h.revision THEN 'revision' END, CASE WHEN p.sha <> h.sha THEN 'manifest-hash' END, CASE WHEN p.last > h.n THEN 'unknown-obligation' END], lambda x: x IS NOT NULL), ',') AS broken
    FROM plan p JOIN head h USING (doc_id)""").replace("FROM lineitem) , head", "FROM lineitem), head")
)
def binding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's domain, version, hashes, manifest, revision and obligations against those that are there."""
    d = F.col("doc_id")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    sha = lambda x: F.sha2(x, 256)
    unless = lambda k, good, bad: F.when(d % 11 == k, bad).otherwise(good)
    head = lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    head = head.withColumns({"manifest": text("manifest-", d), "revision": 1 + d % 3, "sha": sha(text("manifest:", d, ":", F.col("n")))})
    plan = head.select(
        "doc_id", unless(1, F.lit("accessible"), "other").alias("domain"), unless(2, F.lit("2.2"), "2.1").alias("version"), sha(unless(3, F.lit("domain"), "edited")).alias("domain_sha"), sha(unless(4, F.lit("description"), "edited")).alias("description_sha"),
        unless(5, F.col("manifest"), "manifest-0").alias("p_manifest"), unless(6, F.col("revision"), 9).alias("p_revision"), sha(text("manifest:", d, ":", F.col("n") + F.when(d % 11 == 7, 1).otherwise(0))).alias("p_sha"), (F.col("n") + F.when(d % 11 == 8, 1).otherwise(0)).alias("last"),
    )
    j = plan.join(head, "doc_id")
    rules = {
        "domain": F.col("domain") != "accessible", "version": F.col("version") != "2.2", "domain-hash": F.col("domain_sha") != sha(F.lit("domain")), "description-hash": F.col("description_sha") != sha(F.lit("description")),
        "manifest": F.col("p_manifest") != F.col("manifest"), "revision": F.col("p_revision") != F.col("revision"), "manifest-hash": F.col("p_sha") != F.col("sha"), "unknown-obligation": F.col("last") > F.col("n"),
    }
    plan_id = F.substring(sha(F.concat_ws(":", "p_manifest", F.col("p_revision").cast("string"), "p_sha")), 1, 16)
    return j.select("doc_id", plan_id.alias("plan_id"), F.array_join(F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()])), ",").alias("broken"))
