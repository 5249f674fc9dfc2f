"""Mixing sources to target weights, in DataFrame functions only: temperature mixing with budgeted block permutations.

A source's share of all tokens is raised to an exponent between 0 (uniform) and 1 (as found) and normalised. The exponent
is bisected inside one SQL expression over the list of sources: the largest that reaches ``entropy`` of the greatest
possible entropy, but no less than the smallest that keeps every source within ``max_epochs`` repetitions. The weights
become token budgets. A source's rows are dealt into blocks by hash; whole epochs repeat every block, and a last, partial
epoch takes blocks in a hashed permutation until the budget is reached, and rows of the block at the edge that are no longer
than what is left, in a hashed permutation of their own, while they fit. Only sums by source and block are ordered, never
the rows of a source; and as a large source has many blocks, their order is cut in ``STRETCHES`` stretches of the hash: sums
of stretches first, then blocks inside a stretch, so no task orders all blocks of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .line_frequency import word_list

ENTROPY = 0.95
MAX_EPOCHS = 4.0
BLOCK_TOKENS = 100_000
STEPS = 60
STRETCHES = 1 << 12

#: H and the most repetitions at exponent m, over s: array<struct<source, n, p>> (p > 0); both fall as m rises.
_Z = "aggregate(s, 0D, (a, x) -> a + pow(x.p, m))"
_ENTROPY = f"transform(array({_Z}), z -> ln(z) - m / z * aggregate(s, 0D, (a, x) -> a + pow(x.p, m) * ln(x.p)))[0]"
_REPEATS = f"transform(array({_Z}), z -> aggregate(s, 0D, (a, x) -> greatest(a, ratio * pow(x.p, m - 1) / z)))[0]"


def _bisect(holds: str, keep_high: bool) -> str:
    """The edge in [0, 1] of a condition on m; keep_high: it holds above the edge."""
    step = f"transform(array((a.lo + a.hi) / 2), m -> CASE WHEN {holds} THEN %s ELSE %s END)[0]"
    low, high = "named_struct('lo', m, 'hi', a.hi)", "named_struct('lo', a.lo, 'hi', m)"
    step = step % ((high, low) if keep_high else (low, high))
    return f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (a, k) -> {step}, a -> a.{'hi' if keep_high else 'lo'})"


def source_weights(rows: DataFrame, entropy: float, max_epochs: float, budget: float) -> DataFrame:
    """(source, n, weight, budget, alpha) from rows of source and tokens; ``budget`` is a multiple of all tokens.

    The list of sources is one row: it is as long as there are sources, not documents.
    """
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("n")).where("n > 0")
    one = sums.agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s"), F.sum("n").alias("total"))
    one = one.where("total > 0").withColumn("s", F.expr("transform(s, x -> named_struct('source', x.source, 'n', x.n, 'p', x.n / total))")).withColumn("ratio", F.lit(float(budget)))
    at_one = lambda sql: sql.replace("pow(x.p, m - 1)", "1D").replace("pow(x.p, m)", "x.p").replace("m / z", "1 / z")
    one = one.withColumn("flat", F.expr(f"CASE WHEN {at_one(_ENTROPY)} >= {entropy} * ln(size(s)) THEN 1D ELSE {_bisect(f'{_ENTROPY} >= {entropy} * ln(size(s))', False)} END"))
    one = one.withColumn("least", F.expr(f"CASE WHEN {at_one(_REPEATS)} >= {max_epochs} THEN 1D ELSE {_bisect(f'{_REPEATS} <= {max_epochs}', True)} END"))
    one = one.withColumn("alpha", F.greatest("flat", "least")).withColumn("z", F.expr("aggregate(s, 0D, (a, x) -> a + pow(x.p, alpha))"))
    each = one.select("alpha", "total", "ratio", "z", F.explode("s").alias("x"))
    weight = F.expr("pow(x.p, alpha) / z")
    return each.select("x.source", "x.n", weight.alias("weight"), F.round(weight * F.col("ratio") * F.col("total"), 0).cast("long").alias("budget"), "alpha")


def _hash(*parts: str) -> str:
    """A 60-bit hash of string expressions that any SQL engine can state."""
    return f"cast(conv(substr(md5(concat_ws('/', {', '.join(parts)})), 1, 15), 16, 10) AS bigint)"


def mix(spark: SparkSession, documents: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float = 1.0, block_tokens: int = BLOCK_TOKENS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the mixture: doc_id, source, tokens, epoch (from 0), block, block_rank (order of the block in its epoch),
    weight (of the source) and the ``carry`` columns, a row for each time that a document is used.

    Tokens are words (runs of bytes other than 0x20 and 0x09 to 0x0D); null texts have none. A null source is ''. Rows of a
    source without tokens are used once, with weight 0. No source gets more tokens than its budget; repeated rows are rows
    of their own but share a hash, so they are used together where they fit; rows without doc_id are hashed by their text.
    Extra columns are ignored.
    """
    scratch = Scratch(spark, "mixing")
    text = "coalesce(cast(text AS string), '')"
    rows = documents.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.expr(f"cast(size({word_list(text)}) AS bigint)").alias("tokens"),
        F.expr(f"coalesce(cast(doc_id AS string), concat('text/', md5({text})))").alias("key"),  # rows without an id spread by text
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    rows = scratch.put(rows, "rows")
    weights = scratch.put(source_weights(rows, entropy, max_epochs, budget), "weights")
    plan = weights.select("source", "weight", F.expr("cast(floor(budget / n) AS int)").alias("whole"), F.expr("budget - cast(floor(budget / n) AS bigint) * n").alias("rest"), F.expr(f"greatest(1L, cast(ceil(n / {block_tokens}) AS bigint))").alias("blocks"))
    dealt = rows.join(plan, "source", "left").withColumn("block", F.expr(f"coalesce({_hash('key')} % blocks, 0L)"))
    blocks = dealt.where("whole IS NOT NULL").groupBy("source", "block").agg(F.sum("tokens").alias("n"), F.max("whole").alias("whole"), F.max("rest").alias("rest"))
    numbered = blocks.withColumn("epoch", F.explode(F.expr("sequence(0, whole)"))).withColumn("order", F.expr(_hash("source", "cast(block AS string)", "cast(epoch AS string)")))
    numbered = scratch.put(numbered.withColumn("stretch", F.expr(f"cast(order DIV {(1 << 60) // STRETCHES} AS int)")), "numbered")
    stretches = numbered.groupBy("source", "epoch", "stretch").agg(F.sum("n").alias("s_n"), F.count("*").alias("s_count"))
    earlier = Window.partitionBy("source", "epoch").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # STRETCHES rows at most
    stretches = stretches.withColumn("n_before", F.coalesce(F.sum("s_n").over(earlier), F.lit(0))).withColumn("rank_before", F.coalesce(F.sum("s_count").over(earlier), F.lit(0)))
    numbered = numbered.join(stretches.drop("s_n", "s_count"), ["source", "epoch", "stretch"])
    inside = Window.partitionBy("source", "epoch", "stretch").orderBy("order", "block")
    numbered = numbered.withColumn("block_rank", (F.col("rank_before") + F.row_number().over(inside)).cast("int")).withColumn("end", F.col("n_before") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # Of the last epoch: blocks within the budget, and what is left of it for the block at the edge.
    numbered = numbered.withColumn("room", F.expr("CASE WHEN epoch < whole OR end <= rest THEN NULL ELSE rest - (end - n) END")).where("room IS NULL OR room > 0")
    used = scratch.put(numbered.select("source", "block", "epoch", "block_rank", "room"), "blocks")
    full = dealt.join(used.where("room IS NULL").drop("room"), ["source", "block"])
    edge = dealt.join(used.where("room IS NOT NULL"), ["source", "block"]).where("tokens <= room").withColumn("order", F.expr(_hash("key", "cast(epoch AS string)")))
    inside = Window.partitionBy("source", "block").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("end", F.sum("tokens").over(inside)).where("end <= room")
    bare = dealt.where("whole IS NULL").withColumn("epoch", F.lit(0)).withColumn("block_rank", F.lit(1))
    columns = ["doc_id", "source", "tokens", "epoch", "block", "block_rank", F.coalesce("weight", F.lit(0.0)).alias("weight"), *[F.col(f"carry_{c}").alias(c) for c in carry]]
    return full.select(columns).unionByName(edge.select(columns)).unionByName(bare.select(columns))


#: The same in DuckDB's SQL, with the weights rounded as the query rounds them.
SQL = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, 'text/' || md5(coalesce(text, ''))) AS key,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents),
sums AS (SELECT source, sum(tokens)::BIGINT AS n FROM docs GROUP BY source HAVING sum(tokens) > 0),
shares AS (SELECT source, n, n / (SELECT sum(n) FROM sums)::DOUBLE AS p FROM sums),
steps(k, lo, hi, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN h >= {ENTROPY} * ln(cnt) THEN m ELSE lo END, CASE WHEN h >= {ENTROPY} * ln(cnt) THEN hi ELSE m END,
         CASE WHEN r <= {MAX_EPOCHS} THEN low ELSE q END, CASE WHEN r <= {MAX_EPOCHS} THEN q ELSE high END
  FROM (SELECT k, lo, hi, low, high, (lo + hi) / 2 AS m, (low + high) / 2 AS q,
          (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM shares) AS h,
          (SELECT max(pow(p, (low + high) / 2 - 1)) / sum(pow(p, (low + high) / 2)) FROM shares) AS r,
          (SELECT count(*) FROM shares) AS cnt FROM steps WHERE k < {STEPS})),
alpha AS (SELECT greatest(
    CASE WHEN (SELECT -sum(p * ln(p)) FROM shares) >= {ENTROPY} * ln((SELECT count(*) FROM shares)) THEN 1 ELSE (SELECT lo FROM steps WHERE k = {STEPS}) END,
    CASE WHEN 1 >= {MAX_EPOCHS} THEN 1 ELSE (SELECT high FROM steps WHERE k = {STEPS}) END) AS a),
weights AS (SELECT source, n, pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, alpha) AS weight FROM shares, alpha),
plan AS (SELECT source, weight, n, round(weight * (SELECT sum(n) FROM sums))::BIGINT AS budget, greatest(1, ceil(n / {BLOCK_TOKENS}))::BIGINT AS blocks FROM weights),
plan2 AS (SELECT *, (budget // n)::INT AS whole, budget - (budget // n) * n AS rest FROM plan),
dealt AS (SELECT docs.*, weight, whole, rest, coalesce(('0x' || substr(md5(key), 1, 15))::BIGINT % blocks, 0) AS block FROM docs LEFT JOIN plan2 USING (source)),
blocks AS (SELECT source, block, sum(tokens)::BIGINT AS n, max(whole) AS whole, max(rest) AS rest FROM dealt WHERE whole IS NOT NULL GROUP BY source, block),
epochs AS (SELECT *, unnest(range(0, whole + 1))::INT AS epoch FROM blocks),
ordered AS (SELECT *, ('0x' || substr(md5(source || '/' || block || '/' || epoch), 1, 15))::BIGINT AS o FROM epochs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, epoch ORDER BY o, block)::INT AS block_rank,
    sum(n) OVER (PARTITION BY source, epoch ORDER BY o, block ROWS UNBOUNDED PRECEDING) AS ends FROM ordered),
used AS (SELECT source, block, epoch, block_rank, CASE WHEN epoch < whole OR ends <= rest THEN NULL ELSE rest - (ends - n) END AS room FROM ranked),
edge AS (SELECT d.*, u.epoch, u.block_rank, u.room, sum(tokens) OVER (PARTITION BY d.source, d.block ORDER BY ('0x' || substr(md5(key || '/' || u.epoch), 1, 15))::BIGINT, key ROWS UNBOUNDED PRECEDING) AS ends
    FROM dealt d JOIN used u ON d.source = u.source AND d.block = u.block AND u.room > 0 WHERE tokens <= u.room)
SELECT doc_id, source, tokens, epoch, block, block_rank, round(weight, 9) AS weight FROM
 (SELECT d.doc_id, d.source, tokens, u.epoch, d.block, u.block_rank, weight FROM dealt d JOIN used u ON d.source = u.source AND d.block = u.block AND u.room IS NULL
  UNION ALL SELECT doc_id, source, tokens, epoch, block, block_rank, weight FROM edge WHERE ends <= room
  UNION ALL SELECT doc_id, source, tokens, 0, block, 1, 0 FROM dealt WHERE whole IS NULL)
"""
