"""Job history, queue, expiry, limits, task states (A3, O1, DT1, DT2, E13, J14, J16, M4, M5, P17, P25, R1-R8, W19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import double_text
from ..plans.registry import query
from ..sources.adapters import conversions, read, with_cte

AS_OF = "2024-01-25 00:00:00"


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def _iso(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(with_cte("cv", "SELECT count(*)::BIGINT AS total, count(*) FILTER (status = 'done')::BIGINT AS done, count(*) FILTER (status = 'error')::BIGINT AS errors, coalesce(round_even(avg(seconds) FILTER (status = 'done'), 1), 0) AS mean_seconds FROM cv"))
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, M4: one pass with conditional aggregates; the mean rounds half to even."""
    done = F.col("status") == "done"
    return conversions(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(F.col("status") == "error").alias("errors"), F.coalesce(F.bround(F.avg(F.when(done, F.col("seconds"))), 1), F.lit(0.0)).alias("mean_seconds"))


@query(with_cte("cv", "SELECT id, task_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM cv ORDER BY created_at DESC, id DESC LIMIT 50"))
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 50; the limit is the feature and plans as a top-k."""
    c = conversions(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("id")).limit(50)
    return c.select("id", "task_id", "status", _iso("created_at").alias("created"))


@query(with_cte("cv", f"SELECT user_id, count(*)::BIGINT AS orphans, min(id)::BIGINT AS first_id FROM cv WHERE status = 'processing' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR GROUP BY user_id"))
def orphan_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT2, R4: jobs in process for more than an hour at a stated time."""
    old = F.col("created_at") < _ts(AS_OF) - F.expr("INTERVAL 1 HOUR")
    return conversions(spark, sf_dir).where((F.col("status") == "processing") & old).groupBy("user_id").agg(F.count("*").alias("orphans"), F.min("id").alias("first_id"))


@query(with_cte("cv", f"SELECT id, CASE WHEN seconds * 4096 < 1048576 THEN round_even(seconds * 4, 0)::BIGINT || ' KB' ELSE printf('%.1f MB', seconds * 4096 / 1048576) END AS size, created_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS expired FROM cv WHERE status = 'done'"))
def token_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT2, R6, M5: download tokens older than seven days."""
    bytes_ = F.col("seconds") * 4096
    mb = bytes_ / 1048576
    # The double's exact value is rounded, not its shortest digits: 1.05 is above the middle, 1.15 below.
    mb = F.when(F.isnan(mb) | (mb == float("inf")), double_text(mb)).otherwise(F.call_function("format_number", mb, F.lit("0.0")))
    size = F.when(bytes_ < 1048576, F.concat(F.bround(F.col("seconds") * 4, 0).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))
    return conversions(spark, sf_dir).where("status = 'done'").select("id", size.alias("size"), (F.col("created_at") < _ts(AS_OF) - F.expr("INTERVAL 7 DAY")).alias("expired"))


@query(with_cte("cv", "SELECT id, user_id, CASE WHEN status = 'cancelled' THEN 0 ELSE row_number() OVER (PARTITION BY user_id, status = 'cancelled' ORDER BY created_at, id) END::BIGINT AS position FROM cv WHERE status IN ('processing', 'cancelled')"))
def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First come, first served in each user's queue; a job cancelled in the queue never starts."""
    c = conversions(spark, sf_dir).where("status IN ('processing', 'cancelled')").withColumn("gone", F.col("status") == "cancelled")
    n = F.row_number().over(Window.partitionBy("user_id", "gone").orderBy("created_at", "id"))
    return c.withColumn("n", n).select("id", "user_id", F.when(F.col("gone"), 0).otherwise(F.col("n")).cast("long").alias("position"))


@query("SELECT user_id, strftime(m, '%Y-%m-%d %H:%M:%S') AS hour, n, greatest(n - 2, 0) AS rejected FROM (SELECT user_id, date_trunc('hour', ts) AS m, count(*)::BIGINT AS n FROM events GROUP BY 1, 2) WHERE n > 2")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tumbling window a key; requests beyond the limit of two an hour are rejected."""
    e = read(spark, sf_dir, "events").select("user_id", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).groupBy("user_id", "w").agg(F.count("*").alias("n")).where("n > 2")
    return e.select("user_id", _iso("w.start").alias("hour"), "n", F.greatest(F.col("n") - 2, F.lit(0)).cast("long").alias("rejected"))


@query(
    """SELECT user_id, day, arg_max(progress, ord) AS progress, arg_max(stage, ord) AS stage, count(*)::BIGINT AS updates, count(*) FILTER (stage = 'error')::BIGINT AS errors FROM (
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS stage, floor(value)::BIGINT AS progress, (ts, event_id) AS ord,
      coalesce(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cancelled FROM events) WHERE cancelled = 0 GROUP BY user_id, day"""
)
def task_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last values of each task; updates after a cancel are ignored."""
    e = read(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("stage"), F.floor("value").alias("progress"), "ts", "event_id")
    before = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    live = e.withColumn("cancelled", F.coalesce(F.bool_or(F.col("stage") == "click").over(before), F.lit(False))).where("NOT cancelled")
    g = live.groupBy("user_id", "day").agg(F.max_by(F.struct("progress", "stage"), F.struct("ts", "event_id")).alias("s"), F.count("*").alias("updates"), F.count_if(F.col("stage") == "error").alias("errors"))
    return g.select("user_id", "day", F.col("s.progress").alias("progress"), F.col("s.stage").alias("stage"), "updates", "errors")


@query("SELECT event_id, user_id, event_type, '[' || repeat('#', (floor(value / 25) % 21)::INT) || ']' AS bar FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS DISTINCT FROM event_type")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates whose stage differs from the one before, with a progress bar."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("prev", F.lag("event_type").over(by)).where("NOT (prev <=> event_type)")
    return e.select("event_id", "user_id", "event_type", F.concat(F.lit("["), F.expr("repeat('#', cast(floor(value / 25) % 21 AS int))"), F.lit("]")).alias("bar"))


@query("SELECT source, count(*)::BIGINT AS fresh FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 3 = 0 AND c.doc_id <> d.doc_id AND sha256(c.text) = sha256(d.text)) GROUP BY source")
def cache_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content hash isn't in the cache of another document (every third is cached)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    cached = d.where("doc_id % 3 = 0").groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    hit = F.col("lo").isNotNull() & ((F.col("lo") != F.col("doc_id")) | (F.col("hi") != F.col("doc_id")))
    return d.join(cached, "h", "left").where(~hit).groupBy("source").agg(F.count("*").alias("fresh"))


@query(with_cte("cv", "SELECT task, arg_max(status, id) AS status, max(seconds) AS seconds, count(*)::BIGINT AS writes FROM (SELECT *, 'task-' || (id % 3000) AS task FROM cv) GROUP BY task"))
def upsert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or ignore, then update by key: the last write of a task wins."""
    c = conversions(spark, sf_dir).withColumn("task", F.concat(F.lit("task-"), (F.col("id") % 3000).cast("string")))
    return c.groupBy("task").agg(F.max_by("status", "id").alias("status"), F.max("seconds").alias("seconds"), F.count("*").alias("writes"))


@query(with_cte("cv", "SELECT a.id, coalesce(active.status, queued.status, 'not-found') AS status FROM (SELECT id FROM cv UNION ALL SELECT id + 100000000000 FROM cv) a LEFT JOIN (SELECT * FROM cv WHERE status = 'processing') active USING (id) LEFT JOIN (SELECT * FROM cv WHERE status <> 'processing') queued USING (id)"))
def status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active entry, else the queued one, else not found."""
    c = conversions(spark, sf_dir).groupBy("id").agg(F.max(F.when(F.col("status") == "processing", F.col("status"))).alias("active"), F.max(F.when(F.col("status") != "processing", F.col("status"))).alias("queued"))
    asked = c.select("id").unionByName(c.select((F.col("id") + 100_000_000_000).alias("id")))  # every job, and as many that aren't there
    return asked.join(c, "id", "left").select("id", F.coalesce("active", "queued", F.lit("not-found")).alias("status"))


@query(with_cte("cv", "SELECT user_id, count(*) FILTER (status = 'done')::BIGINT AS done, max(seconds) FILTER (status = 'done') AS longest, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest FROM cv GROUP BY user_id"))
def read_api_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: per-user read model."""
    done = F.col("status") == "done"
    return conversions(spark, sf_dir).groupBy("user_id").agg(F.count_if(done).alias("done"), F.max(F.when(done, F.col("seconds"))).alias("longest"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("SELECT l_orderkey AS id, count(*)::BIGINT AS n, max(epoch_ms(l_shipdate) - epoch_ms(o_orderdate))::BIGINT AS longest_ms, strftime(min(l_shipdate), '%Y%m%d') AS stamp, count(*) FILTER (l_shipdate < o_orderdate)::BIGINT AS invalid FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT1, DT3, DT4."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("e"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("s"))
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    return j.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.max(F.unix_millis("e") - F.unix_millis("s")).alias("longest_ms"), F.date_format(F.min("e"), "yyyyMMdd").alias("stamp"), F.count_if(F.col("e") < F.col("s")).alias("invalid"))


@query("SELECT (props::JSON ->> 'k')::BIGINT AS k, count(*)::BIGINT AS n, min(event_id)::BIGINT AS first_id FROM events GROUP BY 1")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed read of a JSON column."""
    e = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"}).alias("p"))
    return e.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming tumbling window in sheafline.streaming."""
    from ..streaming.windows import tumbling

    w = tumbling(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    return w.select(_iso("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, s"""
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of six hours."""
    from ..streaming.windows import sessions

    s = sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return s.select("user_id", _iso("first").alias("start"), "n")
