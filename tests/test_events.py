"""Queries of job history on odd events, against their SQL."""

import duckdb
import pytest

from sheafline import catalogue
from sheafline.functions import text as T

from .oracle import same

ROWS = [
    (1, "2024-01-17 23:59:59", 7, "error", 3.5), (2, "2024-01-18 00:00:00", 7, "purchase", 12345678.9), (3, None, 7, "click", 1e-5), (4, "2024-01-18 00:00:00", None, "error", 1.0),
    (5, "2024-01-18 00:00:00", 2, "purchase", None), (6, "2024-01-18 00:00:00", 2, None, 0.0005), (None, "2024-01-18 00:00:00", 2, "error", 1.0),
    (7, "2024-01-18 00:00:00", 3, "error", 2.0), (7, "2024-01-18 00:00:00", 3, "purchase", 1.5e17), (8, "2024-01-18 00:00:00", 3, "purchase", float("nan")), (9, "2024-01-18 00:00:00", 3, "purchase", float("inf")),
]


@pytest.fixture
def events(spark, tmp_path):
    def made(rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
        df.withColumn("ts", df.ts.cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        return str(tmp_path), con

    return made


def against_sql(spark, name, made):
    at, con = made
    same(catalogue.queries()[name](spark, at), con, catalogue.oracle_sql()[name])


def test_job_records_under_any_map_policy(spark, events):
    """A repeated key of two maps is no error where the session doesn't allow it, which is the default."""
    was = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        against_sql(spark, "job_records", events(ROWS))
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", was)


def test_double_text(spark):
    values = [0.0, -0.0, 0.001, 0.0005, 0.0001, 1e-5, -2.5e-7, 1e7, -12345678.9, 1e15, 1e16, 1.5e17, 1e300, float("nan"), float("inf"), float("-inf"), None]
    got = spark.createDataFrame(list(enumerate(values)), "i int, x double").orderBy("i").select(T.double_text(T.F.col("x")))
    assert [r[0] for r in got.collect()] == [duckdb.execute("SELECT ?::DOUBLE::VARCHAR", [v]).fetchone()[0] for v in values]


def test_token_sizes_round_exact_values(spark, events):
    """268.8 seconds are 1.05 MB, which is a little above the middle as a double; 294.4 are 1.15, a little below."""
    sizes = [256.0, 255.999, 268.8, 294.4, 320.0, 345.6, 371.2, 0.125, 0.375, *[12.8 * k for k in range(21, 221)]]
    against_sql(spark, "token_expiry", events([*ROWS, *[(100 + i, "2024-01-17 00:00:00", 1, "purchase", v) for i, v in enumerate(sizes)]]))
