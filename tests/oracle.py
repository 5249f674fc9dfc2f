"""Rows of a Spark query against the rows of its SQL in DuckDB, compared as sorted normalised values."""

import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 6))
    return str(v)


def same(df, con, sql):
    names = sorted(df.columns)
    ours = sorted(tuple(value(r[c]) for c in names) for r in df.collect())
    found = con.execute(sql)
    theirs = [d[0] for d in found.description]
    assert names == sorted(theirs)
    at = [theirs.index(c) for c in names]
    assert ours == sorted(tuple(value(r[k]) for k in at) for r in found.fetchall())
