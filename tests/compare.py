"""Rows of Spark and DuckDB in one comparable form."""

import datetime
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float) or hasattr(v, "quantize"):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def duck(sf=SF):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(norm(row[i]) for i in at) for row in r.fetchall())
