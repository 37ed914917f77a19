"""Results as sorted lists of texts, by column name, from Spark and from DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if isinstance(v, float):
        return f"{v:.12g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return str([text(x) for x in v])
    return str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(text(r[c]) for c in columns) for r in df.collect())


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def duck_rows(con, sql):
    out = con.sql(sql)
    columns = sorted(out.columns)
    at = [out.columns.index(c) for c in columns]
    return columns, sorted(tuple(text(r[i]) for i in at) for r in out.fetchall())
