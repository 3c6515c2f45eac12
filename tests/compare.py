"""Results of Spark and DuckDB, made comparable."""

import decimal
import os

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((plain(a), plain(b)) for a, b in v.items()))
    return v


def of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def of_duckdb(sql, sf_dir):
    with duckdb.connect() as con:
        con.execute("set timezone = 'UTC'")
        for f in os.listdir(sf_dir):
            con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        cols = sorted(names)
        at = [names.index(c) for c in cols]
        return cols, sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
