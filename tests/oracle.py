"""Compare registered queries with their SQL in DuckDB, as multisets of rows."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return repr(v)


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(df, sql, sf_dir):
    names, rows = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    mine = sorted(str(tuple(plain(r[c]) for c in order)) for r in df.collect())
    his = sorted(str(tuple(plain(r[names.index(c)]) for c in order)) for r in rows)
    assert len(mine) == len(his), (len(mine), len(his))
    for a, b in zip(mine, his):
        assert a == b, f"spark {a}\nduckdb {b}"
