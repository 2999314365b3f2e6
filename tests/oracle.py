"""Compare a registered query with its DuckDB twin: names, row count and an order-free hash of the values."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    assert sorted(have) == names, (sorted(have), names)
    at = [have.index(c) for c in names]
    want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    if got != want:
        a, b = set(got), set(want)
        raise AssertionError(f"{len(got)} and {len(want)} rows; only ours {sorted(a - b)[:3]}; only theirs {sorted(b - a)[:3]}")
    return len(got)
