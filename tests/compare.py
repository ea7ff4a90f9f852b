"""Runs a query and its SQL on the same tables and compares all values."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return a == b


def check(spark, data, query, sql):
    out = query(spark, data)
    columns = sorted(out.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    key = lambda row: tuple((x is None, "" if isinstance(x, float) else str(x)) for x in row) + tuple((x is None, round(x, 4)) if isinstance(x, float) else (False, 0) for x in row)
    theirs = sorted((tuple(row[names.index(c)] for c in columns) for row in found.fetchall()), key=key)
    ours = sorted((tuple(row[c] for c in columns) for row in out.collect()), key=key)
    assert len(ours) == len(theirs) and ours
    for a, b in zip(ours, theirs, strict=True):
        assert all(map(same, a, b)), (a, b)
