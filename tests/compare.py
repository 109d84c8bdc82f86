"""Compares a query's rows with its oracle's in DuckDB, whatever their order."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return (2, f"{round(float(v), 9) + 0.0:.9g}")
    return (3, str(v))


def same(df, con, sql, empty=False):
    """Equal rows, and some: two empty results show nothing."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in relation.fetchall())
    got = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    assert len(got) == len(want)
    assert want or empty
    assert got == want
