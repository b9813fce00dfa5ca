"""Rows of a query against those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def key(row):
    return tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)


def differences(spark, query, sql, sf_dir):
    """(only in Spark, only in DuckDB), with columns in order of name. A query without rows, or with a column of nulls alone, is an
    error: it would compare nothing."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    assert rows and not [n for i, n in enumerate(names) if all(r[i] is None for r in rows)]
    mine = sorted(key(r) for r in rows)
    found = duck(sf_dir).sql(sql)
    assert sorted(found.columns) == names, (found.columns, names)
    theirs = sorted(key(r) for r in found.select(*[f'"{n}"' for n in names]).fetchall())
    close = len(mine) == len(theirs) and all(a == b or near(a, b) for a, b in zip(mine, theirs))
    return ([], []) if close else ([r for r in mine if r not in set(theirs)][:5], [r for r in theirs if r not in set(mine)][:5])


def near(a, b):
    for x, y in zip(a, b):
        if x != y:
            try:
                if abs(float(x) - float(y)) > 2e-5:
                    return False
            except ValueError:
                return False
    return True


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
