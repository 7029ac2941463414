"""Comparison of a query with its SQL, as multisets of rows with columns in the order of their names."""

import glob
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def compare(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted((tuple(plain(v) for v in r) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall()), key=repr)
    assert ours == theirs
