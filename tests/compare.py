"""Rows of a registered query against its DuckDB query, over the same Parquet files."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    return con


def same(spark_df, con, sql):
    """None, or what differs."""
    want = con.sql(sql)
    names = sorted(spark_df.columns)
    if names != sorted(want.columns):
        return f"columns {names} against {sorted(want.columns)}"
    norm = lambda x: round(float(x), 6) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    got = sorted((tuple(norm(x) for x in r) for r in spark_df.select(*names).collect()), key=repr)
    exp = sorted((tuple(norm(x) for x in r) for r in want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall()), key=repr)
    if len(got) != len(exp):
        return f"{len(got)} rows against {len(exp)}; {[x for x in got if x not in exp][:2]} {[x for x in exp if x not in got][:2]}"
    bad = [(a, b) for a, b in zip(got, exp, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {bad[0]}" if bad else None
