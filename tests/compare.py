"""Side-by-side comparison of a Spark result with DuckDB SQL over the same parquet tables."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(row[i]) for i in order]) for row in rows)


def differences(spark_df, con, sql):
    """Column names and rows that only one side has."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"]
    left, right = rows_of(spark_df.columns, spark_df.collect()), rows_of(names, want.fetchall())
    if left == right:
        return []
    a, b = set(left) - set(right), set(right) - set(left)
    return [f"{len(left)} rows against {len(right)}", *[f"spark only: {x[:300]}" for x in sorted(a)[:3]], *[f"sql only: {x[:300]}" for x in sorted(b)[:3]]]
