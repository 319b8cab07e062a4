"""Compare a query's rows with DuckDB's for the equivalent SQL: columns by name, rows in any order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(v) -> str:
    if pd.isna(v) is True or v is None:
        return "null"
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        return repr(round(float(v), 9))
    except (TypeError, ValueError):
        return str(v)


def rows(pdf, cols) -> list[tuple]:
    return sorted(tuple(cell(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False))


def same(spark_pdf, duck_pdf) -> None:
    cols = sorted(spark_pdf.columns)
    assert cols == sorted(duck_pdf.columns)
    assert rows(spark_pdf, cols) == rows(duck_pdf, cols)
