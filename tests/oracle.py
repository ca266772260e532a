"""Rows of a query against rows of its SQL twin."""

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def differences(spark: SparkSession, sf_dir: str, query, sql: str) -> tuple[int, list, list]:
    """(rows, rows that only Spark has, rows that only the oracle has), a few of each."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(sql)
    df = query(spark, sf_dir)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    got = sorted(map(repr, (tuple(r) for r in df.select(*(f"`{n}`" for n in names)).collect())))
    columns = ", ".join(f'"{n}"' for n in names)
    expected = sorted(map(repr, con.sql(f"SELECT {columns} FROM ({sql})").fetchall()))
    a, b = set(got), set(expected)
    assert len(got) == len(expected), (len(got), len(expected))
    return len(got), sorted(a - b)[:3], sorted(b - a)[:3]
