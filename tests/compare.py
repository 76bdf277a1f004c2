"""Compare a Spark result with a DuckDB result: names, row count and values, in any row order."""

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def kinds(names, rows):
    """Python types per column, to notice an integer where the other side has a double."""
    out = {}
    for i, name in enumerate(names):
        out[name] = {type(r[i]).__name__ for r in rows if r[i] is not None}
    return out


def check(df, con, sql):
    spark_rows = [tuple(r) for r in df.collect()]
    duck = con.execute(sql)
    duck_names = [d[0] for d in duck.description]
    duck_rows = duck.fetchall()
    assert sorted(df.columns) == sorted(duck_names)
    assert len(spark_rows) == len(duck_rows)
    assert kinds(df.columns, spark_rows) == kinds(duck_names, duck_rows)
    left, right = _rows(df.columns, spark_rows), _rows(duck_names, duck_rows)
    assert left == right, (list((left - right).items())[:3], list((right - left).items())[:3])
    return len(spark_rows)
