"""Run a query in Spark and its SQL in DuckDB and compare rows, names and values."""

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, db, run, sql, sf_dir):
    """(message or None, Spark rows, Spark seconds)"""
    start = time.time()
    df = run(spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return None, len(got), seconds
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    got_names, got_rows = canonical(df.columns, got)
    wanted_names, wanted_rows = canonical(names, wanted)
    if got_names != wanted_names:
        return f"columns {got_names} != {wanted_names}", len(got), seconds
    if got_rows != wanted_rows:
        left, right = set(got_rows) - set(wanted_rows), set(wanted_rows) - set(got_rows)
        sample = f"spark only {sorted(left)[:3]}; duckdb only {sorted(right)[:3]}"
        return f"{len(got_rows)} vs {len(wanted_rows)} rows, {len(left)}/{len(right)} differ: {sample}", len(got), seconds
    return None, len(got), seconds
