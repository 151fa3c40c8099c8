"""Compares a Spark result with the SQL text of the same query run in DuckDB."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(cell(row[i]) for i in order) for row in rows
    )


SPARK_TYPE = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def run_sql(con, sql):
    result = con.execute(sql)
    columns = [(d[0], SPARK_TYPE.get(str(d[1]), str(d[1]))) for d in result.description]
    return normal(columns, result.fetchall())


def run_spark(df):
    columns = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return normal(columns, [tuple(r) for r in df.collect()])


def difference(got, want):
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{a} != {b}"
    return None
