"""Comparison of a query with its SQL, as the driver does it: columns by name, rows without order."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=str)


def compare(spark, query, sql):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = query(spark, DATA)
    expected = connection.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, expected.fetchall())
