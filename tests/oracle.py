"""Spark against DuckDB, as sets of rows with doubles to nine digits."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    d = duckdb.connect()
    for name in os.listdir(sf):
        d.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return d


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("%.9g" % r[i] if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


def compare(df, sql, d):
    want = d.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
