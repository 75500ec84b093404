"""Compares a query with its SQL, whatever the order of rows and columns."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _rows(table, names):
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(map(repr, zip(*columns, strict=True)))


def assert_same(frame, sql, sf_dir):
    ours, theirs = frame.toArrow(), connect(sf_dir).execute(sql).to_arrow_table()
    names = sorted(ours.column_names)
    assert names == sorted(theirs.column_names)
    assert _rows(ours, names) == _rows(theirs, names)
