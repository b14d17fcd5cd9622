"""Runs a query and its DuckDB statement on the same tables and compares rows."""

import math
import pathlib

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        if pathlib.Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, int):
            return str(x)
        return str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(spark, name, fn, sql, sf_dir):
    frame = fn(spark, sf_dir)
    got = canon(frame.columns, [tuple(r) for r in frame.collect()])
    columns, rows = duck(sf_dir, sql)
    assert sorted(columns) == sorted(frame.columns), name
    want = canon(columns, rows)
    assert len(got) == len(want), (name, len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (name, len(bad), bad[:3])
