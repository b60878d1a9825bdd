"""Holding a query against its SQL, as the driver does: rows as sorted tuples, columns by name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, bytearray | bytes):
        return bytes(value).hex()
    if isinstance(value, list):
        return tuple(map(tidy, value))
    return value


def by_name(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted((tuple(tidy(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, sf, query, sql):
    """A message about the first difference, or None."""
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(sql)
    want = by_name([d[0] for d in want.description], want.fetchall())
    df = query(spark, sf)
    got = by_name(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    return next((f"{a} against {b}" for a, b in zip(got[1], want[1], strict=True) if a != b), None)
