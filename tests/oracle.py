"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.7g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def compare(spark, query, sql: str) -> None:
    import duckdb

    frame = query(spark, DATA)
    names = sorted(frame.columns)
    with duckdb.connect() as con:
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        wanted = found.fetchall()
    assert sorted(columns) == names
    places = [columns.index(n) for n in names]
    left = Counter(tuple(plain(r[n]) for n in names) for r in frame.collect())
    right = Counter(tuple(plain(r[k]) for k in places) for r in wanted)
    assert left == right
