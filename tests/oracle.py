"""Comparison of a query with its SQL: rows as multisets, columns by name, numbers rounded."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings source_location chunk page page_table index_meta trace embedding mix_target".split()


def canon(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in rows)


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def compare(spark, sf, name, query, sql):
    """None if both agree, else what differs."""
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    rel = duck(sf).execute(sql)
    want_names = [c[0] for c in rel.description]
    want = rows_of(want_names, rel.fetchall())
    if sorted(df.columns) != sorted(want_names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(want_names)}"
    if got != want:
        return f"{name}: {sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return None
