"""Run queries and their SQL twins on one scale and compare all rows."""

from __future__ import annotations

import datetime
import math
import sys
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr), [columns[k] for k in order]


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def difference(spark, sf_dir: str, query, sql: str, con=None) -> str | None:
    df = query(spark, sf_dir)
    got, names = rows_of(df.columns, df.collect())
    rel = (con or connection(sf_dir)).sql(sql)
    want, wanted = rows_of(rel.columns, rel.fetchall())
    if names != wanted:
        return f"columns {names} and {wanted}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, as {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from orefield.session import session

    spark = session(spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = connection(sf)
    chosen = sys.argv[2:] or [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
    for name in chosen:
        try:
            sql = entry.oracle_sql().get(name)
            said = difference(spark, sf, entry.queries()[name], sql, con) if sql else f"no SQL; {entry.queries()[name](spark, sf).count()} rows"
        except Exception as e:  # a report over all queries
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(name, "ok" if said is None else said, flush=True)
