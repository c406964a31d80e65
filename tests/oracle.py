"""Run a catalogue query in Spark and its SQL in DuckDB, and compare whole results."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    order = [found.index(n) for n in sorted(found)]
    return sorted(found), sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account of what differs."""
    names, mine = spark_rows(df)
    other_names, theirs = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} against {other_names}"
    if mine == theirs:
        return None
    only_mine, only_theirs = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"{len(mine)} against {len(theirs)} rows; {list(only_mine)[:3]} against {list(only_theirs)[:3]}"
