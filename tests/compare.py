"""Holds a query's result against its SQL, as the driver does."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def shown(v: object) -> str:
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(df.columns)
    ours = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    theirs_names = [x[0] for x in cur.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    theirs = sorted(tuple(shown(r[i]) for i in at) for r in cur.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs, (sorted(set(ours) - set(theirs))[:3], sorted(set(theirs) - set(ours))[:3])
