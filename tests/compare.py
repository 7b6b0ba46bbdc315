"""Runs a registered query and its SQL and compares the rows as multisets."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def outside_engine(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


SAME_TYPE = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
             "boolean": "BOOLEAN"}


def difference(df, con, sql: str) -> str | None:
    """None when schema and rows agree, else what differs."""
    relation = con.sql(sql)
    want_types = dict(zip(relation.columns, map(str, relation.types)))
    have_types = {n: SAME_TYPE.get(t, t) for n, t in df.dtypes}
    if want_types != have_types:
        return f"schema {have_types} is not {want_types}"
    columns = sorted(have_types)
    have = Counter(tuple(r[c] for c in columns) for r in df.collect())
    where = [relation.columns.index(c) for c in columns]
    want = Counter(tuple(r[i] for i in where) for r in relation.fetchall())
    if have == want:
        return None
    extra, missing = have - want, want - have
    return (f"{sum(have.values())} rows against {sum(want.values())}; "
            f"extra {list(extra.items())[:2]}; missing {list(missing.items())[:2]}")
