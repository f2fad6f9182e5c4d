"""Compares a query's rows with those of its SQL on the same tables."""

from pathlib import Path

import duckdb


def rows_of_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    out = con.execute(sql)
    names = [x[0] for x in out.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=repr)


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
