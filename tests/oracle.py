"""Compares a query's rows with those of its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return float(f"{v + 0.0:.9g}")
    return v


def rows_of(df) -> list:
    columns = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = con.sql(sql)
    columns = sorted(r.columns)
    at = [r.columns.index(c) for c in columns]
    return columns, sorted((tuple(_plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
