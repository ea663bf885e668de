"""Compare a query's rows with those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(d):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return c


def _rows(rows):
    return sorted(tuple(repr(round(x, 6) + 0.0 if isinstance(x, float) else x) for x in r) for r in rows)


def same(df, c, sql):
    found = c.sql(sql)
    columns = sorted(found.columns)
    assert sorted(df.columns) == columns
    want = c.sql("SELECT " + ", ".join(f'"{x}"' for x in columns) + f" FROM ({sql})").fetchall()
    assert _rows(tuple(r) for r in df.select(*columns).collect()) == _rows(want)
