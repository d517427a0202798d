"""Compares a query with its SQL, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    columns = sorted(df.columns)
    return columns, [tuple(r[c] for c in columns) for r in df.collect()]


def sql_rows(sql, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    db.execute("SET TimeZone = 'UTC'")
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], [tuple(r[i] for i in order) for r in got.fetchall()]


def same(df, sql, sf_dir):
    (a, x), (b, y) = rows_of(df), sql_rows(sql, sf_dir)
    assert a == b
    key = lambda r: tuple((v is None, str(v)) for v in r)
    x, y = sorted(x, key=key), sorted(y, key=key)
    assert len(x) == len(y)
    wrong = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    assert not wrong, wrong[:3]
