"""Comparison of a query with its SQL on the driver's tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("GNEISS_TEST_SF", "/root/testdata/sf0.001")


def _text(v) -> str:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return format(v, ".9g")
    if isinstance(v, (list, tuple)):
        return repr([_text(x) for x in v])
    return repr(v) if v is None or isinstance(v, bool) else str(v)


def rows(columns, values) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_text(r[i]) for i in order) for r in values)


def check(spark, name, query, sql) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    have = query(spark, SF)
    assert sorted(have.columns) == sorted(columns)
    assert rows(have.columns, have.collect()) == rows(columns, want.fetchall()), name
