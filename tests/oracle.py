"""Hold a DataFrame against SQL on the same tables."""

from __future__ import annotations

import os

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows_of(frame) -> tuple[list[str], list[str]]:
    names = sorted(frame.columns)
    plain = [frame[c].astype(object).where(frame[c].notna(), None).map(lambda v: float(f"{v:.9g}") if isinstance(v, float) else v) for c in names]
    return names, sorted(map(repr, zip(*plain, strict=True)))


def expect(df, sql: str, where: str = DATA) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{where}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got, wanted = rows_of(df.toPandas()), rows_of(con.sql(sql).df())
    assert got[0] == wanted[0]
    assert len(got[1]) == len(wanted[1])
    assert got[1] == wanted[1]
