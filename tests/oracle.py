"""Runs a query and its SQL side by side on the test tables."""

from pathlib import Path

import duckdb
import pandas as pd


def same(spark, name, query, sql, sf="/root/testdata/sf0.001"):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    a = query(spark, sf).toPandas()
    b = con.execute(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns), (name, cols, sorted(b.columns))
    assert len(a) == len(b), (name, len(a), len(b))
    norm = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) and float(v).is_integer() else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert norm(a) == norm(b), name
    return len(a)
