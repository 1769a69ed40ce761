"""Compare a DataFrame with the result of SQL in an independent engine."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list:
    rows = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NA or v is pd.NaT or v != v:
                cells.append("")
            elif isinstance(v, bool):
                cells.append(str(v))
            elif hasattr(v, "item") or isinstance(v, int | float):
                v = v.item() if hasattr(v, "item") else v
                cells.append(str(v) if isinstance(v, bool) else f"{float(v):.9g}" if isinstance(v, int | float) else str(v))
            else:
                cells.append(str(v))
        rows.append(tuple(cells))
    return sorted(rows)


def assert_same(df, sql, sf_dir):
    mine, theirs = df.toPandas(), views(sf_dir).sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)
