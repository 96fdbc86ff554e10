"""A query's rows beside those of its SQL, without regard to order."""

import glob
import math

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(value(y) for y in x)
    if x is None or type(x).__name__ in ("NAType", "NaTType") or (isinstance(x, (float, np.floating)) and math.isnan(x)):
        return None
    if isinstance(x, (float, np.floating)):
        return round(float(x), 6) + 0.0
    return x.item() if isinstance(x, np.generic) else x


def rows(frame, columns):
    found = [tuple(value(x) for x in r) for r in frame[columns].itertuples(index=False)]
    # 1 and 1.0 are one value, whatever column type a missing value has left them
    return sorted((tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in found), key=str)


def same(spark, query, sql, sf_dir=DATA):
    mine = query(spark, sf_dir).toPandas()
    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {p.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    theirs = db.sql(sql).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert rows(mine, columns) == rows(theirs, columns)
    return mine
