import math

import duckdb
import pytest

from kinfold import queries as engine

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    df = engine.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    if name not in engine.SQL:
        assert rows
        return
    cursor = con.execute(engine.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()], key=str)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True)), (a, b)
