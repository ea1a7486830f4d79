"""Every registered query gives the rows of its SQL counterpart on the smallest tables."""

import math

import duckdb
import pytest

from wikimill.plans import ORACLES, QUERIES
from wikimill.plans.registry import BASE

SLOW = {n for n in QUERIES if n.endswith("_stream")}  # covered by test_streaming


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    duck.execute(ORACLES[name])
    names = [d[0] for d in duck.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == cols
    assert rows == sorted(tuple(norm(r[i]) for i in order) for r in duck.fetchall())
