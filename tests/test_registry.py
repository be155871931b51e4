"""Every query against its reference SQL at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from rotativa.plans.oracle import ORACLE
from rotativa.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings events labels lineitem orders pages".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cells(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(v):
        return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = found.collect()
    assert rows
    if name not in ORACLE:
        return
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(found.columns)
    assert cells(found.columns, rows) == cells(names, result.fetchall())


def test_every_reference_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"q_embed"}
