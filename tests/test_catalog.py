"""Every query with SQL agrees with DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from vaultgrid.operators import simulation
from vaultgrid.plans import catalog, contagion, corpora, flows, inventory, journals, more, outputs, scans, stores  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(float(v), 9) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cur.fetchall())
    else:
        assert got


def test_simulations_draw_as_often_as_the_reference(spark):
    drawn = simulation.stochastic(catalog.scored(spark, SF), trials=5000)
    columns = ["asset_id", "breach", "p50", "p95", "var_year", "risk_category"]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(catalog.stochastic_breach(spark, SF)) == rows(drawn)
    assert catalog.stochastic_estate(spark, SF).first() == simulation.estate(drawn).first()
