"""Every registered query equals its DuckDB oracle (the driver's check, at sf 0.001)."""

import os

import duckdb
import pytest

from conftest import SMALL
from tools.check_oracles import TABLES, canon

import __spark_entry__ as entry
from marketlake.plans import catalog

QUERIES = catalog.queries()
ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_stored_size(spark):
    from marketlake.functions.timefn import human_size
    from marketlake.sources.tables import stored_size
    for name in ("events", "lineitem"):
        r = stored_size(spark, SMALL, name).withColumn("size_text", human_size("size_bytes")).first()
        assert r.size_bytes == os.path.getsize(f"{SMALL}/{name}.parquet") and r.size_text


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "open_price" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(ORACLES[name]).df()
    gc, gr = canon(got)
    wc, wr = canon(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_no_decimal_in_results(spark, con):
    """Money leaves both sides as DOUBLE (see catalog.MONEY_COLUMNS)."""
    for name, sql in ORACLES.items():
        rel = con.sql(sql)
        assert not [c for c, t in zip(rel.columns, rel.types) if str(t).startswith("DECIMAL")], name
    for name in ("S1_scan_ticks", "A14_bars_1m", "J7_asof_quotes"):
        assert "decimal" not in QUERIES[name](spark, SMALL).schema.simpleString(), name
