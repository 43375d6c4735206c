"""Every registered query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pvtide.plans.oracle import ORACLE_SQL
from pvtide.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _canon(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, sorted((tuple(_norm(x) for x in row) for row in pdf.itertuples(index=False)), key=repr)


def test_every_query_has_an_oracle():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle_can_be_a_view(con, name):
    """The driver may wrap a twin in a view: it must be one plain SELECT."""
    con.execute(f"create or replace view checked as {entry.oracle_sql()[name]}")
    assert con.execute("select count(*) from checked").fetchone()[0] >= 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, con, name):
    spark_pdf = entry.queries()[name](spark, SF_DIR).toPandas()
    oracle_pdf = con.execute(entry.oracle_sql()[name]).df()
    assert len(spark_pdf) == len(oracle_pdf)
    assert _canon(spark_pdf) == _canon(oracle_pdf)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "ss_id"
    assert df.count() > 0


def test_parity_does_not_depend_on_session_zone(spark, con):
    """The driver's session may use any time zone; zone-less data must not move."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        bad = [name for name, fn in QUERIES.items()
               if _canon(fn(spark, SF_DIR).toPandas()) != _canon(con.execute(entry.oracle_sql()[name]).df())]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert bad == []
