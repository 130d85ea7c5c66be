"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from quillon.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "part", "events", "embeddings", "documents"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    want = sorted(repr(r) for r in duck.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({catalogue.ORACLES[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLES.keys()))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_softplus_inv_outside(spark, tmp_path):
    """Events of value 0 and below, without a value and past the cap, against the SQL."""
    values = [0.0, -0.0, -1.0, -math.inf, 0.01, 5.0, 600.0, 1e300, math.inf, math.nan, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(repr(tuple(r)) for r in catalogue.QUERIES["softplus_inv"](spark, str(tmp_path)).select("event_id", "v").collect())
    assert got == sorted(repr(r) for r in con.sql(f"select event_id, v from ({catalogue.ORACLES['softplus_inv']})").fetchall())
    assert "(0, -inf)" in got and "(2, nan)" in got


def test_softplus_inv_bits(spark, tmp_path):
    """Values near 0 and around 20 ln 2, where the result rounds to a zero of either sign, bit by bit as the SQL."""
    near = [sign * m * 10.0 ** -e for e in range(2, 20) for m in (1, 2.7, 4.6816588) for sign in (1, -1)] + [5e-324, -1e-300, 6.897393095446387e-08, 1.5590528867688271e-09]
    values = near + [20 * math.log(2) + k * 1e-6 for k in range(-30, 31)]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(repr(tuple(r)) for r in catalogue.QUERIES["softplus_inv"](spark, str(tmp_path)).select("event_id", "v").collect())
    assert got == sorted(repr(r) for r in con.sql(f"select event_id, v from ({catalogue.ORACLES['softplus_inv']})").fetchall())
    assert sum(" -0.0)" in x for x in got) > 1 and sum("-inf" in x for x in got) > 1
