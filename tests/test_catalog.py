"""Every catalogued query against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest
from conftest import SF

from veinstone.plans import catalog, lookup_queries, more_queries, rule_queries, search_queries, structure_queries  # noqa: F401 the others add to the catalog

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_same_as_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    left = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert left == sorted(repr([plain(r[k]) for k in order]) for r in want.fetchall())


def test_collection_last_orders_all_keys(spark, tmp_path):
    orders = spark.range(1, 251).selectExpr("id * 1000 o_orderkey", "timestamp_ntz'2020-01-01' o_orderdate", "1.0D o_totalprice")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    orders.selectExpr("o_orderkey l_orderkey", "1 l_linenumber", "o_orderdate l_shipdate", "1.0D l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [(r.id, r._root_, r.sort_isi) for r in catalog.QUERIES["o3_collection_last"](spark, str(tmp_path)).collect()]
    assert got == [(k * 100_000 + 1, k * 1000, 1) for k in range(1, 201)]
