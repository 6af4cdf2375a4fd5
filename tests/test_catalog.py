"""Every registered query of the semantic layer against its SQL on DuckDB."""

import duckdb
import pytest

from quillon import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].removesuffix("T00:00:00")
    return float(v) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, key):
    df = catalog.QUERIES[key](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if key not in catalog.ORACLES:
        assert got
        return
    found = duck.sql(catalog.ORACLES[key])
    assert sorted(df.columns) == sorted(found.columns)
    assert got == rows(found.columns, found.fetchall())


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).columns == ["order_customer_nation$caption", "revenue", "n"]


@pytest.mark.parametrize("key", ["dimension_expands", "agg_none_is_key", "expr_now"])
def test_whole_table_is_seen(spark, sf_dir, key):
    df, orders = catalog.QUERIES[key](spark, sf_dir), spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert sum(r.orderCount for r in df.collect()) == orders if "orderCount" in df.columns else df.count() == orders


@pytest.mark.parametrize("key", ["order_by", "order_default", "order_by_unselected", "order_nulls", "order_nulls_last"])
def test_whole_order_is_returned(spark, sf_dir, key):
    table = "documents" if "nulls" in key else "orders"
    places = [r.place for r in catalog.QUERIES[key](spark, sf_dir).collect()]
    assert sorted(places) == list(range(1, spark.read.parquet(f"{sf_dir}/{table}.parquet").count() + 1))


def test_helper_columns_on_odd_keys(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT k AS o_orderkey, u AS o_custkey, d AS o_orderdate FROM (SELECT unnest([NULL, -2, -1, 0, 1, 2]::BIGINT[]) AS k), (SELECT unnest([NULL, -3, -2, -1, 0, 1, 2, 3]::BIGINT[]) AS u),
      (SELECT unnest([NULL, TIMESTAMP '1996-02-29 23:59:59']) AS d)) TO '{tmp_path}/orders.parquet'""")
    df, con = catalog.QUERIES["helper_columns"](spark, str(tmp_path)), duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(r) for r in con.execute(catalog.ORACLES["helper_columns"]).fetchall())
