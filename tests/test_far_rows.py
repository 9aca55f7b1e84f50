"""Queries whose SQL supposes that the tables' grid stays in the country, over rows of far larger tables."""

import duckdb
import pytest

from parcelspark.plans import catalogue
from tests.oracle import connection, same


@pytest.mark.parametrize("name", ["drawn_routes", "dxf_report", "shp_in_degrees"])
def test_rows_far_north(spark, sf_dir, tmp_path, name):
    duckdb.execute(f"COPY (SELECT * REPLACE (o_orderkey + 8000000 AS o_orderkey) FROM '{sf_dir}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    same(catalogue.QUERIES[name](spark, str(tmp_path)), connection(str(tmp_path)), catalogue.ORACLES[name])
