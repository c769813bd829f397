"""Registered queries against their SQL on the smallest tables; check.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["fn_cosine_distance", "half_distances", "sparse_distances", "text_format", "avg_vector", "sort_by_vector",
          "knn_join_same_label", "knn_join_blocks", "knn_join_lineitem_supplier", "distance_join", "bit_knn_jaccard",
          "ivf_search_given_centers", "ivf_range_search", "kmeans_step", "filter_like_knn"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "vec_id", "distance", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
