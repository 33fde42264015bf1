"""Physical plans and the driver contract."""

import re

import pytest

import __spark_entry__ as entry
from sliceweave import catalog
from tests.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pip_unique_assign", "pip_label_last_wins", "ratio_filter", "mbn_links", "crossings", "bins_to_cells"])
def test_no_nested_loops(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_shuffle_join_when_nothing_is_small(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(catalog.pip_unique_assign(spark, SF))
        assert "SortMergeJoin" in text and "NestedLoop" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scans_read_only_what_is_needed(spark):
    schema = re.search(r"orders.parquet\].*?ReadSchema: (\S+)", plan(catalog.pip_unique_assign(spark, SF)), re.S).group(1)
    assert schema == "struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>"
    assert "PushedFilters: [In(l_returnflag, [N,R])]" in plan(catalog.marker_points(spark, SF))


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"barcode", "gene", "value", "num_assigned_bins", "n_counts", "nation"}
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bins_to_cells", "pip_bin_counts", "assemble", "otsu", "polygons_within", "polygons_contain", "overlay_difference"])
def test_queries_match_sql(spark, name):
    assert compare(spark, duck(SF), SF, name, catalog.QUERIES[name], catalog.ORACLES[name]) == ""
