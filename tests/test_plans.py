"""Registered queries on the smallest tables, with adaptive execution and code generation on, against their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def adaptive(spark):
    s = spark.newSession()
    for k, v in (("spark.sql.adaptive.enabled", "true"), ("spark.sql.codegen.wholeStage", "true"), ("spark.sql.codegen.factoryMode", "FALLBACK"), ("spark.sql.shuffle.partitions", "4")):
        s.conf.set(k, v)
    return s


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "voxel_change", "m3c2_median", "c2c_distances", "nearest_points", "scor_scores", "las_round_trip", "segment_ids"])
def test_query_equals_its_sql(adaptive, sql, name):
    df = entry.queries()[name](adaptive, SF)
    cols = sorted(df.columns)
    want = sql.execute(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))
