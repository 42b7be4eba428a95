"""Every registered query of the library against its SQL; those without SQL must give rows of a stable schema."""

import subprocess
import sys

import pytest
from conftest import ROOT
from oracle import differences

from scriptorium.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_are_read_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql(); from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = QUERIES["events_between"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "EqualTo(event_type,click)" in scan and "GreaterThanOrEqual(ts" in scan and "props" not in scan.split("ReadSchema")[1]
