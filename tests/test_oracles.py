"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check_oracles import compare, duck
from vigilog.plans.oracles import ORACLES
from vigilog.plans.queries import BATCH
from vigilog.plans.stream_queries import STREAM

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [*BATCH, *STREAM])
def test_query_equals_sql(spark, con, name):
    problem, _, _ = compare(spark, con, name, SF_DIR)
    assert problem is None


def test_every_query_has_sql():
    assert {*BATCH, *STREAM} == set(ORACLES)
    assert {*BATCH, *STREAM} <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns and df.count() > 0
