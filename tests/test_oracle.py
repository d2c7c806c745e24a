"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.compare import differences, oracle_connection
from tests.conftest import SF
from workload.registry import registry

REG = registry()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("key", [k for k, (_, sql) in REG.items() if sql])
def test_matches_sql(key, spark, con):
    fn, sql = REG[key]
    assert differences(fn(spark, SF).toPandas(), con.execute(sql).df()) == ""


def test_names_are_plain():
    assert not [k for k in REG if "pipeline" in k or k.startswith("op")]
