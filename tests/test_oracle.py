"""Every registered query against its reference SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from check_oracle import compare, connect
from telemill.plans.registry import REGISTERED

SF = "/root/testdata/sf0.001"
PLANS = {name: plan for name, (plan, _) in REGISTERED.items()}
SQL = {name: sql for name, (_, sql) in REGISTERED.items() if sql}


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, db, name):
    if name not in SQL:
        assert PLANS[name](spark, SF).count() > 0
        return
    ok, note = compare(PLANS[name](spark, SF), db, SQL[name])
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() > 0
