"""Every query that has an oracle agrees with it on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare
from visitloom.plans.catalog import QUERIES

ORACLES = entry.oracle_sql()

# The operator ids of the survey's inventory.
IDS = (
    [f"S0{i}" for i in range(1, 7)]
    + [f"P{i:02d}" for i in range(1, 15)]
    + [f"F{i:02d}" for i in range(1, 21)]
    + [f"J{i:02d}" for i in range(1, 14)]
    + [f"A{i:02d}" for i in range(1, 27)]
    + [f"W{i:02d}" for i in range(1, 8)]
    + [f"T{i:02d}" for i in range(1, 6)]
    + [f"U{i:02d}" for i in range(1, 5)]
    + [f"TS{i:02d}" for i in range(1, 14)]
    + [f"M{i:02d}" for i in range(1, 32) if i != 20]
    + ["M20a", "M20b", "M20c", "M20d", "M20e", "ST1"]
)


def test_every_operator_is_registered():
    have = {re.match(r"[A-Z]+\d+[a-e]?", n).group(0) for n in QUERIES}
    assert sorted(set(IDS) - have) == [] and set(QUERIES) <= set(entry.queries())


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == entry.entry(spark).columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf, name):
    problems, _ = compare(entry.queries()[name](spark, sf), duck, ORACLES[name])
    assert problems == []
