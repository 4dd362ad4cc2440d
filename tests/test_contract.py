"""The driver's contract: names agree, and queries run on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_entry_and_plans(spark):
    assert entry.entry(spark).count() >= 0
    for name in ("causal_score", "retrieval_ledger", "merge_securities", "fk_violations"):
        df = registry.QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and df.count() >= 0
