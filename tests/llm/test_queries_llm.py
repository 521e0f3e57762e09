"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from fieldloom.llm.queries import QUERIES, SQL
from tests.llm.helpers import SF_DIR, as_rows, oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got, want = QUERIES[name](spark, SF_DIR).toPandas(), oracle(SQL[name])
    assert len(want) and as_rows(got) == as_rows(want)


@pytest.mark.parametrize("name", ["op3_quality_rules", "op7_license_scan", "op10_chat_format"])
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))


def test_entry_lists_every_operator(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(n.split("_")[0] for n in names if n in QUERIES) == sorted(f"op{n}" for n in range(1, 14))
