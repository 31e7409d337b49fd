"""Scale checks on every registered batch query's physical plan: no
Cartesian product or nested-loop join, no window over a single partition."""
import re

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

BATCH = sorted(n for n in E.queries() if not n.startswith("stream_"))


def _plans(df):
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_plan_shape(spark, name):
    plan = _plans(E.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            below = " ".join(lines[i + 1:i + 4])
            assert "SinglePartition" not in below, f"single-partition window in {name}"
