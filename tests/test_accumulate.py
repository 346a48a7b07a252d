"""An axis over stored sums against recomputation."""

import numpy as np
import pytest

from axisloom.operators.accumulate import AxisAccumulator
from axisloom.operators.axis import Axis, Term, with_values


def test_add_rollback_add(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *[None if v < 0.1 else float("nan") if v < 0.15 else float(v * 9 - 4) for v in rng.random(3)]) for i in range(500)] + [(500, None, None, None), (501, -0.0, 0.0, float("inf"))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    acc = AxisAccumulator(df, "id", ["a", "b", "c"], buckets=4)
    try:
        assert acc.values().filter("value is not null").count() == 0

        def same():
            want = {r.id: (r.v, r.v_valid) for r in with_values(df, {"v": acc.axis}).select("id", "v", "v_valid").collect()}
            got = {r.id: (r.value, r.valid) for r in acc.values().collect()}
            assert got == want and len(got) == 502

        acc.add(Term("a", -1, "log"))
        same()
        acc.add(Term("b")).add(Term("c", 1, "square"))
        same()
        acc.rollback(2)
        assert acc.axis == Axis((Term("a", -1, "log"),))
        same()
        acc.add(Term("c", -1, "inverse")).add(Term("a", 1, "square"))
        same()
        plan = acc.step(Term("b", 1, "sqrt"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan  # bucket by bucket
        assert "ReadSchema: struct<id:bigint,b:double>" in plan  # one feature
        with pytest.raises(ValueError, match="9 of 3"):
            acc.rollback(9)
    finally:
        acc.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("axisloom_")]
