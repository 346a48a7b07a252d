"""Pair generation: the registered query runs the whole search, and trials are judged as full measures would judge them."""

import numpy as np
import pytest

from axisloom import queries as core
from axisloom.config import PairConfig
from axisloom.operators.axis import Axis, Term
from axisloom.operators.search import Memo, Packed, accepts, measure

SF = "/root/testdata/sf0.001"


def test_all_pairs_are_generated(spark, monkeypatch):
    """The query leaves the search at its defaults: 50 pairs of ten attempts."""
    ran = []

    class Recorded(core.PairGenerator):
        def generate(self):
            ran.append(self.config)
            return []

    monkeypatch.setattr(core, "PairGenerator", Recorded)
    core.QUERIES["pair_generation_incremental"](spark, SF)
    assert ran == [PairConfig()] and (ran[0].pairs, ran[0].max_attempts) == (50, 10)


@pytest.mark.parametrize("mode", ["1d", "2d"])
def test_judged_as_measured(spark, mode):
    """What is looked at only until it is enough is accepted or refused as what is measured in full; refused ones have full counts."""
    rng = np.random.default_rng(3)
    hole = lambda v: None if v < 0.02 else float("nan") if v < 0.04 else float(v)
    df = spark.createDataFrame([(hole(a), float(b ** 40), float(k % 2)) for k, (a, b) in enumerate(rng.random((4000, 2)))], "a double, b double, c double").repartition(3)
    kinds = ["none", "square", "log", "log_eps", "inverse", "sigmoid", "logit_eps", "sqrt"]
    axis = lambda: Axis(tuple(Term(f, int(rng.choice([-1, 1])), str(rng.choice(kinds))) for f in rng.permutation(["a", "b", "c"])[: rng.integers(1, 4)]))
    pairs = [(axis(), axis()) for _ in range(40)] + [(Axis(), axis()), (Axis(), Axis())]
    memo = Memo()
    full = measure(df, pairs, 12, 1e-10, memo)
    packed = Packed.of(df, ["c", "a", "b"])
    assert measure(packed, pairs, 12, 1e-10) == full
    for ratio in (0.05, 0.2, 0.5):
        judged = measure(packed, pairs, 12, 1e-10, judge=(mode, ratio))
        verdicts = [accepts(m, 12, mode, ratio) for m in full]
        assert [accepts(m, 12, mode, ratio) for m in judged] == verdicts and {True, False} == set(verdicts)
        for m, j, good in zip(full, judged, verdicts, strict=True):
            assert (m.x_bounds, m.y_bounds, m.nonfinite) == (j.x_bounds, j.y_bounds, j.nonfinite)
            assert j.occupied <= m.occupied and (good or m.nonfinite or j == m)
    assert measure(packed, pairs, 12, 1e-10, memo, (mode, 0.05)) == full and not memo.judged[mode, 0.05]
    packed.df.unpersist()
