"""Bounds and occupancy of many axis pairs by passes that write no row out for each of them."""

import numpy as np
import pytest

from axisloom.operators.axis import Axis, Term, bounds, placed_pairs
from axisloom.operators.grid import occupancy_states, occupied_cells
from axisloom.operators.search import measure


def test_measures_equal_grids_and_read_a_row_once(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(None if v < 0.05 else float("nan") if v < 0.08 else float(v * 20 - 3) for v in rng.random(4)) for _ in range(3000)]
    df = spark.createDataFrame([*rows, (None,) * 4, (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double").repartition(5)
    kinds = ["none", "square", "sqrt", "log", "log_eps", "inverse", "inverse_eps", "sigmoid", "sigmoid_eps", "logit", "logit_eps"]
    axis = lambda: Axis(tuple(Term(f, int(rng.choice([-1, 1])), str(rng.choice(kinds))) for f in rng.permutation(list("abcd"))[: rng.integers(1, 5)]))
    pairs = [(axis(), axis()) for _ in range(25)] + [(Axis(), axis()), (axis(), Axis())]
    found = measure(df, pairs, 20, 1e-10)
    flat = bounds(df, [a for p in pairs for a in p])
    at = [(flat[2 * i], flat[2 * i + 1]) for i in range(len(pairs))]
    ends = lambda bs: [v for b in bs for v in (b.low, b.high)]
    assert ends(b for m in found for b in (m.x_bounds, m.y_bounds)) == pytest.approx(ends(flat), rel=1e-12)
    cells = {r.pair: (r.occupied_x, r.occupied_y, r.occupied) for r in occupied_cells(occupancy_states(placed_pairs(df, pairs, at, ()), 20, keys=("pair",)), ("pair",)).collect()}
    assert {i: (m.occupied_x, m.occupied_y, m.occupied) for i, m in enumerate(found)} == cells


def test_measuring_explodes_no_rows(spark, monkeypatch):
    from axisloom.operators import axis as module

    def none(*args, **kwargs):
        raise AssertionError("a row for each axis")

    monkeypatch.setattr(module, "many_values", none)
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "a double, b double")
    m = measure(df, [(Axis((Term("a"),)), Axis((Term("b"),)))], 10, 1e-10)[0]
    assert (m.occupied_x, m.occupied_y, m.occupied) == (2, 2, 2)
