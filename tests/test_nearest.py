"""Nearest rules by cells: what goes where, and results against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.operators import rules
from axisloom.operators.rules import nearest_rule

COLUMNS = "rule int, left double, bottom double, width double, height double"


def shuffled(spark, run) -> int:
    """The shuffle records that the jobs of run() write."""
    sc = spark.sparkContext
    sc.setJobGroup("shuffled", "")
    before = set(sc.statusTracker().getJobIdsForGroup("shuffled"))
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jobs = set(sc.statusTracker().getJobIdsForGroup("shuffled")) - before
    store, written = sc._jsc.sc().statusStore(), 0
    for stage in {k for j in jobs for k in sc.statusTracker().getJobInfo(j).stageIds}:
        found = store.taskList(stage, 0, 10_000)
        tasks = [found.apply(i) for i in range(found.size())]
        written += sum(t.taskMetrics().get().shuffleWriteMetrics().recordsWritten() for t in tasks if t.taskMetrics().isDefined())
    return written


def expected(points, rects):
    """(rule, inside, distance) of each point by brute force, for rectangles in the order of rules."""
    rule, l, b, w, h = (np.array(c) for c in zip(*sorted(rects), strict=True))  # noqa: E741
    out = []
    for x, y in points:
        holds = (x >= l) & (x < l + w) & (y >= b) & (y < b + h)
        away = np.where(holds, -1.0, np.maximum.reduce([l - x, x - (l + w), b - y, y - (b + h), np.zeros(len(l))]))
        out.append((int(rule[away.argmin()]), bool(holds.any()), max(float(away.min()), 0.0)))
    return out


def test_rectangles_go_to_cells_where_they_can_win(spark):
    """Points move once and rectangles to few cells, not to all cells around them."""
    rng = np.random.default_rng(2)
    n = 6000
    rects = [(k, *map(float, v)) for k, v in enumerate(np.hstack([rng.random((n, 2)), rng.random((n, 2)) * 0.02]))]
    points = [tuple(map(float, p)) for p in rng.random((500, 2))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, x double, y double")
    table = spark.createDataFrame(rects, COLUMNS)
    got = []
    # rectangles are dealt evenly, twice, and then to cells
    assert shuffled(spark, lambda: got.extend(nearest_rule(df, table).collect())) < 2 * n + 4 * n + 3 * len(points)
    assert [(r.rule, r.inside, r.distance) for r in sorted(got)] == expected(points, rects)


@pytest.mark.parametrize("limit", [1, 40])
def test_crowded_cells_and_far_points(spark, monkeypatch, limit):
    """A cell's points in many tasks, points that repeat and such far from all rectangles, sides on points, wide and endless rectangles, in a plane of
    unequal sides."""
    monkeypatch.setattr(rules, "CELL_POINTS", limit)
    rng = np.random.default_rng(limit)
    spots = np.vstack([rng.random((150, 2)).round(2) * [0.1, 100], rng.random((20, 2)) * [5, 4000] - [2, 1500], [[0.05, 50.0]] * 30])
    points = [tuple(map(float, p)) for p in spots]
    corner = rng.random((400, 4)).round(2) * [0.1, 100, 0.01, 10]
    rects = [(int(k % 150) + 3, *map(float, v)) for k, v in enumerate(corner)] + [(900, -1.0, -1000.0, 0.5, 5000.0), (2, 3.0, 2000.0, float("inf"), 1.0), (1, 4.0, -1500.0, 0.0, 0.0)]
    odd = [(0, float("inf"), 0.0, 1.0, 1.0), (0, float("nan"), 0.0, 1.0, 1.0), (0, 0.0, 0.0, float("nan"), 1.0), (0, 0.0, float("-inf"), 1.0, 1.0), (0, 0.0, 0.0, 1.0, -1.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(1000, None, 1.0), (1001, float("nan"), 1.0), (1002, 1.0, float("inf"))], "id int, x double, y double")
    df = df.withColumn("more", F.struct("id", F.lit("k").alias("k"))).repartition(3)
    got = sorted((r.id, r.more.id, r.rule, r.inside, r.distance) for r in nearest_rule(df, spark.createDataFrame(rects + odd, COLUMNS)).filter("id < 1000").collect())
    assert got == [(i, i, *v) for i, v in enumerate(expected(points, rects))]
    assert {(r.id, r.rule, r.inside) for r in nearest_rule(df, spark.createDataFrame(rects, COLUMNS)).filter("id >= 1000").collect()} == {(i, None, None) for i in (1000, 1001, 1002)}
