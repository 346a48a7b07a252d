"""Rules as data and rectangles as a table against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axisloom.operators.axis import Axis, Bounds, Term
from axisloom.operators.rules import Rect, Rule, _part_lists, nearest_rule, scored, scored_rows
from axisloom.plans.model import RectangleClassifier, Voter


def rules_of(rng, n, rects, features):
    out = []
    for _ in range(n):
        axis = lambda: Axis(tuple(Term(f, int(rng.choice([-1, 1])), str(rng.choice(["none", "square", "sqrt", "log"]))) for f in rng.permutation(features)[: rng.integers(1, len(features) + 1)]))
        own = tuple(Rect(*(float(v) for v in (*rng.random(2), *(rng.random(2) * 0.1)))) for _ in range(rects))
        out.append(Rule(int(rng.integers(0, 3)), axis(), axis(), Bounds(-2.0, 3.0), Bounds(-1.0, 2.5), own))
    return out


def data(spark, rng, n):
    rows = [(i, *[None if v < 0.05 else float("nan") if v < 0.08 else float(v) for v in rng.random(3)]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None, None), (n + 1, -0.5, float("inf"), 0.0)], "id long, a double, b double, c double")


def test_rows_equal_inlined_rules(spark):
    rng = np.random.default_rng(5)
    df = data(spark, rng, 700)
    lists = [rules_of(rng, 3, 2, ["a", "b", "c"]), rules_of(rng, 1, 1, ["b"]), [Rule(2, Axis(), Axis((Term("a"),)), Bounds(0.0, 0.0), Bounds(0.0, 1.0), (Rect(0.2, 0.1, 0.1, 0.5),))], []]
    packed = df.select("id", *[F.struct("a", "b", "c").alias(f"__f{i}") for i in range(len(lists))])
    got = {r.id: [(v.pred, v.weight) for v in r.votes] for r in scored_rows(packed, lists, ["id"]).collect()}
    for i, rules in enumerate(lists):
        for r in scored(df, rules).select("id", "pred", "weight").collect():
            assert got[r.id][i] == (r.pred, r.weight)


def test_classifier_at_its_defaults(spark):
    """Seven voters of 40 rules of 10 rectangles: one pass, and the class of the most weight."""
    rng = np.random.default_rng(6)
    df = data(spark, rng, 3000)
    model = RectangleClassifier()
    model.labels = ["u", "v", "w"]
    model.voters = [Voter(["a", "b", "c"], ["b"], {f: (0.0, 1.0) for f in "abc"}, rules_of(rng, 40, 10, ["a", "b", "c"])) for _ in range(7)]
    out = model.transform(df, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(plan) < 50_000
    got = {r.id: r.cls_pred for r in out.collect()}
    weight = np.zeros((len(got), 3))
    v = model.voters[1]  # its first matches by inlined parts of its rules
    rows = v.prepared(df).select("id", *[F.struct("a", "b", "c").alias("__f0")])
    one = {r.id: (r.votes[0].pred, r.votes[0].weight) for r in scored_rows(rows, [v.rules], ["id"]).collect()}
    few = {}
    for k in range(0, 40, 5):
        for r in scored(v.prepared(df), v.rules[k : k + 5]).select("id", "pred", "weight").collect():
            if r.weight == 10.0:
                few.setdefault(r.id, r.pred)
    assert all(one[i] == (c, 10.0) for i, c in few.items()) and all(one[i][1] == 3.0 for i in one if i not in few)
    for v in model.voters:
        packed = v.prepared(df).select("id", F.struct("a", "b", "c").alias("__f0"))
        for r in scored_rows(packed, [v.rules], ["id"]).collect():
            weight[r.id, r.votes[0].pred] += r.votes[0].weight
    assert got == {i: int(weight[i].argmax()) for i in range(len(weight))}


@pytest.mark.parametrize(("n", "spread", "side"), [(1, 1.0, 32), (40, 1.0, 4), (300, 0.05, 32), (500, 3.0, 8)])
def test_nearest_rule(spark, n, spread, side):
    rng = np.random.default_rng(n)
    rects = [(int(k // 2), *(float(v) for v in (*(rng.random(2).round(2) * spread), *(rng.random(2).round(2) * rng.choice([0.02, 0.3]))))) for k in range(n)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate((rng.random((400, 2)) * 2 - 0.5).round(2))] + [(7, 0.5, 0.5), (7, 0.5, 0.5)]
    odd = [(1000, None, 0.1), (1001, float("nan"), 0.1), (1002, 0.1, float("inf"))]
    table = spark.createDataFrame([*rects, (0, 0.0, 0.0, -1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0), (3, None, 0.0, 1.0, 1.0)], "rule int, left double, bottom double, width double, height double")
    df = spark.createDataFrame(points + odd, "id long, x double, y double").withColumn("l", F.lit("clash"))
    got = sorted((r.id, r.x, r.y, r.rule, r.inside, r.distance) for r in nearest_rule(df, table, side=side).filter("id < 1000").collect())
    expected = []
    for i, x, y in points:
        holds = [k for k, a, b, w, h in rects if a <= x < a + w and b <= y < b + h]
        away = min((max(a - x, x - (a + w), b - y, y - (b + h), 0.0), k) for k, a, b, w, h in rects)
        expected.append((i, x, y, min(holds), True, 0.0) if holds else (i, x, y, away[1], False, away[0]))
    assert got == sorted(expected)
    assert {(r.id, r.rule, r.distance) for r in nearest_rule(df, table).filter("id >= 1000").collect()} == {(k, None, None) for k in (1000, 1001, 1002)}
    assert nearest_rule(df, table.limit(0)).filter("rule is null").count() == len(points) + 3 and nearest_rule(df.limit(0), table).count() == 0


def test_lists_stay_short(spark):
    """Where hundreds of rectangles hold a point, and beside columns of them, the lists that points meet stay short; the results are those of
    brute force."""
    rng = np.random.default_rng(9)
    n = 6000
    left = rng.integers(0, 10, n) / 10
    rects = np.stack([left, left + (left * 10 % 4) / 40, low := rng.random(n).round(3), low + rng.integers(0, 9, n) / 50])
    table = pa.table({"cell": pa.array([0] * n, pa.int32()), "parts": pa.array([16] * n, pa.int32()), "rule": np.arange(n), **dict(zip("lrbt", rects, strict=True))})
    lists = _part_lists(table, 1, [0.0, 0.0], [1.0, 1.0])
    sizes = np.array([len(v) for v in lists["rules"].to_pylist()])
    assert len(sizes) == 256 and sizes.min() > 0 and sizes.mean() < 25
    side = spark.createDataFrame([(k, float(q[0]), float(q[2]), float(q[1] - q[0]), float(q[3] - q[2])) for k, q in enumerate(rects.T)], "rule int, left double, bottom double, width double, height double")
    points = rng.random((1500, 2)).round(3) * 1.2 - 0.1
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    found = nearest_rule(df, side, side=4)
    assert "transform(" not in found._jdf.queryExecution().executedPlan().toString()
    l, r, b, t = rects[0], rects[0] + (rects[1] - rects[0]), rects[2], rects[2] + (rects[3] - rects[2])  # noqa: E741
    for q in found.collect():
        holds = (q.x >= l) & (q.x < r) & (q.y >= b) & (q.y < t)
        away = np.where(holds, -1.0, np.maximum.reduce([l - q.x, q.x - r, b - q.y, q.y - t, np.zeros(n)]))
        assert (q.rule, q.inside, q.distance) == (int(away.argmin()), bool(holds.any()), max(away.min(), 0.0))
