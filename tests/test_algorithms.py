"""Algorithms and edges that SQL doesn't cover: by hand, by brute force, and by invariants."""

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from axisloom import __main__ as cli
from axisloom import queries as core
from axisloom.config import FUZZ0, PairConfig
from axisloom.functions.geometry import grid_cell, occupancy_cell, resolution
from axisloom.functions.labels import axis_terms, formula, label_lines, path_safe
from axisloom.functions.normal import upper_tail
from axisloom.functions.transforms import TRANSFORMS, clean, transform
from axisloom.operators import stats as S
from axisloom.operators.axis import Axis, Bounds, Term, bounds, invalid_stats, legacy_bounds, many_values, placed, with_placed, with_values
from axisloom.operators.cover import Grid, cover
from axisloom.operators.grid import square_grid
from axisloom.operators.rules import Rect, Rule, first_match, scored
from axisloom.operators.search import PairGenerator, accepts, good_projection, measure, sparse_projection
from axisloom.plans.model import RectangleClassifier, TrainerConfig, train_voter
from axisloom.plans.pairs import generate_pairs
from axisloom.sources.sinks import grid_document
from axisloom.sources import tables
from axisloom.streaming.scoring import grid_stream, score_stream, to_memory

SF = "/root/testdata/sf0.001"
INF = math.inf


def expected(name, x, e=1e-10):
    """The transforms in plain arithmetic; None where there is no value."""
    if x is None or math.isnan(x):
        return None

    def log(v):
        return -INF if v == 0 else math.log(v) if v > 0 else None

    def inverse(v):
        return math.copysign(INF, v) if v == 0 else 1 / v

    def sigmoid(v):
        return 1 / (1 + math.exp(-v)) if v >= 0 else math.exp(v) / (1 + math.exp(v)) if v > -INF else 0.0

    def odds(p):
        return INF if p == 1 else -INF if p == 0 else math.log(p / (1 - p))

    clip = lambda p: max(min(p, 1 - e), e)
    return {
        "none": lambda: x, "square": lambda: x * x, "sqrt": lambda: math.sqrt(max(x, 0)), "log": lambda: log(x), "log_eps": lambda: log(x + e), "inverse": lambda: inverse(x),
        "inverse_eps": lambda: inverse(x + e), "sigmoid": lambda: sigmoid(x), "sigmoid_eps": lambda: clip(sigmoid(x)), "logit": lambda: odds(sigmoid(x)), "logit_eps": lambda: odds(clip(sigmoid(x))),
    }[name]()


def test_transforms_at_edges(spark):
    values = [None, math.nan, -INF, -1.0, -0.0, 0.0, 1e-12, 1.0, 40.0, 700.0, INF]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    rows = {r.i: r for r in df.select("i", *[transform(clean(F.col("x")), n).alias(n) for n in TRANSFORMS]).collect()}
    for i, x in enumerate(values):
        for name in TRANSFORMS:
            want, got = expected(name, x), rows[i][name]
            assert (got is None) == (want is None), (name, x, got, want)
            if want is not None:
                assert got == want or got == pytest.approx(want, rel=1e-9), (name, x, got, want)


def test_axes(spark):
    """Missing terms, unusable bounds and many axes at once, against plain sums."""
    rows = [(1.0, 2.0, 4.0), (None, 3.0, 9.0), (None, None, -1.0), (math.nan, None, None), (5.0, INF, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    axis = Axis((Term("a"), Term("b", -1), Term("c", 1, "sqrt")))
    got = with_values(df, {"p": axis}).collect()

    def value(a, b, c):
        own = [v for v in (expected("none", a), None if expected("none", b) is None else -b, expected("sqrt", c)) if v is not None]
        return (sum(own) * 3 / len(own) if own else None), len(own)

    for r in got:
        want, valid = value(*(None if x is None or math.isnan(x) else x for x in (r.a, r.b, r.c)))
        assert r.p_valid == valid and r.p == (want if want is None else pytest.approx(want))
    many = {}
    for r in many_values(df, [(axis, Axis((Term("b"),))), (Axis((Term("c"),)), axis)]).collect():
        many.setdefault(r.row, []).append((r.v0, r.v1))
    key = lambda x: str(x)
    assert sorted([v for v, _ in many[0]], key=key) == sorted([r.p for r in got], key=key) == sorted([v for _, v in many[1]], key=key)
    assert invalid_stats(df, axis).first() == (5, 1, 2)
    # infinite bounds can't place anything
    assert {r.x for r in placed(df, axis, axis).collect()} == {0.0}
    assert bounds(df.limit(0), [axis]) == [Bounds(0.0, 0.0)]
    c = Axis((Term("c"),))
    low, high = bounds(df, [c])[0].low, bounds(df, [c])[0].high
    assert (low, high) == (pytest.approx(-1 - 1e-4), pytest.approx(9 + 1e-4))
    assert [r.x for r in with_placed(df, {"x": (c, bounds(df, [c])[0])}).collect()][3] == 0.0
    one = spark.createDataFrame([(7.0,)] * 3, "c double")
    assert bounds(one, [c])[0] == Bounds(7 - 1e-5, 7 + 1e-5)
    old = legacy_bounds(df, [c])[0]  # a missing value counts as 0 there
    assert old.low == pytest.approx(-1 - 1e-4) and old.high == pytest.approx(9 + 1e-5 * (10 + 1e-4), abs=1e-9)
    assert axis.add("d").drop_last() == axis


def test_partitions_do_not_matter(spark):
    rows = core._lines(spark, SF).select(*core.FEATURES, "cls")
    grids = [sorted(square_grid(placed(rows.repartition(k), core.X, core.Y), core.N, core.CLASSES).select("ix", "iy", "count").collect()) for k in (1, 4, 17)]
    assert grids[0] == grids[1] == grids[2] and sum(r["count"] for r in grids[0]) == rows.count()


def test_cells(spark):
    df = spark.createDataFrame([(v,) for v in (None, math.nan, -1.0, 0.0, 0.5, 1.0, 9.0)], "x double")
    got = df.select(grid_cell(F.col("x"), 10).alias("g"), occupancy_cell(F.col("x"), 10).alias("o")).collect()
    assert [(r.g, r.o) for r in got] == [(None, None), (None, None), (0, 0), (0, 0), (4, 5), (9, 9), (9, 9)]
    assert (resolution(0), resolution(2), resolution(600_000)) == (10, 10, 38)


def brute_cover(t, c, purity, ratio, min_rows=1):
    """The greedy cover, cell by cell."""
    n, covered, out = len(t), set(), []
    for _ in range(10):
        best = None
        for i in range(n):
            for j in range(n):
                if not c[i][j] or (i, j) in covered or t[i][j] < purity * c[i][j]:
                    continue
                box, rows, rest, grew = [i, i, j, j], t[i][j], c[i][j] - t[i][j], True
                odds = (rows + 1) / (rest + 1)
                while grew:
                    grew = False
                    for side in range(4):
                        i1, i2, j1, j2 = box
                        strip = [[(k, j2 + 1) for k in range(i1, i2 + 1)], [(i2 + 1, k) for k in range(j1, j2 + 1)], [(k, j1 - 1) for k in range(i1, i2 + 1)], [(i1 - 1, k) for k in range(j1, j2 + 1)]][side]
                        if any(not (0 <= a < n and 0 <= b < n) for a, b in strip):
                            continue
                        nt, no, ok = rows, rest, True
                        for a, b in strip:
                            nt, no = nt + t[a][b], no + c[a][b] - t[a][b]
                            ok &= (nt > c[a][b] and no <= 10) if ratio is None else (t[a][b] > 0 and no <= max(10, int((nt + no) * ratio)))
                        if not ok or (nt + 1) / (no + 1) < odds:
                            continue
                        odds, rows, rest, grew = (nt + 1) / (no + 1), nt, no, True
                        box[[3, 1, 2, 0][side]] += [1, 1, -1, -1][side]
                if box[0] == box[1] and box[2] == box[3]:
                    rows = 0
                if best is None or rows > best[0]:
                    best = rows, tuple(box)
        if best is None or best[0] < max(1, min_rows):
            break
        i1, i2, j1, j2 = best[1]
        covered |= {(a, b) for a in range(i1, i2 + 1) for b in range(j1, j2 + 1)}
        out.append(best[1])
    return out, sum(t[a][b] for a, b in covered)


@pytest.mark.parametrize(("ratio", "seed"), [(None, 1), (None, 2), (0.05, 3), (0.001, 4)])
def test_cover(ratio, seed):
    rng = np.random.RandomState(seed)
    c = rng.poisson(3, (9, 9))
    t = np.where(rng.random_sample((9, 9)) < 0.7, c, c // 2)
    rects, rows = cover(Grid(t, c), 1, 0.75, ratio)
    want, total = brute_cover(t.tolist(), c.tolist(), 0.75, ratio)
    assert [(q.left, q.bottom, q.width, q.height) for q in rects] == [pytest.approx((i1 / 9, j1 / 9, (i2 + 1 - i1) / 9, (j2 + 1 - j1) / 9)) for i1, i2, j1, j2 in want]
    assert rows == total and rects


@pytest.mark.parametrize("name", ["rectangle_cover", "rectangle_cover_enhanced"])
def test_cover_query(spark, name):
    rows = core.QUERIES[name](spark, SF).collect()
    at = placed(core._rich(spark, SF), Axis((Term("a"), Term("b"))), Axis((Term("a"), Term("b", -1))))
    t, c = np.zeros((core.N, core.N), dtype=int), np.zeros((core.N, core.N), dtype=int)
    for r in at.select("cls", grid_cell(F.col("x"), core.N).alias("i"), grid_cell(F.col("y"), core.N).alias("j")).collect():
        c[r.i, r.j] += 1
        t[r.i, r.j] += r.cls == 1
    want, total = brute_cover(t.tolist(), c.tolist(), 0.75, None if name == "rectangle_cover" else 0.001)
    assert [(round(r.left * core.N), round(r.bottom * core.N)) for r in rows] == [(b[0], b[2]) for b in want]
    assert rows and rows[0].covered == total


def test_measure(spark):
    """Bounds and occupancy against NumPy."""
    rng = np.random.RandomState(5)
    data = rng.random_sample((300, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    pairs = [(Axis((Term("a"), Term("b", -1))), Axis((Term("c", 1, "square"),))), (Axis((Term("a"),)), Axis()), (Axis((Term("c", 1, "log"),)), Axis((Term("b"),)))]
    got = measure(df, pairs, 10, 1e-10)

    def cells(v):
        lo, hi = v.min(), v.max()
        lo, hi = lo - 1e-5 * (hi - lo), hi + 1e-5 * (hi - lo)
        return np.clip(((v - lo) / (hi - lo) * 10).astype(int), 0, 9)

    x, y = cells(data[:, 0] - data[:, 1]), cells(data[:, 2] ** 2)
    assert (got[0].occupied_x, got[0].occupied_y, got[0].occupied) == (len(set(x)), len(set(y)), len(set(zip(x, y, strict=True))))
    assert got[1].occupied_y == 1 and not any(m.nonfinite for m in got)
    bad = measure(spark.createDataFrame([(0.0, 1.0), (1.0, 2.0)], "a double, b double"), [(Axis((Term("a", 1, "log"),)), Axis((Term("b"),)))], 10, 1e-10)[0]
    assert bad.nonfinite and not accepts(bad, 10, "2d", 0.0)


@pytest.mark.parametrize("mode", ["1d", "2d"])
def test_pair_generation(spark, mode):
    rows = core._lines(spark, SF).select(*core.FEATURES, "cls").cache()
    names, got = list(core.FEATURES), []
    for config in (PairConfig(pairs=2, max_attempts=2, mode=mode, incremental=False), PairConfig(pairs=1, max_attempts=1, mode=mode, transforms=("none", "log"))):
        runs = [PairGenerator(rows.repartition(k), names, list(range(6)), 12, config).generate() for k in (1, 3)]
        assert [(m.x, m.y, m.occupied) for m in runs[0]] == [(m.x, m.y, m.occupied) for m in runs[1]]
        got += runs[0]
    assert len(got) == 3
    for m in got:
        assert all(t.feature != names[0] or t.sign == 1 for a in (m.x, m.y) for t in a.terms)
        assert len({t.feature for t in m.x.terms}) == len(m.x.terms) <= 4
    assert accepts(got[-1], 12, mode, 0.05)  # grown pairs are valid at each step
    rows.unpersist()


def test_search_is_better_than_one_draw():
    rng = np.random.RandomState(1)
    means = [[0, 0, 5, 1], [1, -1, 0, 1], [2, 3, -4, 1]]
    trace = []
    w, score = sparse_projection(means, 0, [0, 1, 2, 3], rng, trace=trace)
    assert score == max(s for *_, s in trace) == pytest.approx(S.composite_separation(means, 0, w))
    assert len(trace) == 10 and len(w) == 3
    assert S.separation(means, 0) == [1, 1, 5, 0] and S.separating([1, 0, 2]) == [0, 2] and S.separating([0, 0]) == [0, 1]
    assert S.top_features([1, 5, 5], 2) == [1, 2] and S.top_features([1, 5], 9) == [0, 1]
    assert S.top_features([float(k % 7) for k in range(60)], 50) == sorted(range(60), key=lambda j: (-(j % 7), j))[:50]


def test_root_flags(spark):
    rng = np.random.RandomState(2)
    rows = [(float(a), float(math.exp(b)), float(math.exp(b * 0.9)), 1.0) for a, b in zip(rng.normal(size=2000), rng.normal(size=2000), strict=True)]
    df = spark.createDataFrame(rows, "plain double, skewed double, also double, fixed double")
    # the smallest of the p-values is tested against 0, so one of the two skewed ones may stay
    assert {"skewed", "also"} >= set(S.sqrt_features(df, ["plain", "skewed", "also", "fixed"])) != set()
    assert {r.feature for r in core.QUERIES["auto_transform_flags"](spark, SF).collect()} == set(core.FEATURES)
    assert (upper_tail(math.nan), upper_tail(20), upper_tail(-20), upper_tail(0)) == (1.0, 0.0, 1.0, 0.5)
    assert upper_tail(1.96) == pytest.approx(0.025, abs=1e-4)


def blobs(spark, n=600):
    rng = np.random.RandomState(7)
    centres = [(0, 0, 0, 0), (6, 0, 6, 0), (0, 6, 6, 6)]
    rows = [(i, *map(float, rng.normal(centres[i % 3], 0.7)), "abc"[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, f0 double, f1 double, f2 double, f3 double, label string")


def test_classifier_on_blobs(spark):
    df = blobs(spark)
    model = RectangleClassifier(3, 1, TrainerConfig(pairs=5, covered_pairs=2, max_rules=9)).fit(df, ["f0", "f1", "f2", "f3"], "label")
    assert all(v.rules for v in model.voters) and {r.cls for v in model.voters for r in v.rules} == {0, 1, 2}
    twice = df.union(df.limit(5))  # repeated keys are rows of their own
    got = model.transform(twice, "id").collect()
    truth = {r.id: r.label for r in df.collect()}
    assert len(got) == 605 and np.mean([truth[r.id] == r.label_pred for r in got]) > 0.9
    again = RectangleClassifier.from_json(model.to_json()).transform(df, "id")
    assert sorted(again.collect()) == sorted(model.transform(df, "id").collect())
    # the vote by hand
    votes = {}
    for v in model.voters:
        for r in v.transform(df).select("id", "pred", "weight").collect():
            votes.setdefault(r.id, [0.0] * 3)[r.pred] += r.weight
    assert {r.id: r.cls_pred for r in model.transform(df, "id").collect()} == {k: w.index(max(w)) for k, w in votes.items()}
    model.voters[1].rules = []
    assert {r.cls_pred for r in model.transform(df, "id").collect()} == {0}


def test_good_projection():
    """Signs that separate the target best are found; the order is kept when there are enough candidates."""
    means = [[1.0, -1.0, 1.0, -1.0], [-1.0, 1.0, -1.0, 1.0], [0.0, 0.0, 0.0, 0.0]]
    rng = np.random.RandomState(0)
    w, score = good_projection(means, 0, [0, 1, 2, 3], rng)
    assert score == pytest.approx(1.0) and len({s * means[0][j] for j, s in w}) == 1
    assert {tuple(sorted(j for j, _ in good_projection(means, 0, [3, 1, 2, 0], rng, limit=4)[0])) for _ in range(20)} <= {(3,), (1, 3), (1, 2, 3)}
    assert good_projection(means, 0, [2], rng)[0] == [(2, 1)] or good_projection(means, 0, [2], rng)[0] == [(2, -1)]


def test_trainer_rules_by_hand(spark):
    """One feature: a rule for each of two classes, with the bounds of all rows whichever are open."""
    values = [(x / 10, 0) for x in range(60)] + [(20 + x / 10, 1) for x in range(60)]
    df = spark.createDataFrame(values, "f double, cls int")
    voter = train_voter(df, ["f"], 2, np.random.RandomState(1), TrainerConfig(pairs=2, covered_pairs=1))
    assert [r.cls for r in voter.rules] == [0, 1]
    seen = [r.f for r in voter.prepared(df).collect()]
    for r in voter.rules:
        (term,) = r.x.terms
        lo, hi = sorted((-1.0 if term.sign < 0 else 1.0) * x for x in (min(seen), max(seen)))
        low = lo - FUZZ0 * (hi - lo)
        assert (r.x_bounds.low, r.x_bounds.high) == pytest.approx((low, hi + FUZZ0 * (hi - low)), abs=1e-12)
    got = [(r.f, r.cls, r.pred) for r in voter.transform(df).collect()]
    assert len(got) == 120 and all(c == p for _, c, p in got)
    # no rule where each would hold too few rows; the least number falls to 1 and no further
    few = train_voter(df.limit(1), ["f"], 2, np.random.RandomState(1), TrainerConfig(pairs=2, covered_pairs=1))
    assert few.rules == [] and train_voter(df.limit(0), ["f"], 2, np.random.RandomState(1)).rules == []


def test_trainer_without_a_cap_on_rules(spark):
    """Interleaved stripes need many rules: training goes on until no turn of two rounds gives one."""
    values = [(i, (x + 0.5) / 12 + 0.004 * (i % 5), float(i % 7), x % 2) for i, x in enumerate(range(12)) for _ in range(30)]
    df = spark.createDataFrame([(float(x), float(y), c) for _, x, y, c in values], "a double, b double, cls int")
    voter = train_voter(df, ["a", "b"], 2, np.random.RandomState(3), TrainerConfig(pairs=3, covered_pairs=2))
    got = voter.transform(df).collect()
    assert np.mean([r.cls == r.pred for r in got]) > 0.9
    capped = train_voter(df, ["a", "b"], 2, np.random.RandomState(3), TrainerConfig(pairs=3, covered_pairs=2, max_rules=1))
    assert capped.rules == voter.rules[:1]


def test_trainer_queries(spark):
    fit, predicted = core.QUERIES["trainer_fit"](spark, SF).collect(), core.QUERIES["model_predict"](spark, SF).collect()
    rich = {r.id: r.cls for r in core._rich(spark, SF).collect()}
    assert {r.voter for r in fit} == {0, 1, 2} and all(r.rects > 0 for r in fit)
    assert len(predicted) == len(rich) and np.mean([rich[r.id] == r.cls_pred for r in predicted]) > 0.8


def test_first_match(spark):
    rng = np.random.RandomState(3)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random_sample((200, 2)) * 1.4 - 0.2)] + [(900, 0.5, 0.5), (901, 0.25, 0.1)]
    rects = [(k, *map(float, r)) for k, r in enumerate(rng.random_sample((60, 4)) * [0.9, 0.9, 0.3, 0.3])] + [(99, 0.25, 0.0, 0.25, 0.5)]
    got = first_match(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(rects, "rule int, left double, bottom double, width double, height double"))
    want = {i: next((k for k, a, b, w, h in sorted(rects) if a <= x < a + w and b <= y < b + h), None) for i, x, y in points}
    assert {r.id: r.rule for r in got.collect()} == want and any(v is not None for v in want.values())


def test_sources(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b,group,kind\n1.5,,3,x\nnan, 2 ,,y\n")
    got = tables.read_csv(spark, str(tmp_path / "in.csv"), ["a", "b"], "group", "kind").collect()
    assert [tuple(r) for r in got] == [(1.5, None, 3, "x"), (None, 2.0, None, "y")]
    (tmp_path / "bad.csv").write_text("a\n1.5\nfoo\n")
    with pytest.raises(PySparkException):
        tables.read_csv(spark, str(tmp_path / "bad.csv"), ["a"]).collect()
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.read_csv(spark, str(tmp_path / "in.csv"), ["a", "z"])
    (tmp_path / "map.json").write_text(json.dumps({"x": 3, "y": 4}))
    ids = tables.read_dictionary(spark, str(tmp_path / "map.json"))
    assert {tuple(r) for r in ids.collect()} == {("x", 3), ("y", 4)}
    (tmp_path / "colour.json").write_text(json.dumps({"x": "blue"}))
    coloured = tables.with_colours(ids, tables.read_dictionary(spark, str(tmp_path / "colour.json"), "string"))
    assert {(r.name, r.colour) for r in coloured.collect()} == {("x", "blue"), ("y", "red")}
    assert tables.from_rows(spark, [[1, 2, 0], [3, 4, None]], ["a", "b"]).collect() == [(1.0, 2.0, 0), (3.0, 4.0, None)]
    demo = tables.demo_table(spark)
    assert demo.count() == 100 and sorted(demo.collect()) == sorted(tables.demo_table(spark).collect())


def test_run_and_command_line(spark, tmp_path):
    df = blobs(spark, 90)
    out = str(tmp_path / "run")
    found = generate_pairs(df, ["f0", "f1", "f2", "f3"], "label", "b", PairConfig(pairs=2, incremental=False, export_points=True), out)
    assert len(found) == 2
    config = json.loads((tmp_path / "run" / "config.json").read_text())
    assert config["n_bins"] == resolution(90) and config["target"] == "b"
    docs = [json.loads(p.read_text()) for p in sorted((tmp_path / "run").glob("pair_*.json"))]
    assert len(docs) == 2 and all(sum(d["bin_counts"]) == 90 and d["target_class_name"] == "b" for d in docs)
    for d in docs:
        cells = len(d["bin_counts"])
        assert all(len(d[k]) == cells for k in ("bin_center_x", "bin_center_y", "dominant_class_id", "dominant_class_name", "target_class_purity", "class_percentages"))
        assert all(sum(v["percentage"] for v in m.values()) == pytest.approx(100) for m in d["class_percentages"])
        assert d["best_purity_P"] == sum(n for n, p in zip(d["bin_counts"], d["target_class_purity"], strict=True) if p == 1)
    assert spark.read.json(str(tmp_path / "run" / "points" / "pair_00")).count() == 90
    assert "pure cells" in (tmp_path / "run" / "report.txt").read_text()
    one = [grid_document(r.grid, resolution(90), 1, ["a", "b", "c"], [0, 1, 2], r.measured.x, r.measured.y, r.pure, ["f0", "f1", "f2", "f3"]) for r in found]
    assert docs == [json.loads(json.dumps(d)) for d in one]
    assert json.loads((tmp_path / "run" / "summary.json").read_text())["pairs"] == 2
    with pytest.raises(ValueError, match="does not occur"):
        generate_pairs(df, ["f0"], "label", "nobody")
    with pytest.raises(ValueError, match="missing columns"):
        generate_pairs(df, ["f0", "zz"], "label", "b")
    df.select("f0", "f1", F.col("label").alias("attack")).coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    (tmp_path / "map.json").write_text(json.dumps({"a": 10, "b": 20, "c": 30}))
    args = [str(tmp_path / "in"), "--features", "f0,f1", "--mapping", str(tmp_path / "map.json"), "--target", "20", "--out", str(tmp_path / "cli"), "--pairs", "1", "--final", "--max-attempts", "2"]
    assert cli.main(args) == 1 and list((tmp_path / "cli").glob("pair_00_pure_count_*.json"))
    (tmp_path / "map2.json").write_text(json.dumps({"a": 10}))
    with pytest.raises(ValueError, match="b, c"):
        cli.main([x.replace("map.json", "map2.json") for x in args])


def test_streams(spark, tmp_path):
    rows = core._lines(spark, SF).select(*core.FEATURES, "cls")
    bx, by = bounds(rows, [core.X, core.Y])
    rules = [Rule(i, core.X, core.Y, bx, by, (q,)) for i, q in enumerate(core._RECTS)]
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = to_memory(score_stream(stream(), rules), "scored", checkpoint=str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("scored").groupBy("pred", "weight").count().collect()) == sorted(scored(rows, rules).groupBy("pred", "weight").count().collect())
    q = to_memory(grid_stream(stream(), core.X, core.Y, bx, by, core.N), "cells", "complete", str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    at = with_placed(rows, {"x": (core.X, bx), "y": (core.Y, by)})
    want = at.groupBy(grid_cell(F.col("x"), core.N).alias("ix"), grid_cell(F.col("y"), core.N).alias("iy"), "cls").count()
    assert sorted(spark.table("cells").collect()) == sorted(want.collect())


def test_text():
    axis = Axis((Term("size", 1, "log"), Term("count", -1)))
    assert axis_terms(axis) == ["+log(size)", "-count"] and formula(axis) == "+log(size)-none(count)"
    assert label_lines("DoS (a, b)") == ["DoS", "a", "b"] and label_lines(" plain ") == ["plain"]
    assert path_safe("a b/c(d, e)") == "a_b_cd_e" and path_safe(" (x)") == "_x"


def test_nearest_rule(spark):
    rules = [Rule(2, Axis((Term("a"),)), Axis((Term("b"),)), Bounds(0, 1), Bounds(0, 1), (Rect(0.0, 0.0, 0.2, 0.2),)), Rule(1, Axis((Term("a"),)), Axis((Term("b"),)), Bounds(0, 1), Bounds(0, 1), (Rect(0.6, 0.0, 0.2, 0.2),))]
    rows = [(0.1, 0.1), (0.2, 0.1), (0.38, 0.1), (0.59, 0.1), (0.7, 0.1), (2.0, 0.1)]
    got = scored(spark.createDataFrame(rows, "a double, b double"), rules).collect()
    assert [(r.pred, r.weight) for r in got] == [(2, 10.0), (2, 3.0), (2, 3.0), (1, 3.0), (1, 10.0), (1, 3.0)]
