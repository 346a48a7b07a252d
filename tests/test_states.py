"""States that merge, attempts that grow together, functions of the catalogue and the estimator."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from axisloom import queries as core
from axisloom.config import FUZZ0, PairConfig
from axisloom.functions import catalogue
from axisloom.functions.geometry import grid_cell, rect_distance
from axisloom.functions.transforms import TRANSFORMS, clean, transform
from axisloom.operators.axis import Axis, Bounds, Term
from axisloom.operators.grid import merged_occupancy, occupancy_states, occupied_cells
from axisloom.operators.metrics import silhouettes
from axisloom.operators.moments import STATE, finished_moments, merged_moments, moment_states
from axisloom.operators.search import Measured, Memo, PairGenerator, accepts, measure
from axisloom.operators.stats import moments
from axisloom.plans.estimator import RectangleEstimator, RectangleModel
from axisloom.sources.sinks import grid_document
from axisloom.streaming.grid_store import GridStore

SF = "/root/testdata/sf0.001"


def test_moments_of_slices(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k % 5), float(v), None if k % 7 == 0 else float(v * v), 2.0) for k, v in enumerate(rng.normal(size=400) * 3 + 100)]
    rows += [(8, None, float("nan"), 2.0), (9, float("inf"), 1.0, 2.0), (None, 4.0, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "slice int, a double, b double, c double")
    names = ["a", "b", "c"]
    states = moment_states(df, names, ("slice",))
    whole = {r.feature: r for r in moments(df, names).collect()}
    halves = merged_moments(states.filter("slice < 2")).union(merged_moments(states.filter("slice >= 2 or slice is null")))
    for merged in (merged_moments(states), merged_moments(halves), moment_states(df, names)):
        for r in finished_moments(merged).collect():
            for f in ("n", "mean", "variance", "sd", "skewness", "kurtosis"):
                want = whole[r.feature][f]
                assert (r[f] is None) == (want is None) and (want is None or r[f] == pytest.approx(want, rel=1e-9)), (r.feature, f)
    assert {r.slice: r.n for r in merged_moments(states, ("slice",)).filter("feature = 'a'").collect()} == {**{k: 80 for k in range(5)}, 8: 0, 9: 0, None: 1}
    assert merged_moments(states.limit(0)).count() == 0 and states.columns == ["slice", "feature", *STATE]


def test_occupancy_of_halves(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k % 3), float(x), float(y)) for k, (x, y) in enumerate(rng.random((500, 2)) * 1.2 - 0.1)] + [(0, None, 0.5), (1, float("nan"), float("nan"))]
    df = spark.createDataFrame(rows, "key int, x double, y double")
    for n in (7, 20, 300):  # 90,000 cells are in three buckets
        cell = lambda v, n=n: None if v is None or math.isnan(v) else int(min(max(v * n, 0), n - 1))
        halves = [occupancy_states(df.filter(w), n, keys=("key",)) for w in ("x < 0.4", "not x < 0.4 or x is null")]
        merged = merged_occupancy(halves[0].union(halves[1]), ("key",))
        got = {r.key: (r.occupied_x, r.occupied_y, r.occupied) for r in occupied_cells(merged, ("key",)).collect()}
        assert got == {r.key: (r.occupied_x, r.occupied_y, r.occupied) for r in occupied_cells(occupancy_states(df, n, keys=("key",)), ("key",)).collect()}
        for k in range(3):
            own = [(cell(x), cell(y)) for key, x, y in rows if key == k]
            assert got[k] == (len({a for a, _ in own} - {None}), len({b for _, b in own} - {None}), len({(a, b) for a, b in own if a is not None and b is not None}))


def numpy_measure(data, features, n):
    """measure() for complete data, in NumPy."""
    forms = {"none": lambda v: v, "square": lambda v: v * v, "log": lambda v: np.where(v > 0, np.log(np.where(v > 0, v, 1.0)), np.where(v == 0, -np.inf, np.nan)), "log_eps": lambda v: np.log(v + 1e-10)}

    def side(axis):
        if not axis.terms:
            return Bounds(0.0, 0.0), np.zeros(len(data))
        terms = [t.sign * forms[t.transform](data[:, features.index(t.feature)]) for t in axis.terms]
        total, valid = np.zeros(len(data)), np.zeros(len(data))
        for v in terms:
            total, valid = total + np.where(np.isnan(v), 0.0, v), valid + ~np.isnan(v)
        with np.errstate(all="ignore"):
            value = total * (len(terms) / valid)
        known = value[~np.isnan(value)]
        low, high = (known.min(), known.max()) if len(known) else (0.0, 0.0)
        with np.errstate(all="ignore"):
            span = high - low
            b = Bounds(low - FUZZ0, high + FUZZ0) if span == 0 else Bounds(low - FUZZ0 * span, high + FUZZ0 * span)
            at = (value - b.low) / (b.high - b.low) if b.usable else np.zeros(len(data))
        return b, np.where(np.isnan(at), 0.0, at)

    def one(x, y):
        (bx, px), (by, py) = side(x), side(y)
        ix, iy = (np.clip(p * n, 0, n - 1).astype(int) for p in (px, py))
        bad = any(bool(a.terms) and not (b.low > -np.inf and b.high < np.inf) for a, b in ((x, bx), (y, by)))
        return Measured(x, y, bx, by, len(set(ix)), len(set(iy)), len(set(zip(ix, iy, strict=True))), bad)

    return one


@pytest.mark.parametrize(("seed", "mode"), [(0, "2d"), (5, "1d"), (11, "2d")])
def test_growth_in_lockstep(spark, seed, mode):
    """All attempts together give what each gives alone by NumPy, in as many jobs as the longest has trials, twice."""
    rng = np.random.default_rng(seed)
    data = np.stack([rng.random(120), rng.integers(0, 3, 120).astype(float), rng.random(120) ** 6, np.arange(120) / 120.0], axis=1).round(3)
    features = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, d double").cache()
    config = PairConfig(pairs=2, max_attempts=3, mode=mode, min_occupancy=0.3 if mode == "1d" else 0.12, sign_seed=seed, transform_seed=seed + 1, transforms=("none", "square", "log"))
    g = PairGenerator(df, features, [0, 1, 2, 3], 10, config)
    one, want, longest, trials = numpy_measure(data, features, 10), [], 0, 0
    for pair in range(2):
        best = None
        for attempt in range(3):
            grow, result, k = g.growth(pair, attempt), None, 0
            ask = next(grow)
            while True:
                k += 1
                try:
                    ask = grow.send(one(*ask))
                except StopIteration as end:
                    result = end.value
                    break
            longest, trials = max(longest, k), trials + k
            score = lambda m: m.occupied if mode == "2d" else m.occupied_x + m.occupied_y
            if result is not None and (best is None or score(result) > score(best)):
                best = result
        want.append(best)
    group = f"growth-{seed}"
    spark.sparkContext.setJobGroup(group, "growth")
    got = g.generate()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert [(m.x, m.y, m.occupied, m.occupied_x, m.occupied_y) for m in got] == [(m.x, m.y, m.occupied, m.occupied_x, m.occupied_y) for m in want if m is not None]
    assert g.attempts == 6 and g.rounds == longest and g.trials == trials
    assert jobs <= 5 * longest + 2  # two queries a round, of two and of three stages, each a job under AQE
    assert all(accepts(m, 10, mode, config.min_occupancy) for m in got)
    df.unpersist()


def test_memo(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.5, 0.9), (0.8, 0.4)], "a double, b double")
    memo, pair = Memo(), (Axis((Term("a"),)), Axis((Term("b"),)))
    first = measure(df, [pair, pair], 10, 1e-10, memo)
    assert measure(df, [pair], 10, 1e-10, memo) == first[:1] and memo.statistics() == {"hits": 2, "misses": 1, "hit_rate": 2 / 3, "axes": 2, "pairs": 1}
    memo.clear()
    assert memo.statistics()["misses"] == 0 and measure(df, [pair], 10, 1e-10, memo) == first[:1] and memo.misses == 1


def test_grid_store(spark, tmp_path):
    """Batches, a replayed batch, a restart, a compaction and one that failed halfway."""
    rows = [[(k % 4, k % 3, k % 2) for k in range(a, b)] for a, b in ((0, 50), (50, 80), (80, 200))]
    frame = lambda r: spark.createDataFrame(r, "ix int, iy int, cls int")
    count = lambda s: {(r.ix, r.iy, r.cls): r["count"] for r in s.read().collect()}
    want = lambda *parts: {k: sum(p.count(k) for p in parts) for k in {x for p in parts for x in p}}
    at = f"file://{tmp_path}/grid"
    store = GridStore(spark, at)
    assert store.read() is None
    store.compact()
    store.write_batch(frame(rows[0]), 0)
    store.write_batch(frame(rows[1]), 1)
    store.write_batch(frame(rows[1]), 1)
    assert count(store) == want(*rows[:2])
    store.compact()
    (tmp_path / "grid" / "upto=7").mkdir()  # without its mark of success
    again = GridStore(spark, at)
    again.write_batch(frame(rows[1]), 1)  # replayed although it is compacted
    again.write_batch(frame(rows[2]), 2)
    assert count(again) == want(*rows)
    again.compact()
    assert count(again) == want(*rows) and count(store) == want(*rows)


def test_stream_restarts(spark, tmp_path):
    """A stream over files, ended and started again from its checkpoint, counts every file once."""
    src, store = f"file://{tmp_path}/in", GridStore(spark, f"file://{tmp_path}/grid", ("k",))
    total = 0
    for part in range(3):
        spark.range(part * 100, part * 100 + 40).select((F.col("id") % 5).alias("k")).coalesce(1).write.mode("append").parquet(src)
        total += 40
        store.start(spark.readStream.schema("k long").parquet(src), f"file://{tmp_path}/check", once=True).awaitTermination()
        assert {r.k: r["count"] for r in store.read().collect()} == {k: total // 5 for k in range(5)}


def test_catalogue(spark):
    names = catalogue.register(spark)
    assert len(names) == 13
    inf = float("inf")
    values = [0.0, -0.0, 1.0, -1.0, 0.5, 1e-10, -1e-10, 40.0, -40.0, 800.0, -800.0, 1e300, inf, -inf, float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    df.createOrReplaceTempView("edge_values")
    same = lambda a, b: a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    for t in TRANSFORMS:
        got = {r.id: r.f for r in spark.sql(f"SELECT id, axis_{t}(v) AS f FROM edge_values").collect()}
        want = {r.id: r.f for r in df.select("id", transform(clean(F.col("v")), t).alias("f")).collect()}
        assert all(same(got[k], want[k]) for k in want), t
    assert [r.f for r in spark.sql("SELECT axis_log_eps(v, 0.5D) AS f FROM edge_values WHERE id < 3 ORDER BY id").collect()] == pytest.approx([math.log(0.5), math.log(0.5), math.log(1.5)])
    got = spark.sql("SELECT id, axis_cell(v, 12) AS c, rect_away(v, v, 0.1, 0.2, 0.3, 0.4) AS d FROM edge_values ORDER BY id").collect()
    want = df.select("id", grid_cell(F.col("v"), 12).alias("c"), rect_distance(F.col("v"), F.col("v"), 0.1, 0.2, 0.3, 0.4).alias("d")).orderBy("id").collect()
    assert all(a.c == b.c and same(a.d, b.d) for a, b in zip(got, want, strict=True))


def test_estimator(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y), "red" if x + y > 1 else "blue") for i, (x, y) in enumerate(rng.random((160, 2)))]
    df = spark.createDataFrame(rows, "id long, x double, y double, colour string").withColumn("label", (F.col("colour") == "red").cast("double"))
    stage = RectangleEstimator(featureCols=["x", "y"], labelCol="label", voters=1, pairs=2, coveredPairs=1)
    fitted = Pipeline(stages=[stage]).fit(df)
    out = fitted.transform(df)
    assert out.columns == [*df.columns, "prediction"]
    got = {r.id: r.prediction for r in out.collect()}
    assert np.mean([got[i] == float(c == "red") for i, _, _, c in rows]) > 0.85
    fitted.write().overwrite().save(f"file://{tmp_path}/model")
    again = PipelineModel.load(f"file://{tmp_path}/model")
    assert {r.id: r.prediction for r in again.transform(df).collect()} == got
    assert isinstance(again.stages[0], RectangleModel) and again.stages[0].getOrDefault("featureCols") == ["x", "y"]
    stage.write().overwrite().save(f"file://{tmp_path}/stage")
    assert RectangleEstimator.load(f"file://{tmp_path}/stage").getOrDefault("pairs") == 2
    grid = ParamGridBuilder().addGrid(stage.pairs, [1, 2]).build()
    cv = CrossValidator(estimator=stage, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=2, seed=3).fit(df)
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.6


def test_grid_document_weights(spark):
    grid = spark.createDataFrame([(0, 1, 3, [1, 2])], "ix int, iy int, count long, class_counts array<long>")
    x, y = Axis((Term("b", -1), Term("a"))), Axis((Term("c", -1, "log"),))
    doc = grid_document(grid, 4, 1, ["u", "v"], [7, 9], x, y, 2, ["a", "b", "c"])
    assert (doc["projection_weights_x"], doc["projection_weights_y"]) == ([-1, 0], [-2]) and doc["target_class_id"] == 9


def test_merged_queries(spark):
    assert core.QUERIES["pair_generation_incremental"](spark, SF).count() == 1


def test_silhouettes_by_loops(spark):
    rng = np.random.default_rng(8)
    grids = {0: [(i, j, rng.integers(0, 4, 3)) for i in range(9) for j in range(9)], 1: [(0, 0, np.array([5, 0, 0])), (3, 1, np.array([0, 1, 0]))], 2: [(2, 2, np.array([4, 0, 0]))], 3: [(1, 1, np.array([3, 2, 0])), (1, 2, np.array([0, 0, 9]))]}
    rows = [(p, i, j, int(c.sum()), [int(v) for v in c]) for p, cells in grids.items() for i, j, c in cells if c.sum()]
    df = spark.createDataFrame(rows, "pair int, ix int, iy int, count long, class_counts array<long>")
    got = {r.pair: (r.sil, r.sil_all) for r in silhouettes(df, 1, 9).collect()}
    for p in grids:
        own = [(i, j, c) for q, i, j, _, c in rows if q == p]
        size = [sum(c[k] for *_, c in own) for k in range(3)]
        far = lambda a, k, own=own: sum(c[k] * math.hypot(a[0] - i, a[1] - j) / 9 for i, j, c in own)
        one = every = 0.0
        for cell in own:
            rest = size[0] + size[2]
            if cell[2][1] and size[1] > 1 and rest:
                a, b = far(cell, 1) / (size[1] - 1), (far(cell, 0) + far(cell, 2)) / rest
                one += cell[2][1] * ((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
            for k, w in enumerate(cell[2]):
                others = [far(cell, o) / size[o] for o in range(3) if o != k and size[o]]
                if w and size[k] > w and others and max(far(cell, k) / (size[k] - w), min(others)) > 0:
                    a, b = far(cell, k) / (size[k] - w), min(others)
                    every += w * (b - a) / max(a, b)
        assert got[p] == (pytest.approx(one / size[1] if size[1] else 0.0), pytest.approx(every / sum(size)))
    assert silhouettes(df.limit(0), 1, 9).count() == 0
