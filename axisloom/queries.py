"""Registered queries over the test tables, each with DuckDB SQL of the same result where SQL can express it.

Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PairConfig
from .functions import catalogue
from .functions.geometry import centre_distance, grid_cell, hex_distance, in_rect, rect_distance
from .functions.transforms import TRANSFORMS, clean, signed_sqrt, transform
from .operators import grid as G
from .operators import metrics as M
from .operators import stats as S
from .operators.accumulate import AxisAccumulator
from .operators.axis import Axis, Term, bounds, bounds_table, invalid_stats, placed, placed_pairs, with_values
from .operators.cover import Grid, cover
from .operators.moments import finished_moments, merged_moments, moment_states
from .operators.rules import Rect, Rule, first_match, matched, nearest_rule, scored, training_error, vote
from .operators.search import PairGenerator
from .plans.model import RectangleClassifier, TrainerConfig
from .sources.sinks import plot_table, points, run_summary
from .sources.tables import label_dictionary, unmapped, with_class, with_names
from .streaming.grid_store import GridStore, scratch_folder

FEATURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber", "supplier": "l_suppkey"}
N, RINGS, CLASSES, TARGET = 20, 5, 3, 1
# Three axis pairs of exactly rounded arithmetic.
PAIRS = [
    (Axis((Term("quantity"), Term("price", -1, "sqrt"))), Axis((Term("discount", 1, "square"), Term("line", -1)))),
    (Axis((Term("tax"), Term("discount", -1))), Axis((Term("quantity", 1, "square"), Term("supplier")))),
    (Axis((Term("line", 1, "inverse"),)), Axis((Term("tax", 1, "sqrt"), Term("quantity", -1)))),
]
X, Y = PAIRS[0]

Query = Callable[[SparkSession, str], DataFrame]


def _r(c, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Line items as features, with the dense class of the return flag."""
    raw = _table(s, d, "lineitem")
    rows = raw.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("no"), "l_returnflag", *[clean(F.col(c)).alias(n) for n, c in FEATURES.items()])
    return with_class(rows, "l_returnflag", label_dictionary(raw, "l_returnflag"))


def _placed(s: SparkSession, d: str) -> DataFrame:
    return placed(_lines(s, d), X, Y)


def _pair_grid(s: SparkSession, d: str) -> DataFrame:
    """Grids of the three pairs, by one aggregation."""
    return G.square_grid(placed_pairs(_lines(s, d), PAIRS), N, CLASSES, keys=("pair",))


# -- SQL building blocks ----------------------------------------------------------------------------

_ROWS = f"""SELECT l_orderkey AS id, l_linenumber AS no, l_returnflag, {', '.join(f'CAST({c} AS DOUBLE) AS {n}' for n, c in FEATURES.items())},
  CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INT) AS cls FROM lineitem"""
_SQL_T = {
    "none": "{x}", "square": "({x})*({x})", "sqrt": "CASE WHEN {x} < 0 THEN 0.0 ELSE sqrt({x}) END",
    "log": "CASE WHEN {x} = 0 THEN '-inf'::DOUBLE WHEN {x} > 0 THEN ln({x}) END",
    "log_eps": "CASE WHEN ({x}) + 1e-10 = 0 THEN '-inf'::DOUBLE WHEN ({x}) + 1e-10 > 0 THEN ln(({x}) + 1e-10::DOUBLE) END",
    "inverse": "CASE WHEN {x} = 0 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE / ({x}) END",
    "inverse_eps": "CASE WHEN ({x}) + 1e-10::DOUBLE = 0 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE / (({x}) + 1e-10::DOUBLE) END",
    "sigmoid": "CASE WHEN {x} >= 0 THEN 1/(1+exp(-({x}))) ELSE exp({x})/(1+exp({x})) END",
}
_SQL_T["sigmoid_eps"] = f"greatest(least({_SQL_T['sigmoid']}, 1-1e-10::DOUBLE), 1e-10::DOUBLE)"
_SQL_T["logit"] = f"(SELECT CASE WHEN p = 1 THEN 'inf'::DOUBLE WHEN p = 0 THEN '-inf'::DOUBLE ELSE ln(p/(1-p)) END FROM (SELECT {_SQL_T['sigmoid']} AS p))"
_SQL_T["logit_eps"] = f"(SELECT ln(p/(1-p)) FROM (SELECT {_SQL_T['sigmoid_eps']} AS p))"


def _axis_sql(a: Axis) -> str:
    return " + ".join(f"({'-' if t.sign < 0 else ''}({_SQL_T[t.transform].format(x=t.feature)}))" for t in a.terms)


def _cell_sql(v: str, n: int = N, shrink: str = "0.99999::DOUBLE * ") -> str:
    return f"CAST(floor(least(greatest({shrink}{v} * {n}, 0.0), {n - 1}.0)) AS INT)"


def _placed_sql(x: Axis = X, y: Axis = Y) -> str:
    return f"""SELECT q.*, (px - (lx - 1e-5::DOUBLE * (hx - lx))) / ((hx + 1e-5::DOUBLE * (hx - lx)) - (lx - 1e-5::DOUBLE * (hx - lx))) AS x,
      (py - (ly - 1e-5::DOUBLE * (hy - ly))) / ((hy + 1e-5::DOUBLE * (hy - ly)) - (ly - 1e-5::DOUBLE * (hy - ly))) AS y
      FROM (SELECT r.*, {_axis_sql(x)} AS px, {_axis_sql(y)} AS py FROM ({_ROWS}) r) q
      CROSS JOIN (SELECT min(px) AS lx, max(px) AS hx, min(py) AS ly, max(py) AS hy FROM (SELECT {_axis_sql(x)} AS px, {_axis_sql(y)} AS py FROM ({_ROWS}) r)) b"""


def _grid_sql(x: Axis = X, y: Axis = Y, pair: int | None = None) -> str:
    sums = ", ".join(f"CAST(count(*) FILTER (cls = {c}) AS BIGINT) AS c{c}" for c in range(CLASSES))
    head = "" if pair is None else f"{pair} AS pair, "
    return f"SELECT {head}{_cell_sql('x')} AS ix, {_cell_sql('y')} AS iy, count(*) AS cnt, avg(x) AS cx, avg(y) AS cy, {sums} FROM ({_placed_sql(x, y)}) GROUP BY ALL"


_GRIDS_SQL = " UNION ALL ".join(_grid_sql(x, y, i) for i, (x, y) in enumerate(PAIRS))
_CELLS_SQL = f"SELECT pair, ix, iy, cnt, c{TARGET}::DOUBLE AS t, (cnt - c{TARGET})::DOUBLE AS n, c{TARGET} / cnt AS p, (ix + 0.5) / {N} AS x, (iy + 0.5) / {N} AS y FROM ({_GRIDS_SQL})"


def _rd(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


# -- queries ----------------------------------------------------------------------------------------

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("scan_cast_select", "SELECT l_orderkey AS id, l_linenumber AS no, CAST(l_suppkey AS DOUBLE) AS supplier, CAST(l_discount AS DOUBLE) AS discount FROM lineitem")
def _(s, d):
    return _lines(s, d).select("id", "no", "supplier", "discount")


@query("label_dictionary", "SELECT l_returnflag AS label, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INT) AS cls FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def _(s, d):
    return label_dictionary(_table(s, d, "lineitem"), "l_returnflag")


@query("label_join_names", "SELECT s_suppkey, coalesce(n_name, 'Unknown (' || s_nationkey || ')') AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey")
def _(s, d):
    names = _table(s, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("cls"), F.col("n_name").alias("label"))
    return with_names(_table(s, d, "supplier"), "s_nationkey", names).select("s_suppkey", "name")


@query("label_unmapped_anti", "SELECT DISTINCT event_type AS name FROM events WHERE event_type NOT IN ('click', 'view', 'error')")
def _(s, d):
    known = s.createDataFrame([("click", 0), ("view", 1), ("error", 2)], "name string, id int")
    return unmapped(_table(s, d, "events"), "event_type", known)


@query("missing_value_filter", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND event_id % 7 <> 0")
def _(s, d):
    e = _table(s, d, "events").select("event_id", clean(F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("value"))
    return e.filter("value is not null")


def _transform_query(name: str) -> None:
    sql = _SQL_T[name].format(x="x")

    @query(f"transform_{name}", f"SELECT c_custkey, round({sql}, 6) + 0.0 AS y FROM (SELECT c_custkey, floor(c_acctbal / 500) AS x FROM customer)")
    def _(s, d):
        x = F.floor(F.col("c_acctbal") / 500).cast("double")
        return _table(s, d, "customer").select("c_custkey", _r(transform(x, name)).alias("y"))


for _name in TRANSFORMS:
    _transform_query(_name)


@query("transform_signed_sqrt", "SELECT c_custkey, round(sign(c_acctbal) * sqrt(abs(c_acctbal)), 6) + 0.0 AS y FROM customer")
def _(s, d):
    return _table(s, d, "customer").select("c_custkey", _r(signed_sqrt(F.col("c_acctbal"))).alias("y"))


_AXES = [a for p in PAIRS for a in p]
_MARGIN = "CASE WHEN hi = lo THEN 1e-5::DOUBLE ELSE 1e-5::DOUBLE * (hi - lo) END"


@query("axis_bounds", f"SELECT 0 AS axis, {_rd(f'lo - {_MARGIN}', 'low')}, {_rd(f'hi + {_MARGIN}', 'high')} FROM (SELECT min(p) AS lo, max(p) AS hi FROM (SELECT {_axis_sql(X)} AS p FROM ({_ROWS}) r))")
def _(s, d):
    return bounds_table(_lines(s, d), [X]).select("axis", _r("low").alias("low"), _r("high").alias("high"))


@query("axis_bounds_batched", " UNION ALL ".join(f"SELECT {i} AS axis, {_rd(f'lo - {_MARGIN}', 'low')}, {_rd(f'hi + {_MARGIN}', 'high')} FROM (SELECT min(p) AS lo, max(p) AS hi FROM (SELECT {_axis_sql(a)} AS p FROM ({_ROWS}) r))" for i, a in enumerate(_AXES)))
def _(s, d):
    return bounds_table(_lines(s, d), _AXES).select("axis", _r("low").alias("low"), _r("high").alias("high"))


@query("axis_fill", f"SELECT id, no, {_rd('x', 'x')}, {_rd('y', 'y')} FROM ({_placed_sql()})")
def _(s, d):
    return _placed(s, d).select("id", "no", _r("x").alias("x"), _r("y").alias("y"))


_HOLES = Axis((Term("a"), Term("b", -1), Term("c", 1, "sqrt")))
_HOLES_SQL = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS b,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS c FROM events"""


def _holes(s: SparkSession, d: str) -> DataFrame:
    e = _table(s, d, "events")
    gap = lambda k, c: F.when(F.col("event_id") % k != 0, F.col(c).cast("double"))
    return e.select("event_id", gap(3, "value").alias("a"), gap(4, "user_id").alias("b"), gap(5, "value").alias("c"))


@query(
    "axis_partial_invalid",
    f"""WITH h AS ({_HOLES_SQL}), v AS (SELECT event_id, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS valid,
      coalesce(a, 0) + coalesce(-b, 0) + coalesce(CASE WHEN c < 0 THEN 0.0 ELSE sqrt(c) END, 0) AS s FROM h)
    SELECT event_id, valid, round(CASE WHEN valid = 3 THEN s WHEN valid > 0 THEN s * 3 / valid END, 6) + 0.0 AS p FROM v""",
)
def _(s, d):
    return with_values(_holes(s, d), {"p": _HOLES}).select("event_id", F.col("p_valid").alias("valid"), _r("p").alias("p"))


@query(
    "axis_invalid_stats",
    f"WITH h AS ({_HOLES_SQL}), v AS (SELECT (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS valid FROM h) SELECT count(*) AS rows, CAST(count(*) FILTER (valid = 0) AS BIGINT) AS fully_invalid, CAST(count(*) FILTER (valid > 0 AND valid < 3) AS BIGINT) AS partly_invalid FROM v",
)
def _(s, d):
    return invalid_stats(_holes(s, d), _HOLES)


@query(
    "minmax_standardise",
    "WITH m AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), w AS (SELECT a - 1e-5::DOUBLE * (b - a) AS lo, b FROM m), z AS (SELECT lo, b + 1e-5::DOUBLE * (b - lo) AS hi FROM w) SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) + 0.0 AS y FROM customer CROSS JOIN z",
)
def _(s, d):
    c = _table(s, d, "customer").select("c_custkey", "c_acctbal")
    return S.standardised(c, ["c_acctbal"], S.limits(c, ["c_acctbal"])).select("c_custkey", _r("c_acctbal").alias("y"))


@query("class_statistics", f"SELECT cls, count(*) AS count, {', '.join(_rd(f'sum(coalesce({f}, 0)) / count(*)', f'mean_{f}') for f in FEATURES)} FROM ({_ROWS}) GROUP BY cls")
def _(s, d):
    st = S.class_statistics(_lines(s, d), list(FEATURES))
    return st.select("cls", "count", *[_r(f"mean_{f}").alias(f"mean_{f}") for f in FEATURES])


_SEP_SQL = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(min(abs(o.m - a.m)), 6) + 0.0 AS separation FROM means o, means a WHERE o.f = '{f}' AND a.f = '{f}' AND o.cls = {TARGET} AND a.cls <> {TARGET}" for f in FEATURES)
_MEANS_SQL = "WITH means AS (" + " UNION ALL ".join(f"SELECT cls, '{f}' AS f, sum({f}) / count(*) AS m FROM ({_ROWS}) GROUP BY cls" for f in FEATURES) + ")"


@query("class_separation", f"{_MEANS_SQL} {_SEP_SQL}")
def _(s, d):
    return S.separation_table(S.class_statistics(_lines(s, d), list(FEATURES)), list(FEATURES), TARGET).select("feature", _r("separation").alias("separation"))


@query("top_k_features", f"{_MEANS_SQL} SELECT feature, separation FROM ({_SEP_SQL}) ORDER BY separation DESC, feature LIMIT 3")
def _(s, d):
    t = S.separation_table(S.class_statistics(_lines(s, d), list(FEATURES)), list(FEATURES), TARGET)
    return t.select("feature", _r("separation").alias("separation")).orderBy(F.col("separation").desc(), "feature").limit(3)


@query("moments", " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, {_rd(f'avg({f})', 'mean')}, {_rd(f'sqrt(var_samp({f}))', 'sd')}, round(skewness({f}), 4) + 0.0 AS skewness, round(kurtosis({f}), 4) + 0.0 AS kurtosis FROM ({_ROWS})" for f in ("quantity", "price", "discount")))
def _(s, d):
    m = S.moments(_lines(s, d), ["quantity", "price", "discount"])
    return m.select("feature", "n", _r("mean").alias("mean"), _r("sd").alias("sd"), _r("skewness", 4).alias("skewness"), _r("kurtosis", 4).alias("kurtosis"))


# Slices by ship month and status, merged to quarters and to the whole.
# The total stands for the mean, whose decimals can end in ties that the two engines round apart.
@query(
    "moments_merged",
    " UNION ALL ".join(
        f"""SELECT {q} AS quarter, '{f}' AS feature, count(*) AS n, round(sum({f}), 4) + 0.0 AS total, round(CASE WHEN count(*) >= 2 THEN stddev_samp({f}) END, 4) + 0.0 AS sd, round(CASE WHEN count(*) >= 3 THEN skewness({f}) END, 4) + 0.0 AS skewness,
    round(CASE WHEN count(*) >= 4 THEN kurtosis({f}) END, 4) + 0.0 AS kurtosis FROM (SELECT CAST(l_{c} AS DOUBLE) AS {f}, CAST(year(l_shipdate) * 10 + quarter(l_shipdate) AS INT) AS q FROM lineitem) {g}"""
        for f, c in (("quantity", "quantity"), ("discount", "discount"))
        for q, g in (("q", "GROUP BY q"), ("NULL::INT", ""))
    ),
)
def _(s, d):
    raw = _table(s, d, "lineitem").select((F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("month"), "l_linestatus", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    early, late = (moment_states(raw.filter(w), ["quantity", "discount"], ("month",)) for w in ("l_linestatus = 'F'", "l_linestatus <> 'F'"))
    quarter = (F.floor(F.col("month") / 12) * 10 + F.floor(F.col("month") % 12 / 3) + 1).cast("int")
    by_quarter = merged_moments(early.union(late).withColumn("quarter", quarter).drop("month"), ("quarter",))
    both = by_quarter.union(merged_moments(by_quarter).select(F.lit(None).cast("int").alias("quarter"), "feature", "n", "mean", "m2", "m3", "m4"))
    return finished_moments(both, ("quarter",)).select("quarter", "feature", "n", _r(F.col("mean") * F.col("n"), 4).alias("total"), _r("sd", 4).alias("sd"), _r("skewness", 4).alias("skewness"), _r("kurtosis", 4).alias("kurtosis"))


@query("auto_transform_flags")
def _(s, d):
    rows = _lines(s, d)
    flagged = set(S.sqrt_features(rows, list(FEATURES)))
    return s.createDataFrame([(f, f in flagged) for f in FEATURES], "feature string, root boolean")


@query("occupancy_1d", f"SELECT o AS occupied, o >= {int(N * 0.05)} AS valid FROM (SELECT count(DISTINCT {_cell_sql('x', N, '')}) AS o FROM ({_placed_sql()}))")
def _(s, d):
    return G.occupancy_1d(_placed(s, d), N)


@query("occupancy_2d", f"SELECT o AS occupied, o >= {int(N * N * 0.05)} AS valid FROM (SELECT count(DISTINCT {_cell_sql('x', N, '')} * {N} + {_cell_sql('y', N, '')}) AS o FROM ({_placed_sql()}))")
def _(s, d):
    return G.occupancy_2d(_placed(s, d), N)


def _grid(s: SparkSession, d: str) -> DataFrame:
    return G.square_grid(G.countable(_placed(s, d)), N, CLASSES)




def _flat() -> list[Column]:
    return [F.element_at("class_counts", c + 1).alias(f"c{c}") for c in range(CLASSES)]


@query("grid_square", f"SELECT ix, iy, cnt AS count, c0, c1, c2 FROM ({_grid_sql()})")
def _(s, d):
    return _grid(s, d).select("ix", "iy", "count", *_flat())


@query("grid_long", f"SELECT {_cell_sql('x')} AS ix, {_cell_sql('y')} AS iy, cls, count(*) AS count FROM ({_placed_sql()}) GROUP BY ALL")
def _(s, d):
    return G.long_grid(_placed(s, d), N)


@query("grid_centroid", f"SELECT ix, iy, {_rd('cx', 'cx')}, {_rd('cy', 'cy')} FROM ({_grid_sql()})")
def _(s, d):
    return _grid(s, d).select("ix", "iy", _r("cx").alias("cx"), _r("cy").alias("cy"))


@query("grid_pure_count", f"SELECT CAST(coalesce(sum(c{TARGET}) FILTER (c{TARGET} = cnt), 0) AS BIGINT) AS pure_count FROM ({_grid_sql()})")
def _(s, d):
    return G.pure_count(_grid(s, d), TARGET)


@query("grid_pure_cells", f"SELECT CAST(count(*) FILTER (c{TARGET} = cnt) AS BIGINT) AS pure_cells, CAST(coalesce(sum(cnt) FILTER (c{TARGET} = cnt), 0) AS BIGINT) AS pure_rows, CAST(sum(cnt) FILTER (c{TARGET} = cnt) AS DOUBLE) / nullif(count(*) FILTER (c{TARGET} = cnt), 0) AS rows_per_pure_cell FROM ({_grid_sql()})")
def _(s, d):
    return G.pure_cells(_grid(s, d), TARGET)


@query("grid_dominant_class", f"SELECT ix, iy, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS dominant FROM ({_grid_sql()})")
def _(s, d):
    return G.dominant(_grid(s, d)).select("ix", "iy", "dominant")


@query("grid_class_percentages", " UNION ALL ".join(f"SELECT ix, iy, {c} AS cls, {_rd(f'100.0::DOUBLE * c{c} / cnt', 'percentage')} FROM ({_grid_sql()}) WHERE c{c} > 0" for c in range(CLASSES)))
def _(s, d):
    return G.class_percentages(_grid(s, d), CLASSES).select("ix", "iy", F.explode("percentages").alias("cls", "percentage")).withColumn("percentage", _r("percentage"))


@query("grid_unlabelled_filtered", f"SELECT {_cell_sql('x')} AS ix, {_cell_sql('y')} AS iy, count(*) AS count FROM ({_placed_sql()}) WHERE id % 5 <> 0 AND no % 3 <> 0 GROUP BY ALL")
def _(s, d):
    p = _placed(s, d).withColumns({"cls": F.when(F.col("id") % 5 == 0, F.lit(-1)).otherwise(F.col("cls")), "pred": F.when(F.col("no") % 3 == 0, F.lit(1)).otherwise(F.lit(-1))})
    return G.square_grid(G.countable(p, pred="pred"), N, CLASSES).select("ix", "iy", "count")


@query("grid_plot_table", f"SELECT ix, iy, {_rd(f'c{TARGET}::DOUBLE / cnt', 'purity')}, c{TARGET} = cnt AS pure, {_rd('300 * sqrt(cnt) / sqrt(max(cnt) OVER ())', 'size')} FROM ({_grid_sql()})")
def _(s, d):
    return plot_table(_grid(s, d), N, TARGET).select("ix", "iy", _r("purity").alias("purity"), "pure", _r("size").alias("size"))


# hexagons: the axial and cube arithmetic in SQL
_W = 2 * RINGS + 1
_HS = f"least(1 / (1.5::DOUBLE * {_W}), 1 / (sqrt(3::DOUBLE) * {_W}))"
_HEX_SQL = f"""SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS INT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS INT) AS r, x, y, cls
  FROM (SELECT *, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(rs - fs) AS ds FROM (SELECT *, round_even(fq, 0) AS rq, round_even(fr, 0) AS rr, round_even(fs, 0) AS rs
  FROM (SELECT *, -fq - fr AS fs FROM (SELECT x, y, cls, (2.0::DOUBLE / 3.0::DOUBLE) * (2.0 * x - 1.0) / {_HS} AS fq, ((-1.0::DOUBLE / 3.0::DOUBLE) * (2.0 * x - 1.0) + (sqrt(3::DOUBLE) / 3.0::DOUBLE) * (2.0 * y - 1.0)) / {_HS} AS fr FROM ({_placed_sql()})))))"""
_HEXGRID_SQL = f"SELECT q, r, count(*) AS count, CAST(count(*) FILTER (cls = {TARGET}) AS BIGINT) AS t FROM ({_HEX_SQL}) WHERE (abs(q) + abs(q + r) + abs(r)) / 2 <= {RINGS} GROUP BY ALL"


@query("hex_grid", _HEXGRID_SQL)
def _(s, d):
    return G.hex_grid(_placed(s, d), RINGS, CLASSES).select("q", "r", "count", F.element_at("class_counts", TARGET + 1).alias("t"))


@query(
    "hex_stats",
    f"SELECT {3 * RINGS * (RINGS + 1) + 1} AS total_hexagons, count(*) AS occupied_hexagons, CAST(count(*) FILTER (t = count) AS BIGINT) AS pure_hexagons, CAST(coalesce(sum(count), 0) AS BIGINT) AS points, CAST(coalesce(sum(t) FILTER (t = count), 0) AS BIGINT) AS pure_count, round(count(*) / {3 * RINGS * (RINGS + 1) + 1}.0, 6) + 0.0::DOUBLE AS occupancy_rate, round(count(*) FILTER (t = count) / count(*), 6) + 0.0::DOUBLE AS purity_rate FROM ({_HEXGRID_SQL})",
)
def _(s, d):
    h = G.hex_stats(G.hex_grid(_placed(s, d), RINGS, CLASSES), RINGS, TARGET)
    return h.withColumns({"occupancy_rate": _r("occupancy_rate"), "purity_rate": _r("purity_rate")})


_LATTICE_SQL = f"SELECT CAST(a AS INT) AS q, CAST(b AS INT) AS r FROM range(-{RINGS}, {RINGS + 1}) qa(a), range(-{RINGS}, {RINGS + 1}) rb(b) WHERE (abs(a) + abs(a + b) + abs(b)) / 2 <= {RINGS}"


@query("hex_lattice", f"SELECT q, r, {_rd(f'{_HS} * 1.5 * q', 'x')}, {_rd(f'{_HS} * (sqrt(3::DOUBLE) / 2 * q + sqrt(3::DOUBLE) * r)', 'y')} FROM ({_LATTICE_SQL})")
def _(s, d):
    return G.hex_lattice(s, RINGS).select("q", "r", _r("x").alias("x"), _r("y").alias("y"))


@query("hex_neighbors", f"SELECT q, r, q + dq AS nq, r + dr AS nr FROM ({_LATTICE_SQL}), (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) s(dq, dr)")
def _(s, d):
    return G.hex_neighbours(G.hex_lattice(s, RINGS))


@query("hex_distance", f"SELECT l.q, l.r, CAST((abs(l.q - 1) + abs(l.q - 1 + l.r + 2) + abs(l.r + 2)) / 2 AS INT) AS distance FROM ({_LATTICE_SQL}) l")
def _(s, d):
    return G.hex_lattice(s, RINGS).select("q", "r", hex_distance(F.col("q"), F.col("r"), F.lit(1), F.lit(-2)).alias("distance"))


@query("metric_bp", f"SELECT pair, {_rd('sum(t * t / cnt) / sum(t)', 'bp')} FROM ({_CELLS_SQL}) GROUP BY pair")
def _(s, d):
    return M.simple_metrics(_pair_grid(s, d), TARGET).select("pair", _r("bp").alias("bp"))


@query("metric_purity_weighted", f"SELECT pair, {_rd('sum(p * cnt) / sum(cnt)', 'purity_weighted')} FROM ({_CELLS_SQL}) GROUP BY pair")
def _(s, d):
    return M.simple_metrics(_pair_grid(s, d), TARGET).select("pair", _r("purity_weighted").alias("purity_weighted"))


@query("metric_coverage_p70", f"SELECT pair, {_rd('sum(CASE WHEN p >= 0.7 THEN t ELSE 0 END) / sum(t)', 'coverage_p70')} FROM ({_CELLS_SQL}) GROUP BY pair")
def _(s, d):
    return M.simple_metrics(_pair_grid(s, d), TARGET).select("pair", _r("coverage_p70").alias("coverage_p70"))


@query("metric_totals", f"SELECT pair, CAST(sum(t) AS BIGINT) AS target_total, CAST(sum(n) AS BIGINT) AS non_target_total, count(*) AS occupied_bins FROM ({_CELLS_SQL}) GROUP BY pair")
def _(s, d):
    return M.simple_metrics(_pair_grid(s, d), TARGET).select("pair", "target_total", "non_target_total", "occupied_bins")


_ROC_SQL = f"""WITH g AS (SELECT pair, p, sum(t) AS t, sum(n) AS n FROM ({_CELLS_SQL}) GROUP BY pair, p),
  c AS (SELECT pair, p, sum(t) OVER w AS tp, sum(n) OVER w AS fp, sum(t) OVER (PARTITION BY pair) AS tt, sum(n) OVER (PARTITION BY pair) AS nn FROM g WINDOW w AS (PARTITION BY pair ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
  l AS (SELECT *, tp / tt AS tpr, fp / nn AS fpr, lag(tp / tt, 1, 0.0) OVER (PARTITION BY pair ORDER BY p DESC) AS tpr0, lag(fp / nn, 1, 0.0) OVER (PARTITION BY pair ORDER BY p DESC) AS fpr0 FROM c)"""


@query("metric_auc", f"{_ROC_SQL} SELECT pair, {_rd('sum((fpr - fpr0) * (tpr + tpr0) / 2)', 'auc')} FROM l GROUP BY pair")
def _(s, d):
    return M.threshold_metrics(_pair_grid(s, d), TARGET).select("pair", _r("auc").alias("auc"))


@query("metric_f1", f"{_ROC_SQL} SELECT pair, {_rd('max(2 * tp / (tp + fp + tt))', 'f1')} FROM l GROUP BY pair")
def _(s, d):
    return M.threshold_metrics(_pair_grid(s, d), TARGET).select("pair", _r("f1").alias("f1"))


@query(
    "metric_jsd",
    f"""WITH c AS (SELECT pair, t / sum(t) OVER (PARTITION BY pair) AS a, n / sum(n) OVER (PARTITION BY pair) AS b FROM ({_CELLS_SQL}))
    SELECT pair, round(sum(CASE WHEN a > 0 THEN 0.5 * a * ln(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN 0.5 * b * ln(2 * b / (a + b)) ELSE 0 END) / ln(2), 6) + 0.0 AS jsd FROM c GROUP BY pair""",
)
def _(s, d):
    return M.simple_metrics(_pair_grid(s, d), TARGET).select("pair", _r("jsd").alias("jsd"))


@query(
    "metric_silhouette",
    f"""WITH c AS ({_CELLS_SQL}), s AS (SELECT a.pair, a.ix, a.iy, a.t AS w, sum(b.t * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) / (sum(b.t) - 1) AS u,
      sum(b.n * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) / sum(b.n) AS v FROM c a JOIN c b ON a.pair = b.pair WHERE a.t > 0 GROUP BY ALL)
    SELECT pair, round(sum(w * (v - u) / greatest(u, v)) / sum(w), 6) + 0.0 AS sil FROM s GROUP BY pair""",
)
def _(s, d):
    return M.silhouette(_pair_grid(s, d), TARGET, N).select("pair", _r("sil").alias("sil"))


@query(
    "metric_silhouette_all",
    f"""WITH g AS ({_GRIDS_SQL}), c AS ({' UNION ALL '.join(f"SELECT pair, (ix + 0.5) / {N} AS x, (iy + 0.5) / {N} AS y, {k} AS cls, c{k}::DOUBLE AS w, ix, iy FROM g WHERE c{k} > 0" for k in range(CLASSES))}),
      z AS (SELECT *, sum(w) OVER (PARTITION BY pair, cls) AS size FROM c),
      d AS (SELECT a.pair, a.ix, a.iy, a.cls, a.w, a.size, b.cls AS o, b.size AS os, sum(b.w * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM z a JOIN z b ON a.pair = b.pair GROUP BY ALL),
      s AS (SELECT pair, ix, iy, cls, w, max(CASE WHEN cls = o AND size > w THEN d / (size - w) END) AS u, min(CASE WHEN cls <> o THEN d / os END) AS v FROM d GROUP BY ALL)
    SELECT pair, round(sum(w * coalesce(CASE WHEN greatest(u, v) > 0 AND u IS NOT NULL AND v IS NOT NULL THEN (v - u) / greatest(u, v) END, 0)) / sum(w), 6) + 0.0 AS sil_all FROM s GROUP BY pair""",
)
def _(s, d):
    return M.silhouette_all(_pair_grid(s, d), N).select("pair", _r("sil_all").alias("sil_all"))


@query("rank_pairs", f"SELECT pair, score, CAST(row_number() OVER (ORDER BY score DESC, pair) AS INT) AS rank FROM (SELECT pair, {_rd('sum(t * t / cnt) / sum(t)', 'score')} FROM ({_CELLS_SQL}) GROUP BY pair)")
def _(s, d):
    return M.rank_pairs(_pair_grid(s, d), TARGET, N, "bp").withColumn("score", _r("score"))


# rectangles and rules
_RECTS = [Rect(0.1, 0.1, 0.3, 0.4), Rect(0.35, 0.3, 0.25, 0.5), Rect(0.6, 0.0, 0.4, 0.25)]


def _in_sql(q: Rect) -> str:
    return f"x >= {q.left}::DOUBLE AND x < {q.left}::DOUBLE + {q.width}::DOUBLE AND y >= {q.bottom}::DOUBLE AND y < {q.bottom}::DOUBLE + {q.height}::DOUBLE"


def _away_sql(q: Rect) -> str:
    return f"greatest({q.left}::DOUBLE - x, x - ({q.left}::DOUBLE + {q.width}::DOUBLE), {q.bottom}::DOUBLE - y, y - ({q.bottom}::DOUBLE + {q.height}::DOUBLE), 0.0)"


def _rules(rows: DataFrame) -> list[Rule]:
    bx, by = bounds(rows, [X, Y])
    return [Rule(i, X, Y, bx, by, (q,)) for i, q in enumerate(_RECTS)]


_FIRST_SQL = "CASE " + " ".join(f"WHEN {_in_sql(q)} THEN {i}" for i, q in enumerate(_RECTS))
_NEAR_SQL = f"(SELECT CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END FROM (SELECT {', '.join(f'{_away_sql(q)} AS {n}' for q, n in zip(_RECTS, 'abc'))}))"


@query("rect_contains", f"SELECT id, no, {_in_sql(_RECTS[0])} AS inside FROM ({_placed_sql()})")
def _(s, d):
    return _placed(s, d).select("id", "no", in_rect(F.col("x"), F.col("y"), *_RECTS[0].parts()).alias("inside"))


@query("rect_distance", f"SELECT id, no, {_rd(_away_sql(_RECTS[0]), 'distance')}, round(greatest(abs(x - 0.25), abs(y - 0.3)), 6) + 0.0 AS centre FROM ({_placed_sql()})")
def _(s, d):
    return _placed(s, d).select("id", "no", _r(rect_distance(F.col("x"), F.col("y"), *_RECTS[0].parts())).alias("distance"), _r(centre_distance(F.col("x"), F.col("y"), *_RECTS[0].parts())).alias("centre"))


@query("rule_first_match", f"SELECT id, no, {_FIRST_SQL} ELSE -1 END AS pred FROM ({_placed_sql()})")
def _(s, d):
    rows = _lines(s, d)
    return matched(rows.withColumn("pred", F.lit(-1)), _rules(rows)).select("id", "no", "pred")


@query("rule_range_join", f"SELECT id, no, {_FIRST_SQL} END AS rule FROM ({_placed_sql()})")
def _(s, d):
    p = _placed(s, d).select(F.struct("id", "no", "x", "y").alias("id"), "x", "y")
    rects = s.createDataFrame([(i, *map(float, q.parts())) for i, q in enumerate(_RECTS)], "rule int, left double, bottom double, width double, height double")
    return first_match(p, rects).select("id.id", "id.no", "rule")


@query("rule_nearest", f"SELECT id, no, coalesce({_FIRST_SQL} END, {_NEAR_SQL}) AS pred, CASE WHEN {_FIRST_SQL} END IS NULL THEN 3.0::DOUBLE ELSE 10.0::DOUBLE END AS weight FROM ({_placed_sql()})")
def _(s, d):
    rows = _lines(s, d)
    return scored(rows, _rules(rows)).select("id", "no", "pred", "weight")


# A rectangle around every part, in the plane of size and price, and the line items' quantities and discounts as points.
_PART_RECTS_SQL = "SELECT CAST(p_partkey AS INT) AS rule, (p_size % 50) / 50.0::DOUBLE AS left_, (p_partkey % 9973) / 9973.0::DOUBLE AS bottom, (p_size % 7) / 300.0::DOUBLE AS width, (p_partkey % 11) / 400.0::DOUBLE AS height FROM part"
_SHIP_POINTS_SQL = "SELECT l_orderkey AS id, l_linenumber AS no, (l_orderkey * 37 % 2003) / 1900.0::DOUBLE - 0.02 AS x, (l_partkey * 53 % 4001) / 3900.0::DOUBLE - 0.02 AS y FROM lineitem"


@query(
    "rule_nearest_table",
    f"""WITH r AS ({_PART_RECTS_SQL}), p AS ({_SHIP_POINTS_SQL}),
    u AS (SELECT DISTINCT x, y FROM p),
    a AS (SELECT x, y, NOT (x >= left_ AND x < left_ + width AND y >= bottom AND y < bottom + height) AS away, greatest(left_ - x, x - (left_ + width), bottom - y, y - (bottom + height), 0.0) AS d, rule FROM u, r),
    m AS (SELECT x, y, min(struct_pack(away := away, d := CASE WHEN away THEN d ELSE 0.0 END, rule := rule)) AS m FROM a GROUP BY x, y)
    SELECT id, no, m.rule AS rule, NOT m.away AS inside, round(m.d, 6) + 0.0 AS distance FROM p JOIN m USING (x, y)""",
)
def _(s, d):
    part = _table(s, d, "part").select(F.col("p_partkey").cast("int").alias("rule"), ((F.col("p_size") % 50) / F.lit(50.0)).alias("left"), ((F.col("p_partkey") % 9973) / F.lit(9973.0)).alias("bottom"), ((F.col("p_size") % 7) / F.lit(300.0)).alias("width"), ((F.col("p_partkey") % 11) / F.lit(400.0)).alias("height"))
    line = _table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("no"), ((F.col("l_orderkey") * 37 % 2003) / F.lit(1900.0) - 0.02).alias("x"), ((F.col("l_partkey") * 53 % 4001) / F.lit(3900.0) - 0.02).alias("y"))
    return nearest_rule(line, part).select("id", "no", "rule", "inside", _r("distance").alias("distance"))


@query("training_error", f"SELECT round(avg((cls <> pred)::INT), 6) + 0.0 AS error, round(avg((pred >= 0)::INT), 6) + 0.0 AS scored FROM (SELECT cls, {_FIRST_SQL} ELSE -1 END AS pred FROM ({_placed_sql()}))")
def _(s, d):
    rows = _lines(s, d)
    e = training_error(matched(rows.withColumn("pred", F.lit(-1)), _rules(rows)))
    return e.select(_r("error").alias("error"), _r("scored").alias("scored"))


@query(
    "ensemble_vote",
    """WITH v AS (SELECT event_id AS id, CAST(user_id % 3 AS INT) AS pred, 10.0 AS w FROM events UNION ALL SELECT event_id, CAST(event_id % 3 AS INT), 3.0 FROM events UNION ALL SELECT event_id, CAST((event_id + user_id) % 2 AS INT), 7.0 FROM events),
    t AS (SELECT id, pred, sum(w) AS w FROM v GROUP BY ALL) SELECT id, pred AS winner FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, pred) AS k FROM t) WHERE k = 1""",
)
def _(s, d):
    e = _table(s, d, "events").select(F.col("event_id").alias("id"), "user_id")
    one = lambda c, w: e.select("id", c.cast("int").alias("pred"), F.lit(w).alias("weight"))
    return vote(one(F.col("user_id") % 3, 10.0).union(one(F.col("id") % 3, 3.0)).union(one((F.col("id") + F.col("user_id")) % 2, 7.0)))


@query(
    "pair_run_summary",
    "SELECT count(*) AS pairs, CAST(count(*) FILTER (l_linenumber = 1) AS BIGINT) AS first_attempt, CAST(count(*) FILTER (l_linenumber > 1) AS BIGINT) AS more_attempts, round(avg(l_quantity), 6) + 0.0 AS mean_occupied, min(l_quantity) AS min_occupied, max(l_quantity) AS max_occupied, round(avg(l_suppkey + l_linenumber), 6) + 0.0 AS mean_invalid, max(l_suppkey + l_linenumber) AS max_invalid, CAST(sum(l_suppkey + l_linenumber) AS BIGINT) AS sum_invalid FROM lineitem",
)
def _(s, d):
    p = _table(s, d, "lineitem").select(F.col("l_linenumber").alias("attempts"), F.col("l_quantity").alias("occupied"), F.col("l_suppkey").alias("invalid_x"), F.col("l_linenumber").cast("long").alias("invalid_y"))
    return run_summary(p).withColumns({"mean_occupied": _r("mean_occupied"), "mean_invalid": _r("mean_invalid")})


@query("export_points", f"SELECT {_rd('x', 'PC1').replace('PC1', chr(34) + 'PC1' + chr(34))}, {_rd('y', 'PC2')}, l_returnflag AS label FROM ({_placed_sql()})")
def _(s, d):
    return points(_placed(s, d), label="l_returnflag").withColumns({"PC1": _r("PC1"), "PC2": _r("PC2")})


@query("exclude_label", f"SELECT {_rd('x', 'PC1')}, {_rd('y', 'PC2')}, ' Normal ' AS label FROM ({_placed_sql()}) WHERE false UNION ALL SELECT {_rd('x', 'PC1')}, {_rd('y', 'PC2')}, l_returnflag FROM ({_placed_sql()}) WHERE l_returnflag <> 'N'")
def _(s, d):
    named = _placed(s, d).withColumn("label", F.when(F.col("l_returnflag") == "N", F.lit(" Normal ")).otherwise(F.col("l_returnflag")))
    return points(named, exclude_normal=True).withColumns({"PC1": _r("PC1"), "PC2": _r("PC2")})


# An axis grown over stored sums: two terms, the second taken back, another one added.
@query("axis_accumulated", "SELECT o_orderkey AS id, round(o_totalprice - sqrt(o_custkey), 6) + 0.0 AS value, 2 AS valid FROM orders")
def _(s, d):
    rows = _table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    acc = AxisAccumulator(rows, "id", ["price", "customer"])
    acc.add(Term("price")).add(Term("customer", 1, "square")).rollback().add(Term("customer", -1, "sqrt"))
    return acc.values().select("id", _r("value").alias("value"), "valid")


# Occupancy of each class as bitmaps by return flag and line number, merged to return flags.
@query("occupancy_merged", f"SELECT l_returnflag, count(DISTINCT floor(least(greatest(x * {N}, 0), {N - 1}))) AS occupied_x, count(DISTINCT floor(least(greatest(y * {N}, 0), {N - 1}))) AS occupied_y, count(DISTINCT floor(least(greatest(x * {N}, 0), {N - 1})) * {N} + floor(least(greatest(y * {N}, 0), {N - 1}))) AS occupied FROM ({_placed_sql()}) GROUP BY l_returnflag")
def _(s, d):
    states = G.occupancy_states(_placed(s, d).withColumn("line", F.col("no")), N, keys=("l_returnflag", "line"))
    return G.occupied_cells(states, ("l_returnflag",))


@query("stream_grid_store", f"""WITH e AS (SELECT (event_id % 1000) / 1000.0::DOUBLE AS x, (user_id % 97) / 97.0::DOUBLE AS y, event_type FROM events)
    SELECT CAST(floor(least(greatest(0.99999::DOUBLE * x * {N}, 0), {N - 1})) AS INT) AS ix, CAST(floor(least(greatest(0.99999::DOUBLE * y * {N}, 0), {N - 1})) AS INT) AS iy, event_type, count(*) AS count FROM e GROUP BY ALL""")
def _(s, d):
    """The grid of the events that a stream of their files has left in a store; its batch replayed, then compacted."""
    schema = _table(s, d, "events").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")  # a pattern, as a stream takes no single file
    cells = lambda e: e.select(grid_cell((F.col("event_id") % 1000) / F.lit(1000.0), N).alias("ix"), grid_cell((F.col("user_id") % 97) / F.lit(97.0), N).alias("iy"), "event_type")
    store = GridStore(s, scratch_folder(s, "grid"), ("ix", "iy", "event_type"))
    store.start(cells(stream), scratch_folder(s, "grid-checkpoint"), once=True).awaitTermination()
    store.compact()
    return store.read()


_SQL_FORMS = ("none", "square", "sqrt", "log", "log_eps", "inverse", "inverse_eps", "sigmoid", "sigmoid_eps", "logit", "logit_eps")
# What both engines compute exactly isn't rounded; the rest is, by three operations that are exact in both: the engines'
# own round() parts them for large values.
_EXACT = ("none", "square", "sqrt", "inverse", "inverse_eps")


def _rounded_sql(t: str) -> str:
    form = _SQL_T[t].format(x="v")
    return f"CASE WHEN v IS NOT NULL THEN {form if t in _EXACT else f'round_even(({form}) * 1e6::DOUBLE, 0) / 1e6::DOUBLE'} + 0.0::DOUBLE END AS f_{t}"


@query("sql_functions", "SELECT event_id, " + ", ".join(map(_rounded_sql, _SQL_FORMS)) + ", CASE WHEN v IS NOT NULL THEN CAST(floor(least(greatest(0.99999::DOUBLE * value * 20, 0), 19)) AS INT) END AS cell, greatest(0.1::DOUBLE - value, value - 0.4::DOUBLE, 0.25::DOUBLE - value, value - 0.75::DOUBLE, 0.0::DOUBLE) AS away FROM (SELECT event_id, value, CASE WHEN NOT isnan(value) THEN value - 0.5::DOUBLE END AS v FROM events)")
def _(s, d):
    catalogue.register(s)
    e = _table(s, d, "events").withColumn("v", F.col("value") - 0.5)
    form = lambda t: F.call_function(f"axis_{t}", F.col("v"))
    forms = [((form(t) if t in _EXACT else F.rint(form(t) * 1e6) / F.lit(1e6)) + F.lit(0.0)).alias(f"f_{t}") for t in _SQL_FORMS]
    return e.select("event_id", *forms, F.call_function("axis_cell", F.col("value"), F.lit(20)).alias("cell"), F.call_function("rect_away", F.col("value"), F.col("value"), F.lit(0.1), F.lit(0.25), F.lit(0.3), F.lit(0.5)).alias("away"))


# algorithms that SQL can't express
def _generated(s: SparkSession, d: str, config: PairConfig) -> DataFrame:
    parts = s.sparkContext.defaultParallelism
    rows = _lines(s, d).select(*FEATURES, "cls")
    rows = rows if _table(s, d, "lineitem").rdd.getNumPartitions() >= parts else rows.repartition(parts)
    rows = rows if config.incremental else rows.cache()
    found = PairGenerator(rows, list(FEATURES), list(range(len(FEATURES))), N, config).generate()
    axis = lambda a: json.dumps([[t.sign, t.transform, t.feature] for t in a.terms])
    out = s.createDataFrame([(i, axis(m.x), axis(m.y), m.occupied) for i, m in enumerate(found)], "pair int, x string, y string, occupied long")
    rows.unpersist()
    return out


@query("pair_generation_incremental")
def _(s, d):
    return _generated(s, d, PairConfig())


@query("pair_generation_final")
def _(s, d):
    return _generated(s, d, PairConfig(pairs=2, incremental=False))


def _rich(s: SparkSession, d: str) -> DataFrame:
    """Customers in two classes that the account balance separates."""
    return _table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 97).cast("double").alias("b"), (F.col("c_acctbal") > 4500).cast("int").alias("cls"))


def _covered(s: SparkSession, d: str, ratio: float | None) -> DataFrame:
    at = placed(_rich(s, d), Axis((Term("a"), Term("b"))), Axis((Term("a"), Term("b", -1))))
    rects, rows = cover(Grid.collected(G.square_grid(at, N, 2), 1, N), min_rows=1, purity=0.75, ratio=ratio)
    return s.createDataFrame([(i, *map(float, q.parts()), rows) for i, q in enumerate(rects)], "rect int, left double, bottom double, width double, height double, covered long")


@query("rectangle_cover")
def _(s, d):
    return _covered(s, d, None)


@query("rectangle_cover_enhanced")
def _(s, d):
    return _covered(s, d, 0.001)


def _model(s: SparkSession, d: str) -> RectangleClassifier:
    """Three voters; fewer pairs and rules than the defaults, which take some minutes even for so small a table."""
    return RectangleClassifier(voters=3, seed=1, config=TrainerConfig(pairs=6, covered_pairs=3, max_rules=6)).fit(_rich(s, d), ["a", "b"], "cls")


@query("trainer_fit")
def _(s, d):
    m = _model(s, d)
    return s.createDataFrame([(i, k, r.cls, len(r.rects)) for i, v in enumerate(m.voters) for k, r in enumerate(v.rules)], "voter int, rule int, cls int, rects int")


@query("model_predict")
def _(s, d):
    return _model(s, d).transform(_rich(s, d).drop("cls"), "id")


@query("sparse_projection")
def _(s, d):
    st = S.class_statistics(_lines(s, d), list(FEATURES))
    means = S.collected_means(st, list(FEATURES), CLASSES)
    from .operators.search import sparse_projection

    w, score = sparse_projection(means, TARGET, list(range(len(FEATURES))), np.random.RandomState(1))
    return s.createDataFrame([(list(FEATURES)[j], sign, float(score)) for j, sign in w], "feature string, sign int, separation double")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Cells of a two-axis grid with class counts, purity and centre."""
    g = _grid(s, d)
    return g.select("ix", "iy", "count", *_flat(), (F.element_at("class_counts", TARGET + 1) / F.col("count")).alias("purity"), grid_cell(F.col("cx"), N).alias("centre_ix"))
