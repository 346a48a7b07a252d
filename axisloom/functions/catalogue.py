"""The transforms, cells and distances as functions of the session's catalogue, for spark.sql.

They are SQL functions: Catalyst puts their bodies into the query, so they are compiled with it and pushed down like
any expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import FUZZ1

_CLEAN = "nanvl(x, CAST(NULL AS DOUBLE))"
_LOG = "CASE WHEN {v} > 0 THEN ln({v}) WHEN {v} = 0 THEN -double('infinity') END"
_INVERSE = "CASE WHEN {v} = 0 THEN IF(CAST({v} AS STRING) = '-0.0', -double('infinity'), double('infinity')) ELSE 1.0D / {v} END"
_SIGMOID = "CASE WHEN {v} >= 0 THEN 1.0D / (1.0D + exp(-{v})) WHEN {v} = -double('infinity') THEN 0.0D WHEN {v} < 0 THEN exp({v}) / (1.0D + exp({v})) END"
_CLIP = "CASE WHEN {v} IS NOT NULL THEN greatest(least({v}, 1.0D - eps), eps) END"
_ODDS = "CASE WHEN {v} = 1 THEN double('infinity') WHEN {v} = 0 THEN -double('infinity') ELSE ln({v} / (1.0D - {v})) END"
_ONE, _EPS = "x DOUBLE", "x DOUBLE, eps DOUBLE DEFAULT 1e-10D"


def _body(pattern: str, value: str) -> str:
    return pattern.format(v=f"({value})")


#: Name to (parameters, result type, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "axis_none": (_ONE, "DOUBLE", _CLEAN),
    "axis_square": (_ONE, "DOUBLE", f"{_CLEAN} * {_CLEAN}"),
    "axis_sqrt": (_ONE, "DOUBLE", f"CASE WHEN {_CLEAN} < 0 THEN 0.0D ELSE sqrt({_CLEAN}) END"),
    "axis_log": (_ONE, "DOUBLE", _body(_LOG, _CLEAN)),
    "axis_log_eps": (_EPS, "DOUBLE", _body(_LOG, f"{_CLEAN} + eps")),
    "axis_inverse": (_ONE, "DOUBLE", _body(_INVERSE, _CLEAN)),
    "axis_inverse_eps": (_EPS, "DOUBLE", _body(_INVERSE, f"{_CLEAN} + eps")),
    "axis_sigmoid": (_ONE, "DOUBLE", _body(_SIGMOID, _CLEAN)),
    "axis_sigmoid_eps": (_EPS, "DOUBLE", _body(_CLIP, _body(_SIGMOID, _CLEAN))),
    "axis_logit": (_ONE, "DOUBLE", _body(_ODDS, _body(_SIGMOID, _CLEAN))),
    "axis_logit_eps": (_EPS, "DOUBLE", _body(_ODDS, _body(_CLIP, _body(_SIGMOID, _CLEAN)))),
    "axis_cell": ("x DOUBLE, n INT", "INT", f"CASE WHEN x IS NOT NULL AND NOT isnan({FUZZ1}D * x * n) THEN CAST(least(greatest({FUZZ1}D * x * n, 0.0D), CAST(n - 1 AS DOUBLE)) AS INT) END"),
    "rect_away": ("x DOUBLE, y DOUBLE, l DOUBLE, b DOUBLE, w DOUBLE, h DOUBLE", "DOUBLE", "greatest(l - x, x - (l + w), b - y, y - (b + h), 0.0D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Adds the functions to the session, replacing those of the same names; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
