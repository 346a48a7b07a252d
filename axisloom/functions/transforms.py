"""Feature transforms as column expressions.

The input is a double column in which NULL means missing (``clean`` turns NaN into NULL).  A result that
isn't a number is NULL; infinities stay.  Every division and logarithm is guarded, so the expressions give
the same under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPSILON

INF = float("inf")


def clean(x: Column) -> Column:
    """x as double, NaN as NULL."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def _log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.log(x))


def _inverse(x: Column) -> Column:
    # the two zeros are equal, but not as text
    return F.when(x == 0, F.when(x.cast("string") == "-0.0", F.lit(-INF)).otherwise(F.lit(INF))).otherwise(F.lit(1.0) / x)


def _sigmoid(x: Column) -> Column:
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).when(x == F.lit(-INF), F.lit(0.0)).when(x < 0, F.exp(x) / (F.lit(1.0) + F.exp(x)))


def _clip(x: Column, eps: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0 - eps)), F.lit(eps)))


def _odds(p: Column) -> Column:
    return F.when(p == 1, F.lit(INF)).when(p == 0, F.lit(-INF)).otherwise(F.log(p / (F.lit(1.0) - p)))


#: Name to (column, epsilon) -> column.
TRANSFORMS: dict[str, Callable[[Column, float], Column]] = {
    "none": lambda x, e: x,
    "square": lambda x, e: x * x,
    "sqrt": lambda x, e: F.when(x < 0, F.lit(0.0)).otherwise(F.sqrt(x)),
    "log": lambda x, e: _log(x),
    "log_eps": lambda x, e: _log(x + F.lit(e)),
    "inverse": lambda x, e: _inverse(x),
    "inverse_eps": lambda x, e: _inverse(x + F.lit(e)),
    "sigmoid": lambda x, e: _sigmoid(x),
    "sigmoid_eps": lambda x, e: _clip(_sigmoid(x), e),
    "logit": lambda x, e: _odds(_sigmoid(x)),
    "logit_eps": lambda x, e: _odds(_clip(_sigmoid(x), e)),
}

#: Guarded twin of the transforms that can give infinities.
EPS_TWIN = {"log": "log_eps", "inverse": "inverse_eps", "logit": "logit_eps", "sigmoid": "sigmoid_eps"}


def transform(x: Column, name: str = "none", epsilon: float = EPSILON) -> Column:
    """The named transform of x; unknown names leave x as it is."""
    return TRANSFORMS.get(name, TRANSFORMS["none"])(x, epsilon)


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def standardise(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); 0 where the range is empty."""
    return F.when(high > low, (x - low) / (high - low)).when(x.isNotNull(), F.lit(0.0))
