"""Axes: signed sums of transformed features, their bounds, and normalised values.

With T terms of which v aren't missing in a row, the value is the sum of the valid terms, scaled by T / v
where 0 < v < T.  A row without a valid term has no value and is placed at 0.0.  The bounds of all axes of
a run come from one aggregation over one scan.

Terms, sums and values are columns of their own, one projection after the other, so that none is written
out twice in generated code.  Many axes at once are rows rather than columns: the distinct terms of a row
become one array, and a literal table says which of them each axis adds, so the code has the same size
for one pair and for a thousand.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON, FUZZ0
from ..functions.transforms import clean, transform


@dataclass(frozen=True)
class Term:
    feature: str
    sign: int = 1
    transform: str = "none"


@dataclass(frozen=True)
class Axis:
    """An immutable list of terms."""

    terms: tuple[Term, ...] = ()

    def add(self, feature: str, sign: int = 1, transform: str = "none") -> Axis:
        return Axis((*self.terms, Term(feature, sign, transform)))

    def drop_last(self) -> Axis:
        return Axis(self.terms[:-1])

    @classmethod
    def signed(cls, weights: list[int], transforms: list[str], features: list[str], legacy_index0: bool = True) -> Axis:
        """From signed feature positions; as -0 is 0, position 0 is never negative (``legacy_index0``)."""
        sign = lambda w: -1 if w < 0 else 1
        return cls(tuple(Term(features[abs(w)], sign(w) if w or legacy_index0 else 1, t) for w, t in zip(weights, transforms, strict=True)))

    def columns(self, epsilon: float = EPSILON, invalid: str = "nan") -> list[Column]:
        """Signed term columns, NULL where missing; ``nonfinite`` takes infinities for missing too."""
        out = []
        for t in self.terms:
            c = transform(clean(F.col(t.feature)), t.transform, epsilon)
            if invalid == "nonfinite":
                c = F.when(F.abs(c) < F.lit(float("inf")), c)
            out.append(-c if t.sign < 0 else c)
        return out

    def valid(self, epsilon: float = EPSILON, invalid: str = "nan") -> Column:
        """Number of terms that aren't missing."""
        return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in self.columns(epsilon, invalid)], F.lit(0))

    def value(self, epsilon: float = EPSILON, invalid: str = "nan") -> Column:
        """The axis value, NULL without a valid term."""
        cols = self.columns(epsilon, invalid)
        total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
        return _value(total, self.valid(epsilon, invalid), F.lit(len(cols)))


@dataclass(frozen=True)
class Bounds:
    low: float
    high: float

    @property
    def usable(self) -> bool:
        return self.low > float("-inf") and self.high < float("inf") and self.high > self.low


def widened(low: float | None, high: float | None) -> Bounds:
    """Bounds with a margin of FUZZ0 of the range, or of FUZZ0 around a single value; (0, 0) without values."""
    if low is None or high is None:
        return Bounds(0.0, 0.0)
    span = high - low
    if span == 0:
        return Bounds(low - FUZZ0, high + FUZZ0)
    return Bounds(low - FUZZ0 * span, high + FUZZ0 * span)


def _term_columns(df: DataFrame, axes: list[Axis], keep: list[str], epsilon: float, invalid: str) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """The columns in keep and one for each distinct (feature, transform) of the axes, and their names."""
    terms = list(dict.fromkeys((t.feature, t.transform) for a in axes for t in a.terms))
    features = list(dict.fromkeys(f for f, _ in terms))
    out = df.select(*keep, *[clean(F.col(f)).alias(f"__f{i}") for i, f in enumerate(features)])
    names = {t: f"__t{k}" for k, t in enumerate(terms)}
    out = out.select(*keep, *[transform(F.col(f"__f{features.index(f)}"), t, epsilon).alias(names[f, t]) for f, t in terms])
    if invalid == "nonfinite":
        out = out.select(*keep, *[F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c)).alias(c) for c in names.values()])
    return out, names


def term_arrays(axes: list[Axis], feature, epsilon: float = EPSILON) -> tuple[list[Column], dict[tuple[str, str], int]]:
    """The distinct (feature, transform) of the axes as columns over feature(name), NULL where missing, and their places."""
    terms = list(dict.fromkeys((t.feature, t.transform) for a in axes for t in a.terms))
    return [transform(clean(feature(f)), t, epsilon) for f, t in terms], {t: i for i, t in enumerate(terms)}


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _value(total: Column, valid: Column, n: Column) -> Column:
    """The sum scaled by n / valid, NULL if it is no number or nothing is valid.  Every argument is named once:
    filters on the result that the optimizer pushes down stay as small as the expression."""
    return F.nanvl(total * (n / F.nullif(valid, F.lit(0))), F.lit(None).cast("double"))


def with_values(df: DataFrame, axes: dict[str, Axis], epsilon: float = EPSILON, invalid: str = "nan") -> DataFrame:
    """df with the value of each named axis, NULL without a valid term, and the number of its valid terms as
    ``<name>_valid``."""
    keep = [c for c in df.columns if c not in axes]
    out, names = _term_columns(df, list(axes.values()), keep, epsilon, invalid)
    sums, values = [], []
    for k, (name, a) in enumerate(axes.items()):
        own = [F.col(names[t.feature, t.transform]) for t in a.terms]
        signed = [F.coalesce(-c if t.sign < 0 else c, F.lit(0.0)) for c, t in zip(own, a.terms, strict=True)]
        sums += [_add(signed or [F.lit(0.0)]).alias(f"__s{k}"), _add([c.isNotNull().cast("int") for c in own] or [F.lit(0)]).alias(f"{name}_valid")]
        values.append(_value(F.col(f"__s{k}"), F.col(f"{name}_valid"), F.lit(max(1, len(own)))).alias(name))
    counts = [f"{name}_valid" for name in axes]
    return out.select(*keep, *sums).select(*keep, *counts, *values)


def with_placed(df: DataFrame, axes: dict[str, tuple[Axis, Bounds]], epsilon: float = EPSILON, invalid: str = "nan") -> DataFrame:
    """df with each named axis placed in [0, 1] by its bounds; 0.0 without a valid term and for unusable bounds."""
    keep = [c for c in df.columns if c not in axes]
    out = with_values(df, {name: a for name, (a, _) in axes.items()}, epsilon, invalid)
    at = {name: F.coalesce((F.col(name) - F.lit(b.low)) / F.lit(b.high - b.low), F.lit(0.0)) if b.usable else F.lit(0.0) for name, (_, b) in axes.items()}
    return out.select(*keep, *[c.alias(name) for name, c in at.items()])


def many_values(df: DataFrame, rows: list[tuple[Axis, ...]], keep: tuple[str, ...] = (), at: list[tuple[Bounds, ...]] | None = None, epsilon: float = EPSILON, invalid: str = "nan") -> DataFrame:
    """(keep, row, v0, v1, ...): for every row of df and every tuple of axes, the tuple's place in the list and
    the values of its axes; with bounds, values placed in [0, 1] as with_placed does."""
    width, size = max(map(len, rows)), max(1, *(len(a.terms) for r in rows for a in r))
    out, names = _term_columns(df, [a for r in rows for a in r], list(keep), epsilon, invalid)
    place = {t: i for i, t in enumerate(names)}
    specs, fields = [], ["row int"]
    for i, r in enumerate(rows):
        spec: dict = {"row": i}
        for k, a in enumerate(r):
            spec[f"n{k}"] = len(a.terms)
            spec |= {f"i{k}_{j}": place[t.feature, t.transform] for j, t in enumerate(a.terms)}
            spec |= {f"s{k}_{j}": float(-1 if t.sign < 0 else 1) for j, t in enumerate(a.terms)}
            if at and at[i][k].usable:
                spec |= {f"low{k}": at[i][k].low, f"span{k}": at[i][k].high - at[i][k].low}
        specs.append(spec)
    for k in range(width):
        fields += [f"n{k} int", f"low{k} double", f"span{k} double", *[f"i{k}_{j} int, s{k}_{j} double" for j in range(size)]]
    table = F.from_json(F.lit(json.dumps(specs)), f"array<struct<{', '.join(f.replace(' ', ':') for part in fields for f in part.split(', ')) }>>")
    out = out.select(*keep, F.array(*[F.col(c) for c in names.values()]).cast("array<double>").alias("__terms"), F.explode(table).alias("__a"))
    terms = [F.get("__terms", F.col(f"__a.i{k}_{j}")) * F.col(f"__a.s{k}_{j}") for k in range(width) for j in range(size)]
    part = [f"__p{i}" for i in range(width * size)]
    out = out.select(*keep, "__a", *[c.alias(p) for c, p in zip(terms, part, strict=True)])
    sums = []
    for k in range(width):
        own = [F.col(p) for p in part[k * size : (k + 1) * size]]
        sums += [_add([F.coalesce(c, F.lit(0.0)) for c in own]).alias(f"__s{k}"), _add([c.isNotNull().cast("int") for c in own]).alias(f"__v{k}")]
    out = out.select(*keep, "__a", *sums)
    out = out.select(*keep, "__a", *[_value(F.col(f"__s{k}"), F.col(f"__v{k}"), F.col(f"__a.n{k}")).alias(f"v{k}") for k in range(width)])
    final = [F.coalesce((F.col(f"v{k}") - F.col(f"__a.low{k}")) / F.col(f"__a.span{k}"), F.lit(0.0)).alias(f"v{k}") if at else F.col(f"v{k}") for k in range(width)]
    return out.select(*keep, F.col("__a.row").alias("row"), *final)


def bounds_table(df: DataFrame, axes: list[Axis], epsilon: float = EPSILON, invalid: str = "nan") -> DataFrame:
    """(axis, low, high) of every axis, lazily: one aggregation to a row per axis; none for an empty table."""
    found = many_values(df, [(a,) for a in axes], epsilon=epsilon, invalid=invalid).groupBy(F.col("row").alias("axis")).agg(F.min("v0").alias("lo"), F.max("v0").alias("hi"))
    span = F.col("hi") - F.col("lo")
    margin = F.when(span == 0, F.lit(FUZZ0)).otherwise(F.lit(FUZZ0) * span)
    return found.select("axis", (F.col("lo") - margin).alias("low"), (F.col("hi") + margin).alias("high"))


def bounds(df: DataFrame, axes: list[Axis], epsilon: float = EPSILON, invalid: str = "nan") -> list[Bounds]:
    """Bounds of all axes, by one job; (0, 0) for an axis without values."""
    own = list(dict.fromkeys(axes))
    rows = many_values(df, [(a,) for a in own], epsilon=epsilon, invalid=invalid).groupBy("row").agg(F.min("v0").alias("lo"), F.max("v0").alias("hi")).collect()
    found = {own[r["row"]]: widened(r["lo"], r["hi"]) for r in rows}
    return [found.get(a, Bounds(0.0, 0.0)) for a in axes]


def legacy_bounds(df: DataFrame, axes: list[Axis]) -> list[Bounds]:
    """Bounds as the trainer takes them, by one job: plain sums of the features, in which a row without any term counts as 0;
    the upper margin starts from the range that the lower one has widened, and a single value gets no margin."""
    own = list(dict.fromkeys(Axis(tuple(Term(t.feature, t.sign) for t in a.terms)) for a in axes))
    value = F.coalesce("v0", F.lit(0.0))
    rows = many_values(df, [(a,) for a in own]).groupBy("row").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
    by_axis = {own[r["row"]]: (r["lo"], r["hi"]) for r in rows if r["lo"] is not None}
    found = {i: by_axis[plain] for i, a in enumerate(axes) if (plain := Axis(tuple(Term(t.feature, t.sign) for t in a.terms))) in by_axis}
    out = []
    for i in range(len(axes)):
        lo, hi = found.get(i, (0.0, 0.0))
        lo -= FUZZ0 * (hi - lo)
        out.append(Bounds(lo, hi + FUZZ0 * (hi - lo)))
    return out


def normalised(axis: Axis, b: Bounds, epsilon: float = EPSILON, invalid: str = "nan") -> Column:
    """The value placed in [0, 1] as one expression, for short axes; 0.0 for rows without a valid term and for
    unusable bounds."""
    if not b.usable or not axis.terms:
        return F.lit(0.0)
    return F.coalesce((axis.value(epsilon, invalid) - F.lit(b.low)) / F.lit(b.high - b.low), F.lit(0.0))


def placed(df: DataFrame, x: Axis, y: Axis, epsilon: float = EPSILON, invalid: str = "nan") -> DataFrame:
    """df with the normalised columns x and y."""
    bx, by = bounds(df, [x, y], epsilon, invalid)
    return with_placed(df, {"x": (x, bx), "y": (y, by)}, epsilon, invalid)


def placed_pairs(df: DataFrame, pairs: list[tuple[Axis, Axis]], at: list[tuple[Bounds, Bounds]] | None = None, keep: tuple[str, ...] = ("cls",), epsilon: float = EPSILON) -> DataFrame:
    """(pair, keep, x, y): every row once for each pair, placed by the pair's bounds (found by one job unless given)."""
    if at is None:
        flat = bounds(df, [a for p in pairs for a in p], epsilon)
        at = [(flat[2 * i], flat[2 * i + 1]) for i in range(len(pairs))]
    return many_values(df, pairs, keep, at, epsilon).select(F.col("row").alias("pair"), *keep, F.col("v0").alias("x"), F.col("v1").alias("y"))


def invalid_stats(df: DataFrame, axis: Axis, epsilon: float = EPSILON) -> DataFrame:
    """(rows, fully_invalid, partly_invalid) of an axis."""
    v, n = F.col("axis_valid"), len(axis.terms)
    return with_values(df, {"axis": axis}, epsilon).agg(F.count("*").alias("rows"), F.sum((v == 0).cast("long")).alias("fully_invalid"), F.sum(((v > 0) & (v < n)).cast("long")).alias("partly_invalid"))
