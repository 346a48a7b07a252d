"""Sample moments as states that can be stored by slice and merged.

A state is (n, mean, m2, m3, m4): the number of finite values, their mean, and the sums of the powers of their
differences from it.  States of slices merge to the state of their union, so totals by any coarser key, and late slices,
need no row to be read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import clean

STATE = ("n", "mean", "m2", "m3", "m4")


def _finite(x: Column) -> Column:
    x = clean(x)
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def moment_states(df: DataFrame, features: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, feature, n, mean, m2, m3, m4) by one aggregation, partial before the shuffle; slices without a finite value have
    n = 0 and null sums."""
    aggs = []
    for f in features:
        x = _finite(F.col(f))
        aggs += [F.count(x).alias(f"{f}|n"), F.avg(x).alias(f"{f}|mean"), F.var_pop(x).alias(f"{f}|v"), F.skewness(x).alias(f"{f}|s"), F.kurtosis(x).alias(f"{f}|k")]
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"`{f}|{p}`").alias(p) for p in ("n", "mean", "v", "s", "k")]) for f in features])
    m = df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(rows))
    n, v = F.col("n").cast("double"), F.col("v")
    # skewness and kurtosis are NaN or null without spread, where the sums are 0
    spread = v > 0
    m3, m4 = F.when(spread, F.col("s") * v * F.sqrt(v) * n).when(n > 0, 0.0), F.when(spread, (F.col("k") + 3) * v * v * n).when(n > 0, 0.0)
    return m.select(*keys, "feature", "n", "mean", (v * n).alias("m2"), m3.alias("m3"), m4.alias("m4"))


def merged_moments(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The states of the unions of slices that share keys and feature; states without values change nothing."""
    by = [*keys, "feature"]
    some = states.filter("n > 0").select(*by, *[F.col(c).alias(f"own_{c}") for c in STATE])
    n = F.col("own_n").cast("double")
    total = states.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("n") > 0, F.col("n") * F.col("mean"))) / F.sum("n")).alias("mean"))
    known = total.select(*[F.col(c).alias(f"k_{c}") for c in by], "n", "mean")
    match = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in by]
    at = known.join(some, match, "left")
    d = F.col("own_mean") - F.col("mean")
    m2, m3, m4 = F.col("own_m2"), F.col("own_m3"), F.col("own_m4")
    sums = [F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"), F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4")]
    out = at.groupBy(*[f"k_{c}" for c in by], "n", "mean").agg(*sums)
    return out.select(*[F.col(f"k_{c}").alias(c) for c in by], *STATE)


def finished_moments(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, feature, n, mean, variance, sd, skewness, kurtosis) of states, as stats.moments gives them: NULL for too few rows
    (2, 3 and 4 are the least) and, of the last two, without spread."""
    n, v = F.col("n").cast("double"), F.col("m2") / F.col("n")
    spread = v > 0
    variance = F.when(n >= 2, F.col("m2") / (n - 1))
    g1, g2 = F.col("m3") / n / (v * F.sqrt(v)), F.col("m4") / n / (v * v) - 3
    skew = F.when((n >= 3) & spread, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n >= 4) & spread, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return states.select(*keys, "feature", "n", "mean", variance.alias("variance"), F.sqrt(variance).alias("sd"), skew.alias("skewness"), kurt.alias("kurtosis"))
