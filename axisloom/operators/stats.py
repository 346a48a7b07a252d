"""Class statistics, moments, separation, and the normality-driven choice of transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FUZZ0
from ..functions.normal import upper_tail
from ..functions.transforms import INF, clean, signed_sqrt, standardise


def class_statistics(df: DataFrame, features: list[str], cls: str = "cls", pred: str | None = None) -> DataFrame:
    """(cls, count, mean_<feature>...) over labelled, open rows.

    A mean is the sum of the known values over all rows of the class.
    """
    keep = F.col(cls) >= 0
    if pred:
        keep = keep & (F.coalesce(F.col(pred), F.lit(-1)) < 0)
    means = [(F.sum(F.coalesce(clean(F.col(f)), F.lit(0.0))) / F.count("*")).alias(f"mean_{f}") for f in features]
    return df.filter(keep).groupBy(F.col(cls).alias("cls")).agg(F.count("*").alias("count"), *means)


def collected_means(stats: DataFrame, features: list[str], n_classes: int) -> list[list[float]]:
    """Means by class and feature on the driver (classes x features numbers); absent classes have zeros."""
    out = [[0.0] * len(features) for _ in range(n_classes)]
    for r in stats.collect():
        out[r["cls"]] = [float(r[f"mean_{f}"]) for f in features]
    return out


def separation(means: list[list[float]], target: int) -> list[float]:
    """For each feature the least distance of the target's mean from another class's."""
    others = [m for k, m in enumerate(means) if k != target]
    return [min((abs(means[target][j] - m[j]) for m in others), default=0.0) for j in range(len(means[target]))]


def composite_separation(means: list[list[float]], target: int, weights: list[tuple[int, int]]) -> float:
    """The same for the signed mean of some features, given as (feature, sign); missing means are skipped."""

    def at(m: list[float]) -> float:
        known = [s * m[j] for j, s in weights if not math.isnan(m[j])]
        return sum(known) / len(known) if known else 0.0

    return min((abs(at(means[target]) - at(m)) for k, m in enumerate(means) if k != target), default=0.0)


def separation_table(stats: DataFrame, features: list[str], target: int) -> DataFrame:
    """(feature, separation) as a DataFrame: class means against class means."""
    long = stats.select("cls", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"mean_{f}").alias("mean")) for f in features])).alias("m")).select("cls", "m.*")
    own = long.filter(F.col("cls") == target).select("feature", F.col("mean").alias("own"))
    return long.filter(F.col("cls") != target).join(own, "feature").groupBy("feature").agg(F.min(F.abs(F.col("own") - F.col("mean"))).alias("separation"))


def top_features(separations: list[float], m: int) -> list[int]:
    """Positions of the m features of largest separation, ties by position; all in order if there are fewer."""
    if len(separations) < m:
        return list(range(len(separations)))
    return sorted(range(len(separations)), key=lambda j: (-separations[j], j))[:m]


def separating(separations: list[float]) -> list[int]:
    """Positions with a separation above 0, or all if there are none."""
    return [j for j, s in enumerate(separations) if s > 0] or list(range(len(separations)))


def _finite(x: Column) -> Column:
    x = clean(x)
    return F.when(F.abs(x) < F.lit(INF), x)


def moments(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, mean, variance, sd, skewness, kurtosis): sample moments of the finite values.

    Too few rows (2, 3 and 4 are the least) or no spread give NULL.
    """
    aggs = []
    for f in features:
        x = _finite(F.col(f))
        aggs += [F.count(x).alias(f"{f}|n"), F.avg(x).alias(f"{f}|mean"), F.var_samp(x).alias(f"{f}|var"), F.skewness(x).alias(f"{f}|g1"), F.kurtosis(x).alias(f"{f}|g2")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"`{f}|{p}`").alias(p) for p in ("n", "mean", "var", "g1", "g2")]) for f in features])
    m = one.select(F.explode(rows).alias("m")).select("m.*")
    n = F.col("n").cast("double")
    known = lambda c: F.when(~F.isnan(c), c)
    return m.select(
        "feature",
        "n",
        "mean",
        F.when(n >= 2, F.col("var")).alias("variance"),
        F.when(n >= 2, F.sqrt("var")).alias("sd"),
        F.when(n >= 3, known(F.col("g1") * F.sqrt(n * (n - 1)) / F.when(n >= 3, n - 2))).alias("skewness"),
        F.when(n >= 4, known((n - 1) / F.when(n >= 4, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))).alias("kurtosis"),
    )


def sqrt_features(df: DataFrame, features: list[str]) -> list[str]:
    """Features to take the signed root of: p-values of skewness and kurtosis, the j-th smallest of p of
    them (from 0) against 0.01 * j / p, each tested alone."""
    n = df.count()
    if n < 4:
        return []
    found = {r["feature"]: r for r in moments(df, features).collect()}
    flagged = set()
    for name, scale, tail in (("skewness", 6, lambda z: upper_tail(abs(z))), ("kurtosis", 24, upper_tail)):
        value = lambda f, name=name: float("nan") if found[f][name] is None else found[f][name]
        p = sorted((tail(value(f) / math.sqrt(scale / n)), i, f) for i, f in enumerate(features))
        flagged |= {f for j, (v, _, f) in enumerate(p) if v < 0.01 * j / len(features)}
    return [f for f in features if f in flagged]


def limits(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of every feature, a margin of FUZZ0 of the range on each side; the upper
    margin starts from the widened lower limit."""
    row = df.agg(*[f(clean(F.col(c))).alias(f"{n}|{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in features:
        lo, hi = row[f"lo|{c}"], row[f"hi|{c}"]
        if lo is None:
            out[c] = (0.0, 0.0)
            continue
        lo -= FUZZ0 * (hi - lo)
        out[c] = (lo, hi + FUZZ0 * (hi - lo))
    return out


def standardised(df: DataFrame, features: list[str], at: dict[str, tuple[float, float]], roots: list[str] = ()) -> DataFrame:
    """df with its features rooted where asked and scaled to the limits (of the rooted features)."""
    return df.withColumns({f: standardise(signed_sqrt(clean(F.col(f))) if f in roots else clean(F.col(f)), F.lit(at[f][0]), F.lit(at[f][1])) for f in features})
