"""Quality metrics of grids for a target class, for many pairs at once.

Input: (pair, ix, iy, count, class_counts) as square_grid gives it with keys=("pair",).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grid import class_count

#: Cells whose distances to all others are held at once.
LATTICE_ROWS = 256


def _cells(grid: DataFrame, target: int) -> DataFrame:
    t = class_count(target)
    return grid.select("pair", "ix", "iy", F.col("count").alias("cnt"), t.alias("t"), (F.col("count") - t).alias("n"), (t / F.col("count")).alias("p"))


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def simple_metrics(grid: DataFrame, target: int) -> DataFrame:
    """(pair, bp, purity_weighted, coverage_p70, jsd, target_total, non_target_total, occupied_bins, pure)."""
    c = _cells(grid, target)
    tot = W.partitionBy("pair")
    c = c.withColumns({"tt": F.sum("t").over(tot), "nn": F.sum("n").over(tot)})
    a, b = _ratio(F.col("t"), F.col("tt")), _ratio(F.col("n"), F.col("nn"))
    m = (a + b) / 2
    part = lambda v: F.when(v > 0, v * F.log(F.when(v > 0, v / m))).otherwise(0.0)
    js = F.sum(F.lit(0.5) * part(a) + F.lit(0.5) * part(b)) / F.lit(math.log(2))
    out = c.groupBy("pair").agg(
        _ratio(F.sum(F.col("t") * F.col("t") / F.col("cnt")), F.sum("t")).alias("bp"),
        _ratio(F.sum(F.col("p") * F.col("cnt")), F.sum("cnt")).alias("purity_weighted"),
        _ratio(F.sum(F.when(F.col("p") >= 0.70, F.col("t")).otherwise(0)), F.sum("t")).alias("coverage_p70"),
        js.alias("js"),
        F.sum("t").alias("target_total"),
        F.sum("n").alias("non_target_total"),
        F.count("*").alias("occupied_bins"),
        F.sum(F.when(F.col("n") == 0, F.col("t")).otherwise(0)).alias("pure"),
    )
    return out.withColumn("jsd", F.when((F.col("target_total") > 0) & (F.col("non_target_total") > 0), F.col("js")).otherwise(F.lit(0.0))).drop("js")


def threshold_metrics(grid: DataFrame, target: int) -> DataFrame:
    """(pair, auc, f1): over purity thresholds from high to low, cells of equal purity taken together."""
    g = _cells(grid, target).groupBy("pair", "p").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    order = W.partitionBy("pair").orderBy(F.col("p").desc())
    upto, tot = order.rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy("pair")
    g = g.withColumns({"tp": F.sum("t").over(upto), "fp": F.sum("n").over(upto), "tt": F.sum("t").over(tot), "nn": F.sum("n").over(tot)})
    g = g.withColumns({"tpr": _ratio(F.col("tp"), F.col("tt")), "fpr": _ratio(F.col("fp"), F.col("nn"))})
    g = g.withColumns({"tpr0": F.lag("tpr", 1, 0.0).over(order), "fpr0": F.lag("fpr", 1, 0.0).over(order)})
    f1 = _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("tt"))
    out = g.groupBy("pair").agg(F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2).alias("area"), F.max(f1).alias("f1"), F.max("tt").alias("tt"), F.max("nn").alias("nn"))
    return out.select("pair", F.when((F.col("tt") > 0) & (F.col("nn") > 0), F.col("area")).otherwise(F.lit(0.5)).alias("auc"), F.when(F.col("tt") > 0, F.col("f1")).otherwise(F.lit(0.0)).alias("f1"))


def _distance_sums(ix: np.ndarray, iy: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """For every cell, and every column of weights, the sum of weight times distance over all cells.

    Distances of centres depend on how far cells are apart alone: a table of n * n holds them all, and a block of cells
    at a time is multiplied with the weights.
    """
    far = np.sqrt(np.add.outer(np.arange(n, dtype=np.float64) ** 2, np.arange(n, dtype=np.float64) ** 2)) / n
    out = np.empty(weights.shape)
    for at in range(0, len(ix), LATTICE_ROWS):
        k = slice(at, at + LATTICE_ROWS)
        out[k] = far[np.abs(ix[k, None] - ix), np.abs(iy[k, None] - iy)] @ weights
    return out


def _target_silhouette(sums: np.ndarray, counts: np.ndarray, total: np.ndarray, target: int) -> float:
    """sums and counts by class, total counts of the cells."""
    t = counts[:, target]
    tt, nn = t.sum(), (total - t).sum()
    if not (t > 0).any() or tt <= 1 or nn <= 0:
        return 0.0
    a, b = sums[:, target] / (tt - 1), (sums[:, -1] - sums[:, target]) / nn
    big = np.maximum(a, b)
    s = np.divide(b - a, big, out=np.zeros_like(big), where=big > 0)
    return float((t * s)[t > 0].sum() / tt)


def _class_silhouette(sums: np.ndarray, counts: np.ndarray) -> float | None:
    size = counts.sum(axis=0)
    if not size.sum():
        return None
    with np.errstate(all="ignore"):
        a = np.where(size > counts, sums / (size - counts), np.nan)
        mean = np.where(size > 0, sums / size, np.inf)
    total = 0.0
    for c in np.flatnonzero(size):
        rest = np.delete(mean, c, axis=1)
        b = rest.min(axis=1) if rest.shape[1] else np.full(len(mean), np.inf)
        big = np.maximum(a[:, c], b)
        ok = (counts[:, c] > 0) & ~np.isnan(a[:, c]) & np.isfinite(b) & (big > 0)
        total += (counts[ok, c] * (b[ok] - a[ok, c]) / big[ok]).sum()
    return float(total / size.sum())


def silhouettes(grid: DataFrame, target: int, n: int) -> DataFrame:
    """(pair, sil, sil_all) by one shuffle of the cells, of which a pair has at most n * n: no cell is joined with another.

    sil: target against the rest, by distances of cell centres weighted with counts; 0 for fewer than two target
    rows and without others.  sil_all: each class against its nearest other class.  In a class of N rows a cell of
    w rows is at mean distance sum / (N - w) of its class; classes in one cell only are skipped as owners but
    stay in the denominator.
    """
    key = T.StructType([grid.schema["pair"], T.StructField("sil", T.DoubleType()), T.StructField("sil_all", T.DoubleType())])

    def measured(table: pa.Table) -> pa.Table:
        ix, iy = (table[c].to_numpy().astype(np.int64) for c in ("ix", "iy"))
        counts = np.array(table["class_counts"].to_pylist(), dtype=np.float64).reshape(len(ix), -1)
        total = table["count"].to_numpy().astype(np.float64)
        sums = _distance_sums(ix, iy, np.column_stack([counts, total]), n)
        found = [_target_silhouette(sums, counts, total, target)], [_class_silhouette(sums[:, :-1], counts)]
        return pa.table({"pair": table["pair"].slice(0, 1), "sil": pa.array(found[0], pa.float64()), "sil_all": pa.array(found[1], pa.float64())})

    return grid.select("pair", "ix", "iy", "count", "class_counts").groupBy("pair").applyInArrow(measured, key)


def silhouette(grid: DataFrame, target: int, n: int) -> DataFrame:
    """(pair, sil) of silhouettes()."""
    return silhouettes(grid, target, n).select("pair", "sil")


def silhouette_all(grid: DataFrame, n: int) -> DataFrame:
    """(pair, sil_all) of silhouettes(); NULL for pairs without a row of a known class."""
    return silhouettes(grid, 0, n).select("pair", "sil_all")


def all_metrics(grid: DataFrame, target: int, n: int) -> DataFrame:
    """Every metric of every pair."""
    return simple_metrics(grid, target).join(threshold_metrics(grid, target), "pair").join(silhouettes(grid, target, n), "pair")


#: Names of metrics to their columns.
METRICS = {"bp": "bp", "purity_weighted": "purity_weighted", "coverage_p70": "coverage_p70", "auc": "auc", "f1": "f1", "f1max": "f1", "jsd": "jsd", "sil": "sil", "silhouette": "sil", "sil_all": "sil_all", "silhouette_all": "sil_all", "sil_multi": "sil_all", "silhouette_multi": "sil_all", "pure": "pure"}


def ranking_score(grid: DataFrame, target: int, n: int, metric: str) -> DataFrame:
    """(pair, score); an unknown metric scores 0."""
    column = METRICS.get(metric)
    if column is None:
        return grid.select("pair").distinct().withColumn("score", F.lit(0.0))
    source = threshold_metrics(grid, target) if column in ("auc", "f1") else silhouette(grid, target, n) if column == "sil" else silhouette_all(grid, n) if column == "sil_all" else simple_metrics(grid, target)
    return source.select("pair", F.col(column).cast("double").alias("score"))


def rank_pairs(grid: DataFrame, target: int, n: int, metric: str) -> DataFrame:
    """(pair, score, rank): best first, ties by pair."""
    return ranking_score(grid, target, n, metric).withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "pair")))
