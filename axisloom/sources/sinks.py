"""Sinks: grid and point JSON, plot tables, run configuration and summaries."""

from __future__ import annotations

import json
import os
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PairConfig
from ..functions.geometry import cell_centre, marker_size
from ..functions.labels import axis_terms, formula
from ..operators.axis import Axis
from ..operators.grid import class_count, dominant


def points(df: DataFrame, x: str = "x", y: str = "y", label: str = "label", exclude_normal: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, PC1, PC2, label), optionally without rows labelled normal."""
    out = df.select(*keep, F.col(x).alias("PC1"), F.col(y).alias("PC2"), F.col(label).alias("label"))
    return out.filter(F.lower(F.trim("label")) != "normal") if exclude_normal else out


def write_points(df: DataFrame, path: str, **how) -> None:
    """One JSON object a line, written by the executors."""
    points(df, **how).write.mode("overwrite").json(path)


def grid_document(grid: DataFrame, n: int, target: int, names: list[str], ids: list[int], x: Axis, y: Axis, pure: int, features: list[str] | None = None) -> dict:
    """The occupied cells of one grid (at most n * n) as a document of parallel arrays.

    With features, projection_weights_x and _y hold the signed places of the terms' features in that list; otherwise
    places in the order in which the axes name them.
    """
    features = features or list(dict.fromkeys(t.feature for a in (x, y) for t in a.terms))
    weights = lambda a: [(-1 if t.sign < 0 else 1) * features.index(t.feature) for t in a.terms]
    rows = dominant(grid).orderBy("ix", "iy").collect()
    shares = [{names[c]: {"percentage": 100.0 * k / r["count"], "count": k, "class_id": c, "original_class_id": ids[c]} for c, k in enumerate(r["class_counts"]) if k} for r in rows]
    return {
        "bin_center_x": [(r["ix"] + 0.5) / n for r in rows],
        "bin_center_y": [(r["iy"] + 0.5) / n for r in rows],
        "bin_counts": [r["count"] for r in rows],
        "dominant_class_id": [ids[r["dominant"]] for r in rows],
        "dominant_class_name": [names[r["dominant"]] for r in rows],
        "target_class_purity": [r["class_counts"][target] / r["count"] for r in rows],
        "class_percentages": shares,
        "target_class_id": ids[target],
        "target_class_name": names[target],
        "axis1_features": axis_terms(x),
        "axis2_features": axis_terms(y),
        "best_purity_P": float(pure),
        "n_bins": n,
        "projection_weights_x": weights(x),
        "projection_weights_y": weights(y),
        "x_transforms": [t.transform for t in x.terms],
        "y_transforms": [t.transform for t in y.terms],
    }


def grid_documents(grid: DataFrame, n: int, target: int, names: list[str], ids: list[int], pairs: list[tuple[Axis, Axis]], features: list[str]) -> DataFrame:
    """(pair, pure, document) for the grids of many pairs (pair: place in the list): the document of grid_document() as JSON
    text, made by one aggregation of the cells, of which a pair has at most n * n."""
    each = F.array(*[F.struct(F.lit(names[c]).alias("name"), F.lit(c).alias("class_id"), F.lit(ids[c]).alias("original_class_id")) for c in range(len(names))])
    cell = dominant(grid).select("pair", F.struct("ix", "iy", "count", "dominant", "class_counts").alias("c"))
    cells = cell.groupBy("pair").agg(F.sort_array(F.collect_list("c")).alias("cells"))
    weights = lambda a: [(-1 if t.sign < 0 else 1) * features.index(t.feature) for t in a.terms]
    fixed = [(i, axis_terms(x), axis_terms(y), weights(x), weights(y), [t.transform for t in x.terms], [t.transform for t in y.terms]) for i, (x, y) in enumerate(pairs)]
    text, whole = "array<string>", "array<int>"
    named = grid.sparkSession.createDataFrame(fixed, f"pair int, axis1_features {text}, axis2_features {text}, projection_weights_x {whole}, projection_weights_y {whole}, x_transforms {text}, y_transforms {text}")
    at = cells.join(F.broadcast(named), "pair").withColumn("__each", each)  # a row for each pair
    of = lambda f: F.transform("cells", f)
    hit = lambda c: F.element_at(c["class_counts"], target + 1)

    def shares(c: Column) -> Column:
        entry = lambda e: F.struct(e["name"].alias("key"), F.struct((F.lit(100.0) * F.element_at(c["class_counts"], e["class_id"] + 1) / c["count"]).alias("percentage"), F.element_at(c["class_counts"], e["class_id"] + 1).alias("count"), e["class_id"].alias("class_id"), e["original_class_id"].alias("original_class_id")).alias("value"))
        return F.map_from_entries(F.transform(F.filter("__each", lambda e: F.element_at(c["class_counts"], e["class_id"] + 1) > 0), entry))

    pure = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(hit(c) == c["count"], hit(c)).otherwise(0))
    at = at.withColumn("pure", pure)
    document = F.struct(
        of(lambda c: (c["ix"] + 0.5) / n).alias("bin_center_x"),
        of(lambda c: (c["iy"] + 0.5) / n).alias("bin_center_y"),
        of(lambda c: c["count"]).alias("bin_counts"),
        of(lambda c: F.element_at(F.array(*[F.lit(v) for v in ids]), c["dominant"] + 1)).alias("dominant_class_id"),
        of(lambda c: F.element_at(F.array(*[F.lit(v) for v in names]), c["dominant"] + 1)).alias("dominant_class_name"),
        of(lambda c: hit(c) / c["count"]).alias("target_class_purity"),
        of(shares).alias("class_percentages"),
        F.lit(ids[target]).alias("target_class_id"),
        F.lit(names[target]).alias("target_class_name"),
        "axis1_features",
        "axis2_features",
        F.col("pure").cast("double").alias("best_purity_P"),
        F.lit(n).alias("n_bins"),
        "projection_weights_x",
        "projection_weights_y",
        "x_transforms",
        "y_transforms",
    )
    return at.select("pair", "pure", F.to_json(document).alias("document"))


def _file_system(spark: SparkSession, path: str):
    """(Hadoop's Path class, its file system for path)."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind, kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file of any Hadoop file system."""
    kind, fs = _file_system(spark, path)
    out = fs.create(kind(path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_documents(documents: DataFrame, folder: str) -> list[str]:
    """The documents of grid_documents(), a file ``pair_<i>_pure_count_<n>.json`` each, written by one job into folder; their names."""
    spark, held = documents.sparkSession, f"{folder.rstrip('/')}/_documents"
    named = documents.select(F.format_string("pair_%02d_pure_count_%d", F.col("pair"), F.col("pure")).alias("name"), "document")
    named.repartition("name").write.mode("overwrite").partitionBy("name").text(held)
    kind, fs = _file_system(spark, held)
    names = []
    for part in fs.globStatus(kind(f"{held}/name=*/part-*")):
        name = part.getPath().getParent().getName().removeprefix("name=")
        to = kind(f"{folder.rstrip('/')}/{name}.json")
        fs.delete(to, False)
        fs.rename(part.getPath(), to)
        names.append(name)
    fs.delete(kind(held), True)
    return sorted(names)


def write_pair_points(points: DataFrame, folder: str) -> None:
    """The rows of every pair (column pair) as JSON lines in a folder ``pair_<i>`` of its own, by one job."""
    spark = points.sparkSession
    points.withColumn("pair", F.format_string("%02d", "pair")).write.mode("overwrite").partitionBy("pair").json(folder)
    kind, fs = _file_system(spark, folder)
    for part in fs.globStatus(kind(f"{folder.rstrip('/')}/pair=*")):
        fs.rename(part.getPath(), kind(f"{folder.rstrip('/')}/pair_{part.getPath().getName().removeprefix('pair=')}"))


def plot_table(grid: DataFrame, n: int, target: int, biggest: float = 300.0) -> DataFrame:
    """What a bubble plot of a grid needs: centroids, centres, marker sizes, purity."""
    t = class_count(target)
    top = grid.agg(F.max("count").alias("top"), F.max(t).alias("top_target"))
    out = grid.crossJoin(F.broadcast(top))  # one row
    return out.select("ix", "iy", "cx", "cy", cell_centre(F.col("ix"), n).alias("x"), cell_centre(F.col("iy"), n).alias("y"), marker_size(F.col("count"), F.col("top"), biggest).alias("size"), marker_size(t, F.col("top_target"), biggest).alias("target_size"), (t / F.col("count")).alias("purity"), (t == F.col("count")).alias("pure"))


def run_directory(root: str, config: PairConfig, group: int, stem: str, at: datetime) -> str:
    approach = "incremental" if config.incremental else "final"
    return os.path.join(root, f"2d_pairs_{config.mode}_{approach}_group{group}_{stem}_{at:%Y%m%d_%H%M%S}")


def pair_name(i: int, pure: int) -> str:
    return f"pair_{i:02d}_pure_count_{pure}"


def write_config(spark: SparkSession, path: str, config: PairConfig, **more) -> None:
    write_text(spark, path, json.dumps(asdict(config) | more, indent=2))


def pair_report(i: int, x: Axis, y: Axis, pure: int, occupied: int, n: int, invalid: tuple[int, int], pure_cells: int = 0, mode: str = "2d", required: int = 0) -> str:
    """What a run says of one pair: purity, occupancy, rows without a value, formulas."""
    mean = f"{pure / pure_cells:.2f}" if pure_cells else "N/A"
    return "\n".join(
        [
            f"Pair {i}: pure count {pure} in {pure_cells} pure cells, {mean} rows each",
            f"  {occupied} of {n * n} cells occupied ({100 * occupied / (n * n):.1f} %), {required} required ({mode})",
            f"  x = {formula(x)}  (rows without a value: {invalid[0]})",
            f"  y = {formula(y)}  (rows without a value: {invalid[1]})",
        ]
    )


def run_summary(pairs: DataFrame) -> DataFrame:
    """One row over (attempts, occupied, invalid_x, invalid_y): attempts that were the first, and the spread."""
    invalid = F.col("invalid_x") + F.col("invalid_y")
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.sum((F.col("attempts") == 1).cast("long")).alias("first_attempt"),
        F.sum((F.col("attempts") > 1).cast("long")).alias("more_attempts"),
        F.avg("occupied").alias("mean_occupied"),
        F.min("occupied").alias("min_occupied"),
        F.max("occupied").alias("max_occupied"),
        F.avg(invalid).alias("mean_invalid"),
        F.max(invalid).alias("max_invalid"),
        F.sum(invalid).alias("sum_invalid"),
    )
