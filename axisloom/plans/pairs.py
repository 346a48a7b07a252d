"""A run from a table to ranked, exported axis pairs."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PairConfig
from ..functions.geometry import resolution
from ..operators.axis import many_values, placed_pairs
from ..operators.grid import countable, pure_cells, square_grid
from ..operators.search import Measured, PairGenerator
from ..operators.stats import class_statistics, collected_means, separating, separation, top_features
from ..sources.sinks import grid_documents, pair_report, points, run_summary, write_config, write_documents, write_pair_points, write_text
from ..sources.tables import feature_table, label_dictionary, with_class


@dataclass
class PairResult:
    measured: Measured
    pure: int
    grid: DataFrame


def generate_pairs(df: DataFrame, features: list[str], label: str, target, config: PairConfig = PairConfig(), out: str | None = None) -> list[PairResult]:
    """Axis pairs that separate the target label; with out, a folder of any Hadoop file system, also grid JSON, points, a report,
    a summary of the run and the configuration.  The grids of all pairs are one aggregation, and so are all documents and all
    points one write each.

    Raises ValueError for missing columns and for a target label that doesn't occur.
    """
    dictionary = label_dictionary(df, label)
    labels = [r["label"] for r in dictionary.orderBy("cls").collect()]
    if target not in labels:
        raise ValueError(f"target label {target!r} does not occur")
    cls = labels.index(target)
    rows = with_class(feature_table(df, features, (label,)), label, dictionary).persist(StorageLevel.MEMORY_AND_DISK)
    spark, held, began = df.sparkSession, [], time.monotonic()
    try:
        n = resolution(rows.count())
        means = collected_means(class_statistics(rows, features), features, len(labels))
        sep = separation(means, cls)
        candidates = [j for j in top_features(sep, len(features)) if j in set(separating(sep))]
        generator = PairGenerator(rows, features, candidates, n, config)
        found = generator.generate()
        if not found:
            return []
        pairs = [(m.x, m.y) for m in found]
        at = [(m.x_bounds, m.y_bounds) for m in found]
        points_of = placed_pairs(rows.withColumn("label", F.col(label).cast("string")), pairs, at, ("cls", "label"), config.epsilon)
        grids = square_grid(countable(points_of), n, len(labels), keys=("pair",)).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(grids)
        cells = {r["pair"]: r for r in pure_cells(grids, cls, ("pair",)).collect()}
        results = [PairResult(m, cells[i]["pure_rows"] if i in cells else 0, grids.filter(F.col("pair") == i).drop("pair")) for i, m in enumerate(found)]
        if out:
            write_config(spark, f"{out}/config.json", config, n_bins=n, target=str(target))
            empty = {r["row"]: r for r in many_values(rows, pairs, epsilon=config.epsilon).groupBy("row").agg(F.sum(F.col("v0").isNull().cast("long")).alias("x"), F.sum(F.col("v1").isNull().cast("long")).alias("y")).collect()}
            required = int((n if config.mode == "1d" else n * n) * config.min_occupancy)
            report = [pair_report(i, m.x, m.y, results[i].pure, m.occupied, n, (empty[i]["x"], empty[i]["y"]), cells[i]["pure_cells"] if i in cells else 0, config.mode, required) for i, m in enumerate(found)]
            tries = generator.chosen or [1] * len(found)
            summary = run_summary(spark.createDataFrame([(tries[i], m.occupied, empty[i]["x"], empty[i]["y"]) for i, m in enumerate(found)], "attempts int, occupied long, invalid_x long, invalid_y long")).first().asDict()
            summary |= {"attempts": generator.attempts, "rounds": generator.rounds, "trials": generator.trials, "seconds": round(time.monotonic() - began, 3)} | {f"memo_{k}": v for k, v in generator.memo.statistics().items()}
            write_text(spark, f"{out}/report.txt", "\n".join(report) + "\n" + "\n".join(f"{k}: {v}" for k, v in summary.items()) + "\n")
            write_text(spark, f"{out}/summary.json", json.dumps(summary, indent=2))
            if config.export_grids:
                write_documents(grid_documents(grids, n, cls, [str(v) for v in labels], list(range(len(labels))), pairs, features), out)
            if config.export_points:
                write_pair_points(points(points_of, exclude_normal=config.exclude_normal, keep=("pair",)), f"{out}/points")
        return results
    finally:
        rows.unpersist()
        for h in held if out else ():
            h.unpersist()
