"""Command line: axis pairs of a CSV file.  python -m axisloom input.csv --features a,b,c --label group --target 1"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import PairConfig
from .plans.pairs import generate_pairs
from .sources.tables import read_csv, read_dictionary, unmapped


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="axisloom", description=__doc__)
    p.add_argument("csv", help="file or folder that Spark reads, with a header")
    p.add_argument("--features", required=True, help="columns, separated by commas")
    p.add_argument("--label", default="attack_group", help="column of the class ids")
    p.add_argument("--name", default="attack", help="column of class names, used with --mapping where the label is missing")
    p.add_argument("--mapping", help="JSON object from class names to ids")
    p.add_argument("--target", type=int, required=True, help="id of the class to separate")
    p.add_argument("--out", required=True)
    p.add_argument("--pairs", type=int, default=50)
    p.add_argument("--shuffle-seed", type=int, default=0)
    p.add_argument("--sign-seed", type=int, default=1)
    p.add_argument("--transform-seed", type=int, default=2)
    p.add_argument("--final", action="store_true", help="draw whole pairs rather than grow them term by term")
    p.add_argument("--mode", choices=("1d", "2d"), default="2d")
    p.add_argument("--min-occupancy", type=float, default=0.05)
    p.add_argument("--max-attempts", type=int, default=10)
    p.add_argument("--epsilon", type=float, default=1e-10)
    p.add_argument("--no-grids", action="store_true")
    p.add_argument("--points", action="store_true")
    p.add_argument("--exclude-normal", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    """Runs the search; returns the number of pairs found."""
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("axisloom").getOrCreate()
    features = a.features.split(",")
    rows = read_csv(spark, a.csv, features, a.label, a.name)
    if a.label not in rows.columns:
        if a.name not in rows.columns or not a.mapping:
            raise ValueError(f"neither {a.label} nor {a.name} with a mapping")
        ids = read_dictionary(spark, a.mapping)
        missing = [r[0] for r in unmapped(rows, a.name, ids).orderBy("name").limit(20).collect()]
        if missing:
            raise ValueError(f"names without an id: {', '.join(missing)}")
        rows = rows.join(ids.withColumnRenamed("name", a.name).withColumnRenamed("value", a.label), a.name, "left")
    config = PairConfig(
        target=a.target, pairs=a.pairs, shuffle_seed=a.shuffle_seed, sign_seed=a.sign_seed, transform_seed=a.transform_seed, incremental=not a.final, mode=a.mode,
        min_occupancy=a.min_occupancy, max_attempts=a.max_attempts, epsilon=a.epsilon, export_grids=not a.no_grids, export_points=a.points, exclude_normal=a.exclude_normal,
    )
    return len(generate_pairs(rows, features, a.label, a.target, config, a.out))


if __name__ == "__main__":
    main()
