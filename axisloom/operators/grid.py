"""Grids over two normalised axes: cell counts by class, occupancy, and hexagons.

Grids are sparse: one aggregation on (pair, cell), partial on the map side; empty cells have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import grid_cell, hex_distance, hex_round, hex_size, occupancy_cell, to_axial, to_cartesian


def countable(df: DataFrame, x: str = "x", y: str = "y", cls: str = "cls", pred: str | None = None) -> DataFrame:
    """Rows that grids count: both coordinates known, labelled, not yet predicted."""
    keep = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.col(cls) >= 0)
    return df.filter(keep & (F.coalesce(F.col(pred), F.lit(-1)) < 0) if pred else keep)


def square_grid(df: DataFrame, n: int, n_classes: int, x: str = "x", y: str = "y", cls: str = "cls", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ix, iy, count, cx, cy, class_counts): one row per occupied cell."""
    cells = df.withColumns({"ix": grid_cell(F.col(x), n), "iy": grid_cell(F.col(y), n)})
    sums = [F.sum((F.col(cls) == c).cast("long")).alias(f"c{c}") for c in range(n_classes)]
    out = cells.groupBy(*keys, "ix", "iy").agg(F.count("*").alias("count"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), *sums)
    return out.select(*keys, "ix", "iy", "count", "cx", "cy", F.array(*[F.col(f"c{c}") for c in range(n_classes)]).alias("class_counts"))


def long_grid(df: DataFrame, n: int, x: str = "x", y: str = "y", cls: str = "cls", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ix, iy, class, count): one row per occupied cell and class."""
    return df.groupBy(*keys, grid_cell(F.col(x), n).alias("ix"), grid_cell(F.col(y), n).alias("iy"), F.col(cls).alias("cls")).agg(F.count("*").alias("count"))


def class_count(target: int) -> Column:
    return F.element_at("class_counts", target + 1)


def pure_count(grid: DataFrame, target: int, keys: tuple[str, ...] = (), threshold: float = 1.0) -> DataFrame:
    """(keys, pure_count): target rows in cells whose share of target rows is at least the threshold."""
    t = class_count(target)
    return grid.groupBy(*keys).agg(F.coalesce(F.sum(F.when(t >= threshold * F.col("count"), t).otherwise(0)), F.lit(0)).alias("pure_count"))


def pure_cells(grid: DataFrame, target: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pure_cells, pure_rows, rows_per_pure_cell): cells of target rows alone; the mean is NULL without any."""
    pure = (class_count(target) == F.col("count")) & (F.col("count") > 0)
    out = grid.groupBy(*keys).agg(F.coalesce(F.sum(pure.cast("long")), F.lit(0)).alias("pure_cells"), F.coalesce(F.sum(F.when(pure, F.col("count"))), F.lit(0)).alias("pure_rows"))
    return out.withColumn("rows_per_pure_cell", F.when(F.col("pure_cells") > 0, F.col("pure_rows") / F.col("pure_cells")))


def dominant(grid: DataFrame) -> DataFrame:
    """grid with dominant, the first of the classes with most rows in the cell."""
    return grid.withColumn("dominant", F.array_position("class_counts", F.array_max("class_counts")).cast("int") - 1)


def class_percentages(grid: DataFrame, n_classes: int) -> DataFrame:
    """grid with percentages, a map from class to its share in percent, for classes that occur in the cell."""
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), (F.lit(100.0) * class_count(c) / F.col("count")).alias("value")) for c in range(n_classes)]), lambda e: e["value"] > 0)
    return grid.withColumn("percentages", F.map_from_entries(entries))


def occupancy_1d(df: DataFrame, n: int, x: str = "x", ratio: float = 0.05) -> DataFrame:
    """(occupied, valid): distinct cells along an axis, and whether they are at least int(n * ratio)."""
    occupied = F.count_distinct(occupancy_cell(F.col(x), n))
    return df.agg(occupied.alias("occupied")).select("occupied", (F.col("occupied") >= int(n * ratio)).alias("valid"))


def occupancy_2d(df: DataFrame, n: int, x: str = "x", y: str = "y", ratio: float = 0.05) -> DataFrame:
    """(occupied, valid): distinct cells of the plane, against int(n * n * ratio)."""
    occupied = F.count_distinct(occupancy_cell(F.col(x), n) * n + occupancy_cell(F.col(y), n))
    return df.agg(occupied.alias("occupied")).select("occupied", (F.col("occupied") >= int(n * n * ratio)).alias("valid"))


def occupancy_states(df: DataFrame, n: int, x: str = "x", y: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, side, bucket, cells): the occupied cells along x, along y and of the plane (side ``x``, ``y``, ``xy``) as bitmaps of
    32,768 cells each.

    States can be stored for every part of the data and merged by merged_occupancy() in any order and as often as
    wanted.  Rows are folded to distinct cells by a hash aggregation before a bitmap is made; missing values occupy
    no cell.
    """
    cells = df.select(*keys, occupancy_cell(F.col(x), n).alias("ix"), occupancy_cell(F.col(y), n).alias("iy")).distinct()
    sides = [F.struct(F.lit(name).alias("side"), at.cast("long").alias("at")) for name, at in (("x", F.col("ix")), ("y", F.col("iy")), ("xy", F.col("ix") * n + F.col("iy")))]
    each = cells.select(*keys, F.inline(F.array(*sides))).filter("at is not null")
    return each.groupBy(*keys, "side", F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("cells"))


def merged_occupancy(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The union of occupancy states, one state for each of keys, side and bucket."""
    return states.groupBy(*keys, "side", "bucket").agg(F.bitmap_or_agg("cells").alias("cells"))


def occupied_cells(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, occupied_x, occupied_y, occupied) of occupancy states, merged."""
    of = lambda side, name: F.coalesce(F.sum(F.when(F.col("side") == side, F.bitmap_count("cells"))), F.lit(0)).alias(name)
    return merged_occupancy(states, keys).groupBy(*keys).agg(of("x", "occupied_x"), of("y", "occupied_y"), of("xy", "occupied"))


def hex_grid(df: DataFrame, rings: int, n_classes: int, x: str = "x", y: str = "y", cls: str = "cls") -> DataFrame:
    """(q, r, count, cx, cy, class_counts): hexagons of the lattice; points beyond its rings are dropped."""
    size = hex_size(rings)
    fx, fy = F.lit(2.0) * F.col(x) - F.lit(1.0), F.lit(2.0) * F.col(y) - F.lit(1.0)
    q, r = hex_round(*to_axial(fx, fy, size))
    # a generator's output, so that the filter doesn't write the rounding out again for each reference
    at = df.select("*", F.inline(F.array(F.struct(q.alias("q"), r.alias("r"))))).filter(hex_distance(F.col("q"), F.col("r"), F.lit(0), F.lit(0)) <= rings)
    sums = [F.sum((F.col(cls) == c).cast("long")).alias(f"c{c}") for c in range(n_classes)]
    out = at.groupBy("q", "r").agg(F.count("*").alias("count"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), *sums)
    return out.select("q", "r", "count", "cx", "cy", F.array(*[F.col(f"c{c}") for c in range(n_classes)]).alias("class_counts"))


def hex_lattice(spark: SparkSession, rings: int) -> DataFrame:
    """(q, r, x, y): the 3 n (n + 1) + 1 hexagons of n rings and their centres."""
    side = spark.range(-rings, rings + 1)
    both = side.select(F.col("id").cast("int").alias("q")).crossJoin(F.broadcast(side.select(F.col("id").cast("int").alias("r"))))
    both = both.filter(hex_distance(F.col("q"), F.col("r"), F.lit(0), F.lit(0)) <= rings)
    x, y = to_cartesian(F.col("q"), F.col("r"), hex_size(rings))
    return both.withColumns({"x": x, "y": y})


def hex_neighbours(cells: DataFrame) -> DataFrame:
    """(q, r, nq, nr): the six neighbours of each hexagon."""
    steps = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
    near = F.array(*[F.struct((F.col("q") + dq).alias("nq"), (F.col("r") + dr).alias("nr")) for dq, dr in steps])
    return cells.select("q", "r", F.explode(near).alias("n")).select("q", "r", "n.nq", "n.nr")


def hex_stats(grid: DataFrame, rings: int, target: int) -> DataFrame:
    """One row: hexagons in all, occupied, pure, points in them, target points in pure ones, and the two rates."""
    t = class_count(target)
    total = 3 * rings * (rings + 1) + 1
    out = grid.agg(
        F.lit(total).alias("total_hexagons"),
        F.count("*").alias("occupied_hexagons"),
        F.coalesce(F.sum((t == F.col("count")).cast("long")), F.lit(0)).alias("pure_hexagons"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("points"),
        F.coalesce(F.sum(F.when(t == F.col("count"), t).otherwise(0)), F.lit(0)).alias("pure_count"),
    )
    return out.withColumns({"occupancy_rate": F.col("occupied_hexagons") / F.lit(float(total)), "purity_rate": F.when(F.col("occupied_hexagons") > 0, F.col("pure_hexagons") / F.col("occupied_hexagons")).otherwise(F.lit(0.0))})
