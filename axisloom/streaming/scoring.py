"""Streaming: stateless scoring with trained rules, and a grid kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import grid_cell
from ..operators.axis import Axis, Bounds, with_placed
from ..operators.rules import Rule, scored


def score_stream(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    """The stream with pred and weight; a projection, so it runs in any output mode that appends."""
    return scored(stream, rules)


def grid_stream(stream: DataFrame, x: Axis, y: Axis, x_bounds: Bounds, y_bounds: Bounds, n: int) -> DataFrame:
    """Running (ix, iy, cls, count) for fixed axes; state is one row per occupied cell and class (complete or update mode)."""
    at = with_placed(stream.filter("cls >= 0"), {"x": (x, x_bounds), "y": (y, y_bounds)})
    return at.groupBy(grid_cell(F.col("x"), n).alias("ix"), grid_cell(F.col("y"), n).alias("iy"), "cls").agg(F.count("*").alias("count"))


def to_memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
