"""Rectangles as rules: first match, nearest rule, votes.

A rule's rectangles live in the plane of its own two axes.  A few rules are inlined as expressions; those of a
whole model are data that goes to the tasks (``scored_rows``), where a batch of rows meets them at once.  Either way
scoring is one narrow pass without joins.  Rectangles of one plane that are held as a table are found by a join
(``first_match``, ``nearest_rule``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import in_rect, rect_distance
from .axis import Axis, Bounds, term_arrays, with_placed

MATCH_WEIGHT, NEAR_WEIGHT = 10.0, 3.0


@dataclass(frozen=True)
class Rect:
    left: float
    bottom: float
    width: float
    height: float

    @property
    def right(self) -> float:
        return self.left + self.width

    @property
    def top(self) -> float:
        return self.bottom + self.height

    @property
    def centre(self) -> tuple[float, float]:
        return self.left + self.width / 2, self.bottom + self.height / 2

    def parts(self) -> tuple[float, float, float, float]:
        return self.left, self.bottom, self.width, self.height


@dataclass(frozen=True)
class Rule:
    cls: int
    x: Axis
    y: Axis
    x_bounds: Bounds
    y_bounds: Bounds
    rects: tuple[Rect, ...]


def _any(x: Column, y: Column, rects: tuple[Rect, ...]) -> Column:
    out = F.lit(False)
    for r in rects:
        out = out | in_rect(x, y, *r.parts())
    return out


def _placed(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[str]]:
    """df with a column pair per rule (__x<i>, __y<i>), each computed once."""
    axes = {}
    for i, r in enumerate(rules):
        axes[f"__x{i}"], axes[f"__y{i}"] = (r.x, r.x_bounds), (r.y, r.y_bounds)
    return with_placed(df, axes) if axes else df, list(axes)


def scored(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with pred and weight: the class of the first rule that holds a row (weight 10), else of the
    nearest one (weight 3; ties to the earlier rule); -1 and 0 without rules."""
    if not rules:
        return df.withColumns({"pred": F.lit(-1), "weight": F.lit(0.0)})
    out, extra = _placed(df, rules)
    first, distances = F.lit(None).cast("int"), []
    for i in reversed(range(len(rules))):
        first = F.when(_any(F.col(f"__x{i}"), F.col(f"__y{i}"), rules[i].rects), F.lit(i)).otherwise(first)
    for i, r in enumerate(rules):
        away = [rect_distance(F.col(f"__x{i}"), F.col(f"__y{i}"), *q.parts()) for q in r.rects]
        distances.append(F.struct((F.least(*away) if len(away) > 1 else away[0] if away else F.lit(float("inf"))).alias("d"), F.lit(i).alias("i")))
    nearest = F.array_min(F.array(*distances))["i"]
    out = out.withColumn("__first", first).withColumn("__rule", F.coalesce("__first", nearest))
    cls = F.element_at(F.array(*[F.lit(r.cls) for r in rules]), F.col("__rule") + 1)
    out = out.withColumns({"pred": cls, "weight": F.when(F.col("__first").isNotNull(), F.lit(MATCH_WEIGHT)).otherwise(F.lit(NEAR_WEIGHT))})
    return out.drop(*extra, "__first", "__rule")


def matched(df: DataFrame, rules: list[Rule], pred: str = "pred") -> DataFrame:
    """df whose open rows (pred < 0) get the class of the first rule that holds them."""
    out, extra = _placed(df, rules)
    hit = F.lit(-1)
    for i in reversed(range(len(rules))):
        hit = F.when(_any(F.col(f"__x{i}"), F.col(f"__y{i}"), rules[i].rects), F.lit(rules[i].cls)).otherwise(hit)
    return out.withColumn(pred, F.when(F.col(pred) < 0, hit).otherwise(F.col(pred))).drop(*extra)


def training_error(df: DataFrame, cls: str = "cls", pred: str = "pred") -> DataFrame:
    """(error, scored): share of rows whose prediction isn't their class, and share predicted at all."""
    return df.agg(F.avg((F.col(cls) != F.col(pred)).cast("double")).alias("error"), F.avg((F.col(pred) >= 0).cast("double")).alias("scored"))


def first_match(points: DataFrame, rects: DataFrame, x: str = "x", y: str = "y", key: str = "id", side: int = 32) -> DataFrame:
    """(key, rule): for rule sets held as a table (rule, left, bottom, width, height), the smallest rule that
    holds the point, or NULL.

    The unit square is cut into side * side cells (what lies outside belongs to the border's cells); points meet the
    rectangles that touch their cell, by an equi-join.  Rows that repeat a key share the smallest of their rules.
    """
    clip = lambda v: F.least(F.greatest(F.floor(v * side), F.lit(0)), F.lit(side - 1)).cast("int")
    range_of = lambda low, size: F.explode(F.sequence(clip(F.col(low)), clip(F.col(low) + F.col(size))))
    wide = rects.filter("width >= 0 and height >= 0").withColumn("__i", range_of("left", "width")).withColumn("__j", range_of("bottom", "height"))
    at = points.select(F.col(key), F.col(x).alias("__x"), F.col(y).alias("__y")).withColumns({"__i": clip(F.col("__x")), "__j": clip(F.col("__y"))})
    inside = in_rect(F.col("__x"), F.col("__y"), F.col("left"), F.col("bottom"), F.col("width"), F.col("height"))
    hit = at.join(wide, ["__i", "__j"]).filter(inside).groupBy(key).agg(F.min("rule").alias("rule"))
    return points.select(key).join(hit, key, "left")


def _box(df: DataFrame, low: list[Column], high: list[Column]) -> list[float | None]:
    """Least and greatest finite value along x and along y."""
    finite = lambda c: F.when(F.abs(c) < F.lit(float("inf")), c)
    return list(df.agg(F.min(finite(low[0])), F.max(finite(high[0])), F.min(finite(low[1])), F.max(finite(high[1]))).first())


def nearest_rule(points: DataFrame, rects: DataFrame, x: str = "x", y: str = "y", side: int = 32) -> DataFrame:
    """points with rule, inside and distance, for rectangles held as a table (rule, left, bottom, width, height): the smallest rule
    that holds the point, else the rule of the nearest rectangle (distance by the larger coordinate; ties to the
    smaller rule).

    The box around all points and rectangles is cut into side * side cells.  For every cell that has points, a bound says how far its
    points can be from their nearest rectangle (``_reaches``), and the rectangles within it go to the cell (``_dealt_rects``): no
    others can win there.  A task that has a cell's points and rectangles cuts it into the more parts the more rectangles it has, finds
    for each part those that can win in it (``_part_lists``), and takes the least distance over the list of a point's part.  Points
    of a cell that has very many go to several tasks.  The driver sees bounds and counts of cells only.

    Points with a null, NaN or infinite coordinate, and all points without rectangles, have null results; rectangles with
    a null, a NaN or a negative size are left out, and those that lie at infinity.
    """
    rects = rects.filter("rule IS NOT NULL AND left IS NOT NULL AND bottom IS NOT NULL AND width >= 0 AND height >= 0").select("rule", F.col("left").alias("l"), (F.col("left") + F.col("width")).alias("r"), F.col("bottom").alias("b"), (F.col("bottom") + F.col("height")).alias("t"))
    # NaN is above infinity
    rects = rects.filter("l < double('infinity') AND b < double('infinity') AND r > -double('infinity') AND t > -double('infinity') AND NOT isnan(r) AND NOT isnan(t)")
    outer = [_box(points, [F.col(x), F.col(y)], [F.col(x), F.col(y)]), _box(rects, [F.col("l"), F.col("b")], [F.col("r"), F.col("t")])]
    nothing = points.select("*", F.lit(None).cast(rects.schema["rule"].dataType).alias("rule"), F.lit(None).cast("boolean").alias("inside"), F.lit(None).cast("double").alias("distance"))
    if any(v is None for o in outer for v in o):
        return nothing
    low = [min(o[k] for o in outer) for k in (0, 2)]
    step = [(max(o[k + 1] for o in outer) - low[k // 2]) / side or 1.0 for k in (0, 2)]
    place = lambda v, k: F.least(F.greatest(F.floor((v - F.lit(low[k])) / F.lit(step[k])), F.lit(0)), F.lit(side - 1)).cast("int")
    known = (F.abs(F.col(x)) < F.lit(float("inf"))) & (F.abs(F.col(y)) < F.lit(float("inf")))
    at = points.select(F.struct(*[F.col(c) for c in points.columns]).alias("__row"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.when(known, place(F.col(x), 0) * side + place(F.col(y), 1)).otherwise(F.lit(-1)).alias("cell"))
    # by cell, from -1 on, for the points that have no place
    chunks = [0] * (side * side + 1)
    for r in at.groupBy("cell").count().collect():
        chunks[r["cell"] + 1] = -(-r["count"] // CELL_POINTS)
    rects = rects.select("rule", *[F.col(c).cast("double").alias(c) for c in "lrbt"]).repartition(points.sparkSession.sparkContext.defaultParallelism)
    reach = _reaches(rects, side, low, step, [c > 0 for c in chunks[1:]])
    near = _dealt_rects(rects, side, low, step, reach)
    if max(chunks) > 1:
        several = lambda c: F.get(F.lit(chunks), c + 1)
        at = at.withColumn("chunk", F.pmod(F.monotonically_increasing_id(), several(F.col("cell"))).cast("int"))
        near = near.withColumn("chunk", F.explode(F.sequence(F.lit(0), several(F.col("cell")) - 1)))
    keys = ["cell", "chunk"] if max(chunks) > 1 else ["cell"]
    kind = rects.schema["rule"].dataType.simpleString()
    row = points.select(F.struct("*").alias("s")).schema["s"].dataType.simpleString()
    solved = lambda left, right: _nearest_in_cell(left, right, side, low, step)
    found = at.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(solved, f"__row {row}, rule {kind}, inside boolean, distance double")
    return found.select(*[F.col("__row")[c].alias(c) for c in points.columns], "rule", "inside", "distance")


#: The most points of a cell that go to one task together.
CELL_POINTS = 1 << 19
#: Along each side, the parts of a cell that are known to be touched by a rectangle or not.
FINE = 8


def _gaps(batch, side: int, low: list[float], step: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the distance along x, and along y, between a point in each column (or row) of cells and each rectangle: the least of x
    and of y, the greatest of x and of y; a margin of one part in 10^9 of a cell for rounding."""
    out = []
    for k, (near, far) in enumerate((("l", "r"), ("b", "t"))):
        edge = low[k] + np.arange(side + 1) * step[k]
        margin = 1e-9 * step[k] + 1e-15 * (abs(low[k]) + side * step[k])
        before, after = (batch[c].to_numpy(zero_copy_only=False)[:, None] for c in (near, far))
        w, e = edge[:-1] - margin, edge[1:] + margin
        out.append((np.maximum(np.maximum(before - e, w - after), 0.0), np.maximum(np.maximum(before - w, e - after), 0.0)))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def _reaches(rects: DataFrame, side: int, low: list[float], step: list[float], asked: list[bool]) -> np.ndarray:
    """For each cell by row and column, a bound of the distance between a point in it and the nearest rectangle; -1 where nothing is asked.

    It is the least of two bounds: the greatest distance that one rectangle can have, and the greatest that a part of the cell has from
    the nearest part that any rectangle touches."""
    fine = side * FINE

    def summed(batches):
        """(touched, bound): a partition's touched parts as bits, and the first bound of each cell."""
        edges, bound = np.zeros((fine + 1, fine + 1), dtype=np.int64), np.full((side, side), np.inf)
        for batch in batches:
            for rows in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                *_, x_most, y_most = _gaps(rows, side, low, step)
                bound = np.minimum(bound, np.maximum(x_most[:, :, None], y_most[:, None, :]).min(axis=0))
            (i, i1), (j, j1) = ([np.clip(np.floor((batch[c].to_numpy(zero_copy_only=False) - low[k]) / (step[k] / FINE)), 0, fine - 1).astype(np.int64) for c in pair] for k, pair in enumerate(("lr", "bt")))
            for r, c, sign in ((i, j, 1), (i1 + 1, j, -1), (i, j1 + 1, -1), (i1 + 1, j1 + 1, 1)):
                np.add.at(edges, (r, c), sign)
        touched = edges.cumsum(axis=0).cumsum(axis=1)[:fine, :fine] > 0
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(touched).tobytes()], pa.binary()), pa.array([bound.tobytes()], pa.binary())], ["touched", "bound"])

    reached, bound = np.zeros((fine, fine), dtype=bool), np.full((side, side), np.inf)
    for r in rects.mapInArrow(summed, "touched binary, bound binary").collect():
        reached |= np.unpackbits(np.frombuffer(r["touched"], dtype=np.uint8), count=fine * fine).reshape(fine, fine).astype(bool)
        bound = np.minimum(bound, np.frombuffer(r["bound"]).reshape(side, side))
    # a part k parts away from a touched one is at most k + 1 of them away from a rectangle
    away, k, margin = np.full((fine, fine), np.inf), 0, max(4e-15 * (abs(low[i]) + side * step[i]) for i in (0, 1))
    while reached.any() and np.isinf(away).any():
        away[reached & np.isinf(away)] = (k + 1) * max(step) / FINE * (1 + 1e-9) + margin
        grown = np.pad(reached, 1)
        reached, k = np.logical_or.reduce([grown[i : i + fine, j : j + fine] for i in range(3) for j in range(3)]), k + 1
    away = away.reshape(side, FINE, side, FINE).max(axis=(1, 3))
    return np.where(np.reshape(asked, (side, side)), np.minimum(bound, away), -1.0)


def _dealt_rects(rects: DataFrame, side: int, low: list[float], step: list[float], reach: np.ndarray) -> DataFrame:
    """(cell, rule, l, r, b, t): each rectangle for every cell within whose reach it is."""

    def deal(batches):
        for batch in batches:
            for rows in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                x, y, *_ = _gaps(rows, side, low, step)
                row, i, j = np.nonzero(np.maximum(x[:, :, None], y[:, None, :]) <= reach)
                yield pa.RecordBatch.from_arrays([pa.array(i * side + j, pa.int32()), *[c.take(pa.array(row)) for c in rows.columns]], ["cell", *rows.schema.names])

    return rects.mapInArrow(deal, "cell int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rects.schema.fields))


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type whose parts may all be null, as a schema by name has it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    return pa.list_(_nullable(kind.value_type)) if pa.types.is_list(kind) else kind


def _nearest_in_cell(points: pa.Table, rects: pa.Table, side: int, low: list[float], step: list[float], block: int = 1 << 20) -> pa.Table:
    """Rows of a cell with rule, inside and distance, by the rectangles that can win there."""
    n = points.num_rows
    row = points["__row"].cast(_nullable(points["__row"].type))
    if not n or not rects.num_rows:
        kind = rects.schema.field("rule").type
        return pa.table({"__row": row, "rule": pa.nulls(n, kind), "inside": pa.nulls(n, pa.bool_()), "distance": pa.nulls(n, pa.float64())})
    cell = rects["cell"][0].as_py()
    rects = rects.group_by(["l", "r", "b", "t"]).aggregate([("rule", "min")]).rename_columns({"rule_min": "rule"})
    # points that repeat are looked at once
    x, y = (points[c].to_numpy() for c in ("__x", "__y"))
    order = np.lexsort((y, x))
    first = np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)])
    of = np.empty(n, dtype=np.int64)
    of[order] = np.cumsum(first) - 1
    x, y = x[order[first]], y[order[first]]
    parts = 1 << max(0, min(6, int(np.log2(max(1.0, rects.num_rows**0.5 / 2))), int(np.ceil(np.log2(len(x)) / 2))))
    lists = _part_lists(pa.table({"cell": np.full(rects.num_rows, cell, dtype=np.int32), "parts": np.full(rects.num_rows, parts, dtype=np.int32), **{c: rects[c] for c in ("rule", "l", "r", "b", "t")}}), side, low, step)
    flat = {c: lists[c].combine_chunks() for c in ("rules", "l", "r", "b", "t")}
    starts = flat["l"].offsets.to_numpy()
    place = np.empty(parts * parts, dtype=np.int64)
    place[lists["part"].to_numpy()] = np.arange(parts * parts)
    within = lambda v, k, i: np.clip(np.floor(((v - low[k]) / step[k] - i) * parts), 0, parts - 1).astype(np.int64)
    part = place[within(x, 0, cell // side) * parts + within(y, 1, cell % side)]
    begin, sizes = starts[part], starts[part + 1] - starts[part]
    l, r, b, t = (flat[c].values.to_numpy() for c in "lrbt")  # noqa: E741
    best, least = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(x):  # so many points that their lists together are of bounded size
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + block, "right")))
        own = sizes[lo:hi]
        offsets = np.cumsum(own) - own
        each = np.repeat(np.arange(lo, hi), own)
        rect = np.arange(len(each)) - np.repeat(offsets - begin[lo:hi], own)
        px, py, rl, rr, rb, rt = x[each], y[each], l[rect], r[rect], b[rect], t[rect]
        holds = (px >= rl) & (px < rr) & (py >= rb) & (py < rt)
        away = np.where(holds, -1.0, np.maximum.reduce([rl - px, px - rr, rb - py, py - rt]).clip(0.0))
        least[lo:hi] = np.minimum.reduceat(away, offsets)
        best[lo:hi] = np.minimum.reduceat(np.where(away == np.repeat(least[lo:hi], own), rect, np.iinfo(np.int64).max), offsets)
        lo = hi
    return pa.table({"__row": row, "rule": flat["rules"].values.take(pa.array(best[of])), "inside": pa.array(least[of] < 0), "distance": pa.array(least[of].clip(0.0))})


def _part_lists(table: pa.Table, side: int, low: list[float], step: list[float]) -> pa.Table:
    """(cell, part, rules, l, r, b, t): for each part of a cell, the rectangles that can win for a point in it, by rule.

    Left out is what is farther than the farthest that another can be, and what another of a smaller rule is as near as
    at every point: one that covers the part, or one with the same two sides that reaches over the part in the other
    direction.  Parts are made by halves, so that a rectangle is looked at in those parts only where it may count.
    """
    cell, parts = table["cell"][0].as_py(), table["parts"][0].as_py()
    table = table.take(pa.compute.sort_indices(table, [("rule", "ascending")])).combine_chunks()
    l, r, b, t = (table[c].to_numpy() for c in "lrbt")  # noqa: E741
    # the place in the order of rules; equal rules are as good as each other
    order = np.arange(len(l))
    margin = [1e-9 * step[k] + 1e-15 * (abs(low[k]) + side * step[k]) for k in (0, 1)]
    lists: dict[int, np.ndarray] = {}

    def first_of(low_side, high_side, spans, rank):
        """Whether no rectangle of an earlier place that spans the part has the same two sides."""
        both = np.empty(len(rank), dtype=complex)  # a pair of sides as one value
        both.real, both.imag = low_side, high_side
        _, group = np.unique(both, return_inverse=True)
        best = np.full(len(rank), len(order))
        np.minimum.at(best, group[spans], rank[spans])
        return rank <= best[group]

    def cut(i, j, size, own):
        """The part of so many parts' size at i, j, for the rectangles in own."""
        w, e = (low[0] + step[0] * (cell // side + k / parts) + m for k, m in ((i, -margin[0]), (i + size, margin[0])))
        s, n = (low[1] + step[1] * (cell % side + k / parts) + m for k, m in ((j, -margin[1]), (j + size, margin[1])))
        ol, orr, ob, ot = l[own], r[own], b[own], t[own]
        most = np.maximum.reduce([ol - w, e - orr, ob - s, n - ot]).clip(0.0).min()
        keep = np.maximum.reduce([ol - e, w - orr, ob - n, s - ot]) <= most
        x_spans, y_spans = (ol <= w) & (orr > e), (ob <= s) & (ot > n)
        over = np.flatnonzero(x_spans & y_spans)
        if len(over):
            # what doesn't hold a point there is farther than the first that holds them all
            keep &= (ol <= e) & (orr > w) & (ob <= n) & (ot > s)
            keep[over[0] + 1 :] = False
        own = own[keep]
        if len(own) > 4:
            sides = [np.where(v[keep] <= lo, -np.inf, v[keep]) for v, lo in ((ol, w), (ob, s))]
            tops = [np.where(v[keep] > hi, np.inf, v[keep]) for v, hi in ((orr, e), (ot, n))]
            good = first_of(sides[0], tops[0], y_spans[keep], own)
            own, sides, tops, x_only = own[good], [v[good] for v in sides], [v[good] for v in tops], x_spans[keep][good]
            own = own[first_of(sides[1], tops[1], x_only, own)]
        if size == 1 or len(own) <= 4:
            lists.update({(i + p) * parts + j + q: own for p in range(size) for q in range(size)})
            return
        half = size // 2
        for p in (i, i + half):
            for q in (j, j + half):
                cut(p, q, half, own)

    cut(0, 0, parts, order)
    flat = np.concatenate(list(lists.values()))
    off = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in lists.values()])]), pa.int32())
    of = lambda c: pa.ListArray.from_arrays(off, table[c].combine_chunks().take(pa.array(flat)))
    return pa.table({"cell": pa.array([cell] * len(lists), pa.int32()), "part": pa.array(list(lists), pa.int32()), "rules": of("rule"), **{c: of(c) for c in "lrbt"}})


def _placed_batch(terms: np.ndarray, axis: tuple[np.ndarray, np.ndarray], b: Bounds) -> np.ndarray:
    """with_placed for a batch: columns of terms (NaN where missing), and an axis as their places and signs."""
    if not b.usable or not len(axis[0]):
        return np.zeros(len(terms))
    total, valid = np.zeros(len(terms)), np.zeros(len(terms))
    for k, sign in zip(*axis, strict=True):
        known = ~np.isnan(terms[:, k])
        total += np.where(known, terms[:, k] * sign, 0.0)
        valid += known
    with np.errstate(invalid="ignore", divide="ignore"):
        value = total * (len(axis[0]) / valid)
        return np.where(np.isnan(value), 0.0, (value - b.low) / (b.high - b.low))


def score_batch(terms: np.ndarray, rules: list[tuple], block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(class, weight) of each row of terms by rules (class, x, y, x bounds, y bounds, rectangles as rows)."""
    pred, weight = np.full(len(terms), -1, dtype=np.int32), np.zeros(len(terms))
    for at in range(0, len(terms), block):
        part = terms[at : at + block]
        first, best, nearest = np.full(len(part), -1), np.full(len(part), np.inf), np.zeros(len(part), dtype=np.int64)
        for i, (_, ax, ay, bx, by, r) in enumerate(rules):
            x, y = _placed_batch(part, ax, bx)[:, None], _placed_batch(part, ay, by)[:, None]
            left, right, bottom, top = r.T
            holds = ((x >= left) & (x < right) & (y >= bottom) & (y < top)).any(axis=1)
            first[(first < 0) & holds] = i
            away = np.maximum(np.maximum(np.maximum(left - x, x - right), np.maximum(bottom - y, y - top)), 0.0).min(axis=1, initial=np.inf)
            nearest[away < best] = i
            best = np.minimum(best, away)
        classes = np.array([c for c, *_ in rules], dtype=np.int32)
        pred[at : at + block] = classes[np.where(first >= 0, first, nearest)]
        weight[at : at + block] = np.where(first >= 0, MATCH_WEIGHT, NEAR_WEIGHT)
    return pred, weight


def scored_rows(df: DataFrame, voters: list[list[Rule]], keep: list[str], epsilon: float = 1e-10) -> DataFrame:
    """(keep, votes): for every rule list, the class and weight that scored() would give, as an array of structs (pred, weight).

    df has, for rule list number i, its features as the columns of a struct ``__f<i>``.  The terms of a list are one array
    column, evaluated by Spark; the rules are sent to the tasks, which take a batch of rows through each.
    """
    arrays, specs = [], []
    for i, rules in enumerate(voters):
        columns, place = term_arrays([a for r in rules for a in (r.x, r.y)], lambda f, i=i: F.col(f"__f{i}.{f}"), epsilon)
        arrays.append((F.array(*columns) if columns else F.array().cast("array<double>")).alias(f"__t{i}"))
        axis = lambda a, place=place: (np.array([place[t.feature, t.transform] for t in a.terms], dtype=np.int64), np.array([-1.0 if t.sign < 0 else 1.0 for t in a.terms]))
        specs.append([(r.cls, axis(r.x), axis(r.y), r.x_bounds, r.y_bounds, np.array([(q.left, q.right, q.bottom, q.top) for q in r.rects]).reshape(-1, 4)) for r in rules])
    shared = df.sparkSession.sparkContext.broadcast(specs)
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def score(batches):
        for batch in batches:
            votes = []
            for i, rules in enumerate(shared.value):
                column = batch.column(len(keep) + i)
                width = pa.compute.list_value_length(column)[0].as_py() if batch.num_rows else 0
                flat = column.flatten().to_numpy(zero_copy_only=False) if width else np.zeros(0)
                pred, weight = score_batch(flat.astype(np.float64).reshape(batch.num_rows, width), rules) if rules else (np.full(batch.num_rows, -1, dtype=np.int32), np.zeros(batch.num_rows))
                votes.append((pred, weight))
            n = len(votes)
            pred = np.stack([v[0] for v in votes], axis=1).ravel() if n else np.zeros(0, dtype=np.int32)
            weight = np.stack([v[1] for v in votes], axis=1).ravel() if n else np.zeros(0)
            inner = pa.StructArray.from_arrays([pa.array(pred, pa.int32()), pa.array(weight, pa.float64())], ["pred", "weight"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n, pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], [*keep, "votes"])

    return df.select(*keep, *arrays).mapInArrow(score, f"{schema}, votes array<struct<pred: int, weight: double>>")


def vote(votes: DataFrame, key: str = "id", cls: str = "pred", weight: str = "weight") -> DataFrame:
    """(key, winner): the class of most weight, the lowest of equals."""
    by = votes.groupBy(key, cls).agg(F.sum(weight).alias("w"))
    return by.groupBy(key).agg(F.max(F.struct("w", (-F.col(cls)).alias("c"))).alias("m")).select(key, (-F.col("m.c")).alias("winner"))
