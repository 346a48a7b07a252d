"""Greedy rectangle cover of the pure cells of a grid.

Works on the driver over a collected grid (at most n * n cells).  From every uncovered pure cell a
rectangle grows by whole borders, one step up, right, down and left in turn, as long as the odds of the
target don't drop; the rectangle of most target rows is kept and its cells are marked; this repeats.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .rules import Rect

MAX_RECTS = 10


@dataclass
class Grid:
    """Dense counts: target rows and all rows by cell."""

    target: np.ndarray
    count: np.ndarray
    covered: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.covered = np.zeros(self.count.shape, dtype=bool)

    @classmethod
    def collected(cls, grid: DataFrame, target: int, n: int) -> Grid:
        t, c = np.zeros((n, n), dtype=np.int64), np.zeros((n, n), dtype=np.int64)
        for r in grid.select("ix", "iy", "count", "class_counts").collect():
            t[r["ix"], r["iy"]], c[r["ix"], r["iy"]] = r["class_counts"][target], r["count"]
        return cls(t, c)


@dataclass(frozen=True)
class Growth:
    """Inclusive cell ranges of a rectangle and the target rows in it."""

    i1: int
    i2: int
    j1: int
    j2: int
    rows: int

    def rect(self, n: int) -> Rect:
        return Rect(self.i1 / n, self.j1 / n, (self.i2 + 1 - self.i1) / n, (self.j2 + 1 - self.j1) / n)


def _accepts(strip_t: np.ndarray, strip_c: np.ndarray, t: int, o: int, ratio: float | None) -> bool:
    """Whether a border can join: at no cell of it, in order, is a limit passed.

    Plain: the running target count must stay above the cell's count and at most 10 other rows come in.
    With a ratio: every cell must hold target rows, and the other rows may be max(10, ratio of all).
    """
    run_t, run_o = t + np.cumsum(strip_t), o + np.cumsum(strip_c - strip_t)
    if ratio is None:
        return bool(np.all(run_t > strip_c) and np.all(run_o <= 10))
    return bool(np.all(strip_t > 0) and np.all(run_o <= np.maximum(10, ((run_t + run_o) * ratio).astype(np.int64))))


def grow(g: Grid, i: int, j: int, ratio: float | None = None) -> Growth:
    """The rectangle grown from a cell; one that stays a single cell counts 0 rows."""
    n = g.count.shape[0]
    i1 = i2 = i
    j1 = j2 = j
    t = int(g.target[i, j])
    o = int(g.count[i, j]) - t
    odds = (t + 1) / (o + 1)
    grew = True
    while grew:
        grew = False
        for side in ("up", "right", "down", "left"):
            if side in ("up", "down"):
                at = j2 + 1 if side == "up" else j1 - 1
                cells = (slice(i1, i2 + 1), at)
            else:
                at = i2 + 1 if side == "right" else i1 - 1
                cells = (at, slice(j1, j2 + 1))
            if not 0 <= at < n:
                continue
            st, sc = g.target[cells], g.count[cells]
            if not _accepts(st, sc, t, o, ratio):
                continue
            nt, no = t + int(st.sum()), o + int(sc.sum() - st.sum())
            if (nt + 1) / (no + 1) < odds:
                continue
            odds, t, o, grew = (nt + 1) / (no + 1), nt, no, True
            if side == "up":
                j2 = at
            elif side == "down":
                j1 = at
            elif side == "right":
                i2 = at
            else:
                i1 = at
    single = i1 == i2 and j1 == j2
    return Growth(i1, i2, j1, j2, 0 if single else t)


def cover(g: Grid, min_rows: int = 1, purity: float = 1.0, ratio: float | None = None) -> tuple[list[Rect], int]:
    """(rectangles, target rows covered): at most ten rectangles, until the best has fewer than min_rows."""
    n = g.count.shape[0]
    rects, total = [], 0
    for _ in range(MAX_RECTS):
        best = None
        for i, j in np.argwhere((g.count > 0) & ~g.covered & (g.target >= purity * g.count)):
            found = grow(g, int(i), int(j), ratio)
            if best is None or found.rows > best.rows:
                best = found
        if best is None or best.rows < max(1, min_rows):
            break
        fresh = ~g.covered[best.i1 : best.i2 + 1, best.j1 : best.j2 + 1]
        total += int(g.target[best.i1 : best.i2 + 1, best.j1 : best.j2 + 1][fresh].sum())
        g.covered[best.i1 : best.i2 + 1, best.j1 : best.j2 + 1] = True
        rects.append(best.rect(n))
    return rects, total
