"""Search for axes: sparse signed sums by separation of class means, and seeded generation of axis pairs
under occupancy constraints.

The sign search works on class means alone, on the driver.  Pair generation draws on the driver and
measures on the cluster.  Every attempt has random streams of its own, so attempts don't wait for each other: those of
all pairs grow in lockstep, and the trials that they have in a round share the same two passes over the rows, for bounds
and for occupancy.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Generator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PairConfig
from ..functions.transforms import EPS_TWIN, clean
from .axis import Axis, Bounds, Term, widened
from .stats import composite_separation

Weights = list[tuple[int, int]]


def _signs(means, target: int, w: Weights, rng: np.random.RandomState, legacy_last: bool) -> Weights:
    """Annealed flips: 5 temperatures from 0.01 by 0.9, max(1, len / 2) moves at each."""
    w = list(w)
    best = composite_separation(means, target, w)
    t = 0.01
    for _ in range(5):
        for _ in range(max(1, len(w) // 2)):
            k = rng.randint(0, max(1, len(w) - 1 if legacy_last else len(w)))
            moved = [(j, -s) if i == k else (j, s) for i, (j, s) in enumerate(w)]
            d = composite_separation(means, target, moved)
            if d > best or rng.random_sample() < math.exp(min(0.0, (d - best)) / t):
                w, best = moved, d
        t *= 0.9
    return w


def sparse_projection(means, target: int, candidates: list[int], rng: np.random.RandomState, share: float = 0.75, rounds: int = 10, optimise: bool = True, legacy_last: bool = False, trace: list | None = None) -> tuple[Weights, float]:
    """The best of some rounds: a random share of the candidates with signs by annealing (or random ones)."""
    best, score = [], -1.0
    for k in range(rounds):
        size = max(1, int(len(candidates) * share))
        chosen = [candidates[i] for i in rng.permutation(len(candidates))[:size]]
        w: Weights = [(j, 1 if rng.random_sample() > 0.5 else -1) for j in chosen]
        if optimise:
            w = _signs(means, target, w, rng, legacy_last)
        s = composite_separation(means, target, w)
        if trace is not None:
            trace.append((k, share, s))
        if s > score:
            best, score = w, s
    return best, score


def good_projection(means, target: int, candidates: list[int], rng: np.random.RandomState, limit: int = 50) -> tuple[Weights, float]:
    """The trainer's search: the best over one, two and three quarters of the candidates, all signs positive before annealing.
    Fewer than limit candidates are put into a random order before each quarter; limit or more are taken best first."""
    order, best, score = list(candidates), [], -1.0
    for quarters in (1, 2, 3):
        if len(order) < limit:
            order = [order[i] for i in rng.permutation(len(order))]
        w = _signs(means, target, [(j, 1) for j in order[: max(1, quarters * len(order) // 4)]], rng, False)
        s = composite_separation(means, target, w)
        if s > score:
            best, score = w, s
    return best, score


@dataclass(frozen=True)
class Measured:
    x: Axis
    y: Axis
    x_bounds: Bounds
    y_bounds: Bounds
    occupied_x: int
    occupied_y: int
    occupied: int
    nonfinite: bool


class Memo:
    """What a run has measured: bounds of axes and measures of pairs, and how often they were found here."""

    def __init__(self):
        self.bounds: dict[Axis, Bounds] = {}
        self.measured: dict[tuple[Axis, Axis], Measured] = {}
        #: For each mode and ratio, what was measured as far as accepts asks.
        self.judged: dict[tuple[str, float], dict[tuple[Axis, Axis], Measured]] = {}
        self.hits = self.misses = 0

    def clear(self) -> None:
        self.bounds.clear()
        self.measured.clear()
        self.judged.clear()
        self.hits = self.misses = 0

    def statistics(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0, "axes": len(self.bounds), "pairs": len(self.measured)}


def measure(df: DataFrame | Packed, pairs: list[tuple[Axis, Axis]], n: int, epsilon: float, memo: Memo | None = None, judge: tuple[str, float] | None = None) -> list[Measured]:
    """Bounds and occupancy of many pairs: one job for the bounds that aren't known yet, one for all occupied cells of
    the pairs that aren't; none for what memo holds.

    With judge, a mode and a ratio for accepts, a task looks for a pair's cells until they are enough, and for none where accepts
    doesn't ask for them.  What accepts says is the same; the counts of a pair that it accepts are then lower bounds."""
    memo = Memo() if memo is None else memo
    known = memo.measured if judge is None else memo.judged.setdefault(judge, {})
    found = lambda p: memo.measured.get(p) or known.get(p)
    new = list(dict.fromkeys(p for p in pairs if found(p) is None))
    memo.hits, memo.misses = memo.hits + len(pairs) - len(new), memo.misses + len(new)
    if new:
        known |= dict(zip(new, _measure(df, new, n, epsilon, memo.bounds, judge), strict=True))
    return [found(p) for p in pairs]


def _values(terms: list[np.ndarray], known: list[np.ndarray | None], own: list[tuple[int, float]]) -> np.ndarray:
    """An axis's values, as with_values has them, over columns of terms that are 0 where missing; known says where they aren't (None:
    nowhere).  NaN stands for a missing value."""
    k, sign = own[0]
    total = terms[k].copy() if sign > 0 else -terms[k]
    for k, sign in own[1:]:
        (np.add if sign > 0 else np.subtract)(total, terms[k], out=total)
    holes = [known[k] for k, _ in own if known[k] is not None]
    if holes:
        valid = sum(holes, np.full(len(total), float(len(own) - len(holes))))
        total *= len(own) / np.where(valid > 0, valid, np.nan)
    return total


def _term(x: np.ndarray, name: str, epsilon: float, shared: dict) -> np.ndarray:
    """functions.transforms.transform over a batch; NaN stands for missing on both sides.  shared keeps the sigmoid of x."""
    if name in ("log_eps", "inverse_eps"):
        return _term(x + epsilon, name.removesuffix("_eps"), epsilon, shared)
    if name == "square":
        return x * x
    if name == "sqrt":
        return np.where(x < 0, 0.0, np.sqrt(x))
    if name == "log":
        return np.log(x)
    if name == "inverse":
        return 1.0 / x
    if name not in ("sigmoid", "sigmoid_eps", "logit", "logit_eps"):
        return x
    if "p" not in shared:
        small = np.exp(-np.abs(x))
        shared["p"] = np.where(x >= 0, 1.0 / (1.0 + small), small / (1.0 + small))
    p = shared["p"]
    if name.endswith("_eps"):
        p = np.maximum(np.minimum(p, 1.0 - epsilon), epsilon)
    return p if name.startswith("sigmoid") else np.log(p / (1.0 - p))


@dataclass(frozen=True)
class Packed:
    """Features of a table for many passes over it: a row for each batch, with a feature's doubles as one binary (NaN where missing),
    which the tasks take as they are."""

    df: DataFrame
    features: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, features: list[str]) -> Packed:
        def pack(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).tobytes()], pa.binary()) for c in batch.columns], batch.schema.names)

        names = [f"f{i}" for i in range(len(features))]
        rows = df.select(*[clean(F.col(f)).alias(n) for f, n in zip(features, names, strict=True)]).mapInArrow(pack, ", ".join(f"{n} binary" for n in names))
        return cls(rows.persist(StorageLevel.MEMORY_AND_DISK), tuple(features))


def _folded(df: DataFrame | Packed, axes: list[Axis], epsilon: float, fold, schema: str) -> DataFrame:
    """The rows that fold gives for each partition: it takes an iterator of functions, one a batch, that give an axis's values by its
    place.  A batch's terms are evaluated once each in the task and the axes are added up there: no row is written out once for each
    axis, and no code is generated whose size grows with the terms (the JVM doesn't compile large methods)."""
    terms = list(dict.fromkeys((t.feature, t.transform) for a in axes for t in a.terms))
    features = list(dict.fromkeys(f for f, _ in terms))
    place = {t: k for k, t in enumerate(terms)}
    specs = [[(place[t.feature, t.transform], -1.0 if t.sign < 0 else 1.0) for t in a.terms] for a in axes]

    packed = isinstance(df, Packed)

    def run(batches):
        def blocks():
            for batch in batches:
                if packed:
                    yield from ([np.frombuffer(c[k].as_buffer(), dtype=np.float64) for c in batch.columns] for k in range(batch.num_rows))
                else:
                    yield [c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns]

        def values():
            for block in blocks():
                columns = dict(zip(features, block, strict=False))
                shared: dict[str, dict] = {f: {} for f in features}
                with np.errstate(all="ignore"):
                    own = [_term(columns[f], t, epsilon, shared[f]) for f, t in terms]
                    holes = [np.isnan(v) for v in own]
                    known = [~h if h.any() else None for h in holes]
                    own = [v if k is None else np.where(k, v, 0.0) for v, k in zip(own, known, strict=True)]
                    yield lambda i: _values(own, known, specs[i]) if specs[i] else np.full(len(block[0]), np.nan)  # noqa: B023

        with np.errstate(all="ignore"):
            yield from fold(values())

    if packed:
        return df.df.select(*([f"f{df.features.index(f)}" for f in features] or ["f0"])).mapInArrow(run, schema)
    return df.select(*([clean(F.col(f)).alias(f"f{i}") for i, f in enumerate(features)] or [F.lit(None).cast("double").alias("f0")])).mapInArrow(run, schema)


def _ranges(df: DataFrame | Packed, axes: list[Axis], epsilon: float) -> list[Bounds]:
    """Bounds of all axes by one pass: a row of each partition and axis."""

    def fold(values):
        low, high = np.full(len(axes), np.nan), np.full(len(axes), np.nan)
        for value in values:
            for i in range(len(axes)):
                v = value(i)
                lo, hi = v.min(initial=np.inf), v.max(initial=-np.inf)
                if lo > hi or np.isnan(lo):  # without rows, or with missing values
                    lo, hi = np.fmin.reduce(v, initial=np.nan), np.fmax.reduce(v, initial=np.nan)
                low[i], high[i] = np.fmin(low[i], lo), np.fmax(high[i], hi)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(axes), dtype=np.int32)), pa.array(low, from_pandas=True), pa.array(high, from_pandas=True)], ["axis", "lo", "hi"])

    found = {r["axis"]: widened(r["lo"], r["hi"]) for r in _folded(df, axes, epsilon, fold, "axis int, lo double, hi double").groupBy("axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    return [found.get(i, Bounds(0.0, 0.0)) for i in range(len(axes))]


def _occupied(df: DataFrame | Packed, pairs: list[tuple[Axis, Axis]], at: list[tuple[Bounds, Bounds]], n: int, epsilon: float, judge: tuple[str, float] | None = None) -> dict[int, tuple[int, int, int]]:
    """Occupied cells along x, along y and of the plane of every pair, by one pass: a row of each partition, pair,
    side and occupied cell.  With judge, a partition has no more rows of a pair than are sure to be enough."""
    axes = list(dict.fromkeys(a for p in pairs for a in p))
    place = {a: i for i, a in enumerate(axes)}
    own = [(place[x], place[y]) for x, y in pairs]
    uses = Counter(k for p in own for k in p)

    def cell(v: np.ndarray, b: Bounds) -> np.ndarray:
        if not b.usable:
            return np.zeros(len(v), dtype=np.int64)
        v -= b.low
        v /= b.high - b.low
        v *= n
        where = v.astype(np.int64)  # of NaN something below 0 or 0
        return np.clip(where, 0, n - 1, out=where)

    def enough(cells: np.ndarray) -> bool:
        mode, ratio = judge
        if mode == "1d":
            return min(len(np.unique(cells // n)), len(np.unique(cells % n))) >= int(n * ratio)
        return len(cells) >= int(n * n * ratio)

    def fold(values):
        dense = n * n <= 1 << 16
        seen = [np.zeros(n * n if dense else 0, dtype=bool if dense else np.int64) for _ in pairs]
        live = list(range(len(pairs)))
        for value in values:
            kept: dict[int, np.ndarray] = {}
            for i in live:
                x, y = (kept[k] if k in kept else cell(value(k), b) for k, b in zip(own[i], at[i], strict=True))
                kept |= {k: c for k, c in zip(own[i], (x, y), strict=True) if uses[k] > 1}
                found = x * n + y
                if dense:
                    seen[i] |= np.bincount(found, minlength=n * n) > 0
                else:
                    seen[i] = np.union1d(seen[i], found)
            if judge:
                live = [i for i in live if not enough(np.flatnonzero(seen[i]) if dense else seen[i])]
        seen = [np.flatnonzero(s) for s in seen] if dense else seen
        for i, cells in enumerate(seen):
            for side, own_cells in enumerate((np.unique(cells // n), np.unique(cells % n), cells)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own_cells), v, dtype=np.int32)) for v in (i, side)] + [pa.array(own_cells.astype(np.int64))], ["pair", "side", "cell"])

    counts: dict[int, list[int]] = {}
    for r in _folded(df, axes, epsilon, fold, "pair int, side int, cell long").distinct().groupBy("pair", "side").count().collect():
        counts.setdefault(r["pair"], [0, 0, 0])[r["side"]] = r["count"]
    return {pair: (x, y, xy) for pair, (x, y, xy) in counts.items()}


def _measure(df: DataFrame | Packed, pairs: list[tuple[Axis, Axis]], n: int, epsilon: float, known: dict[Axis, Bounds], judge: tuple[str, float] | None = None) -> list[Measured]:
    new = list(dict.fromkeys(a for p in pairs for a in p if a not in known))
    if new:
        known |= dict(zip(new, _ranges(df, new, epsilon), strict=True))
    at = [(known[x], known[y]) for x, y in pairs]
    infinite = lambda b, a: bool(a.terms) and not (b.low > float("-inf") and b.high < float("inf"))
    blank = [Measured(x, y, bx, by, 0, 0, 0, infinite(bx, x) or infinite(by, y)) for (x, y), (bx, by) in zip(pairs, at, strict=True)]
    asked = [i for i, m in enumerate(blank) if judge is None or not (m.nonfinite or not (m.x.terms and m.y.terms))]
    counts = _occupied(df, [pairs[i] for i in asked], [at[i] for i in asked], n, epsilon, judge) if asked else {}
    found = {i: counts.get(k, (0, 0, 0)) for k, i in enumerate(asked)}
    return [replace(m, occupied_x=found[i][0], occupied_y=found[i][1], occupied=found[i][2]) if i in found else m for i, m in enumerate(blank)]


def accepts(m: Measured, n: int, mode: str, ratio: float) -> bool:
    """Whether a pair is valid: finite, and occupied enough; an axis pair with an empty side passes."""
    if m.nonfinite:
        return False
    if not (m.x.terms and m.y.terms):
        return True
    if mode == "1d":
        return m.occupied_x >= int(n * ratio) and m.occupied_y >= int(n * ratio)
    return m.occupied >= int(n * n * ratio)


def _score(m: Measured, mode: str) -> int:
    return m.occupied if mode == "2d" else m.occupied_x + m.occupied_y


#: A trial of an attempt: yields a pair to measure, is sent its measure, and returns the grown pair or None.
Growth = Generator[tuple[Axis, Axis], Measured, "Measured | None"]


class PairGenerator:
    """Seeded generation of axis pairs over a cached feature table.

    memo may be shared between generators over the same rows, resolution and epsilon.
    """

    def __init__(self, df: DataFrame, features: list[str], candidates: list[int], n: int, config: PairConfig, memo: Memo | None = None):
        self.df, self.features, self.candidates, self.n, self.config = df, features, candidates, n, config
        self.sign = np.random.RandomState(config.sign_seed)
        self.pick = np.random.RandomState(config.transform_seed)
        self.order = np.random.RandomState(config.shuffle_seed)
        self.memo = Memo() if memo is None else memo
        #: The rows of an incremental run, while it goes on.
        self.packed: Packed | None = None
        #: Trials of the last incremental run: how many attempts, rounds and measured trials it had.
        self.attempts = self.rounds = self.trials = 0
        #: For each pair of the last incremental run that has one, the number of the attempt that was taken, from 1.
        self.chosen: list[int] = []

    def _measure(self, pairs: list[tuple[Axis, Axis]], judge: tuple[str, float] | None = None) -> list[Measured]:
        return measure(self.packed or self.df, pairs, self.n, self.config.epsilon, self.memo, judge)

    def _retry(self, t: Term, nonfinite: bool, first: bool, pick: np.random.RandomState) -> Term:
        if first and nonfinite and t.transform in EPS_TWIN:
            return Term(t.feature, t.sign, EPS_TWIN[t.transform])
        sign = t.sign if t.feature == self.features[0] else -t.sign
        return Term(t.feature, sign, self.config.transforms[pick.randint(len(self.config.transforms))])

    def growth(self, pair: int, attempt: int) -> Growth:
        """One attempt: both axes grow term by term, each term checked and retried twice.  Its draws come from streams
        of its own, by the seeds of the configuration and its place."""
        c = self.config
        pick, flip = (np.random.RandomState(np.random.SeedSequence([seed, pair, attempt]).generate_state(4)) for seed in (c.transform_seed, c.sign_seed))
        queues = [[self.candidates[i] for i in pick.permutation(len(self.candidates))] for _ in range(2)]
        axes, failures, wanted, last = [Axis(), Axis()], 0, 2 * max(3 * len(self.features) // 4, 1), None
        while sum(len(a.terms) for a in axes) < wanted and failures < c.max_failures and (queues[0] or queues[1]):
            side = 0 if queues[0] and (len(axes[0].terms) <= len(axes[1].terms) or not queues[1]) else 1
            if not queues[side]:
                side = 1 - side
            j = queues[side].pop(0)
            # sign first, then transform; feature 0 is never negative
            sign = 1 if flip.random_sample() > 0.5 or j == 0 else -1
            term, added = Term(self.features[j], sign, c.transforms[pick.randint(len(c.transforms))]), False
            for retry in range(3):
                trial = list(axes)
                trial[side] = Axis((*axes[side].terms, term))
                m = yield trial[0], trial[1]
                if accepts(m, self.n, c.mode, c.min_occupancy):
                    axes, last, added = trial, m, True
                    break
                term = self._retry(term, m.nonfinite, retry == 0, pick)
            failures = 0 if added else failures + 1
        return last if all(a.terms for a in axes) else None

    def grown(self, growths: list[Growth]) -> list[Measured | None]:
        """The results of many attempts in lockstep: in each round, what all live ones ask for is measured at once, as far as it decides
        whether a trial is valid; what the attempts end with is then measured in full."""
        found: list[Measured | None] = [None] * len(growths)
        asked: dict[int, tuple[Axis, Axis]] = {}
        self.attempts, self.rounds, self.trials = len(growths), 0, 0

        def go_on(k: int, m: Measured | None) -> None:
            try:
                asked[k] = growths[k].send(m)
            except StopIteration as end:
                found[k] = end.value

        for k in range(len(growths)):
            go_on(k, None)
        while asked:
            live, asked = asked, {}
            self.rounds, self.trials = self.rounds + 1, self.trials + len(live)
            for k, m in zip(live, self._measure(list(live.values()), (self.config.mode, self.config.min_occupancy)), strict=True):
                go_on(k, m)
        ended = [k for k, m in enumerate(found) if m is not None]
        for k, m in zip(ended, self._measure([(found[k].x, found[k].y) for k in ended]), strict=True):
            found[k] = m
        return found

    def incremental(self, pairs: int | None = None) -> list[Measured | None]:
        """For each pair, the most occupied of its attempts, the earliest of equals; None where no attempt has terms on
        both sides."""
        pairs, tries = self.config.pairs if pairs is None else pairs, self.config.max_attempts
        self.packed = Packed.of(self.df, self.features)
        try:
            found = self.grown([self.growth(p, a) for p in range(pairs) for a in range(tries)])
        finally:
            self.packed.df.unpersist()
            self.packed = None
        own = [[(m, a + 1) for a, m in enumerate(found[p * tries : (p + 1) * tries]) if m is not None] for p in range(pairs)]
        best = [max(ms, key=lambda m: _score(m[0], self.config.mode), default=None) for ms in own]
        self.chosen = [b[1] for b in best if b is not None]
        return [b[0] if b is not None else None for b in best]

    def final(self) -> Measured | None:
        """Draws all attempts, measures them in one job, and takes the first valid or else the most occupied."""
        c, drawn = self.config, []
        for _ in range(c.max_attempts):
            axes = []
            for _ in range(2):
                chosen = [self.candidates[i] for i in self.order.permutation(len(self.candidates))[: max(3 * len(self.candidates) // 4, 1)]]
                signs = dict.fromkeys(chosen, 1)
                for _ in range(max(1, len(chosen) // 2)):
                    j = chosen[self.sign.randint(len(chosen))]
                    signs[j] = signs[j] if j == 0 else -signs[j]
                axes.append(Axis(tuple(Term(self.features[j], signs[j], c.transforms[self.pick.randint(len(c.transforms))]) for j in chosen)))
            drawn.append((axes[0], axes[1]))
        found = self._measure(drawn)
        valid = [m for m in found if accepts(m, self.n, c.mode, c.min_occupancy)]
        return valid[0] if valid else max(found, key=lambda m: _score(m, c.mode), default=None)

    def generate(self) -> list[Measured]:
        found = self.incremental() if self.config.incremental else [self.final() for _ in range(self.config.pairs)]
        return [m for m in found if m is not None]
