"""The ensemble classifier: trainers that cover the grids of generated axis pairs with rectangles.

Training loops on the driver over small results (class means, bounds, grids); rows are only aggregated.
The rows that no rule holds yet are kept as a cached table, made from the one before by the last rule alone, so
generated code has the size of one rule however many there are.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import grid_cell, resolution
from ..operators.axis import Axis, Bounds, Term, legacy_bounds, placed_pairs
from ..operators.cover import Grid, cover
from ..operators.rules import Rect, Rule, matched, scored, scored_rows
from ..operators.search import good_projection
from ..operators.stats import class_statistics, limits, separation, sqrt_features, standardised, top_features


@dataclass(frozen=True)
class TrainerConfig:
    top_features: int = 50
    pairs: int = 25
    covered_pairs: int = 6
    #: Rules must hold more rows than this; a tenth of the rows, from 1 to 10, unless given.
    min_rows: int | None = None
    #: Training ends after this many rules of a voter, if given.
    max_rules: int | None = None
    relaxed_purity: float = 0.75


@dataclass
class Voter:
    features: list[str]
    roots: list[str]
    limits: dict[str, tuple[float, float]]
    rules: list[Rule] = field(default_factory=list)

    def prepared(self, df: DataFrame) -> DataFrame:
        return standardised(df, self.features, self.limits, self.roots)

    def transform(self, df: DataFrame) -> DataFrame:
        return scored(self.prepared(df), self.rules)


def _grids(df: DataFrame, pairs: list[tuple[Axis, Axis]], at: list[Bounds], n: int, n_classes: int) -> tuple[list[tuple[Bounds, Bounds]], DataFrame]:
    """One aggregation for the grids of all pairs: rows are exploded to a cell per pair, which partial
    aggregation folds before anything moves."""
    pairs_at = [(at[2 * i], at[2 * i + 1]) for i in range(len(pairs))]
    long = placed_pairs(df, pairs, pairs_at).select("cls", "pair", grid_cell(F.col("x"), n).alias("ix"), grid_cell(F.col("y"), n).alias("iy"))
    sums = [F.sum((F.col("cls") == c).cast("long")).alias(f"c{c}") for c in range(n_classes)]
    grid = long.groupBy("pair", "ix", "iy").agg(F.count("*").alias("count"), *sums).select("pair", "ix", "iy", "count", F.array(*[F.col(f"c{c}") for c in range(n_classes)]).alias("class_counts"))
    return pairs_at, grid


def train_voter(df: DataFrame, features: list[str], n_classes: int, rng: np.random.RandomState, config: TrainerConfig = TrainerConfig()) -> Voter:
    """Rules for the classes in turn, each found among the rows that no rule holds yet.

    A class's turn gives a rule when the best cover holds more than the least number of rows.  When no turn of two rounds
    of the classes has, that number falls by one, until it is 0 or every class has a rule.  Once a rule has taken
    less than a hundredth of the open rows, rectangles need no longer be pure.  Axes are placed by the bounds of all
    training rows, open or not.
    """
    clean = df.select(*features, "cls").filter("cls >= 0")
    roots = sqrt_features(clean, features)
    rooted = clean.withColumns({f: F.signum(f) * F.sqrt(F.abs(F.col(f).cast("double"))) for f in roots}) if roots else clean
    voter = Voter(features, roots, limits(rooted, features))
    rows = voter.prepared(clean).persist(StorageLevel.MEMORY_AND_DISK)
    open_rows, purity, covered, cls = rows, 1.0, set(), 0
    try:
        counts, means = _open_state(rows, features, n_classes)
        left = sum(counts)
        min_rows = min(max(left // 10, 1), 10) if config.min_rows is None else config.min_rows
        turns = 1  # since the last rule
        while left and n_classes and (config.max_rules is None or len(voter.rules) < config.max_rules):
            if turns >= 2 * n_classes:
                min_rows, turns = min_rows - 1, 0
                if min_rows <= 0 or len(covered) == n_classes:
                    break
            found = None
            if counts[cls]:
                best = top_features(separation(means, cls), config.top_features)
                axis = lambda: Axis(tuple(Term(features[j], s) for j, s in good_projection(means, cls, best, rng, config.top_features)[0]))  # noqa: B023, E731
                pairs = [(axis(), axis()) for _ in range(config.pairs)]
                at = legacy_bounds(rows, [a for p in pairs for a in p])
                found = _best_cover(open_rows, pairs, at, resolution(left), n_classes, cls, min_rows, purity, config)
            if found and found[1] > min_rows:
                voter.rules.append(found[0])
                covered.add(cls)
                turns = 0
                rest = matched(open_rows.withColumn("pred", F.lit(-1)), [found[0]]).filter("pred < 0").select(*features, "cls").persist(StorageLevel.MEMORY_AND_DISK)
                counts, means = _open_state(rest, features, n_classes)
                if left - sum(counts) < 0.01 * left:
                    purity = config.relaxed_purity
                left = sum(counts)
                if open_rows is not rows:
                    open_rows.unpersist()
                open_rows = rest
            turns += 1
            cls = (cls + 1) % n_classes
    finally:
        open_rows.unpersist()
        rows.unpersist()
    return voter


def _open_state(df: DataFrame, features: list[str], n_classes: int) -> tuple[list[int], list[list[float]]]:
    """Rows and means of every class, by one job; zeros for a class without rows."""
    counts, means = [0] * n_classes, [[0.0] * len(features) for _ in range(n_classes)]
    for r in class_statistics(df, features).collect():
        counts[r["cls"]], means[r["cls"]] = r["count"], [float(r[f"mean_{f}"]) for f in features]
    return counts, means


def _best_cover(df: DataFrame, pairs: list[tuple[Axis, Axis]], bounds: list[Bounds], n: int, n_classes: int, cls: int, min_rows: int, purity: float, config: TrainerConfig) -> tuple[Rule, int] | None:
    at, grid = _grids(df, pairs, bounds, n, n_classes)
    by: dict[int, list] = {}
    for r in grid.collect():
        by.setdefault(r["pair"], []).append(r)
    pure = {p: sum(r["class_counts"][cls] for r in cells if r["class_counts"][cls] == r["count"]) for p, cells in by.items()}
    best = None
    for p in sorted(by, key=lambda p: (-pure[p], p))[: config.covered_pairs]:
        t, c = np.zeros((n, n), dtype=np.int64), np.zeros((n, n), dtype=np.int64)
        for r in by[p]:
            t[r["ix"], r["iy"]], c[r["ix"], r["iy"]] = r["class_counts"][cls], r["count"]
        rects, rows = cover(Grid(t, c), min_rows, purity)
        if rects and (best is None or rows > best[1]):
            best = Rule(cls, pairs[p][0], pairs[p][1], at[p][0], at[p][1], tuple(rects)), rows
    return best


class RectangleClassifier:
    """Estimator: ``fit`` trains the voters, ``transform`` adds prediction columns.

    Predictions are given as the dense class (``cls_pred``) and as the original label (``label_pred``).
    """

    def __init__(self, voters: int = 7, seed: int = 1, config: TrainerConfig = TrainerConfig()):
        self.n_voters, self.seed, self.config = voters, seed, config
        self.labels: list = []
        self.voters: list[Voter] = []

    def fit(self, df: DataFrame, features: list[str], label: str) -> RectangleClassifier:
        self.labels = [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
        place = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in self.labels]), F.col(label)).cast("int") - 1, F.lit(-1)) if self.labels else F.lit(-1)
        rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], place.alias("cls"))
        rng = np.random.RandomState(self.seed)
        self.voters = [train_voter(rows, features, len(self.labels), rng, self.config) for _ in range(self.n_voters)]
        return self

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """(key, cls_pred, label_pred), row by row; class 0 when a voter has no rules.

        All voters score a row in one narrow pass; the class of most weight wins, the lowest of equals.  Rules are
        data that goes to the tasks, so the plan is the same for ten of them and for thousands.
        """
        if not self.voters or any(not v.rules for v in self.voters):
            out = df.select(key, F.lit(0).alias("cls_pred"))
        else:
            features = list(dict.fromkeys(f for v in self.voters for f in v.features))
            rows = df.select(F.col(key).alias("__key"), F.struct(*[F.col(f) for f in features]).alias("__f"))
            for i, v in enumerate(self.voters):
                kept = [c for c in rows.columns if c != "__f"]
                own = v.prepared(rows.select(*kept, "__f", *[F.col(f"__f.{f}").alias(f) for f in v.features]))
                rows = own.select(*kept, "__f", F.struct(*[F.col(f) for f in v.features]).alias(f"__f{i}"))
            votes = scored_rows(rows, [v.rules for v in self.voters], ["__key"])
            of = lambda c: F.aggregate("votes", F.lit(0.0), lambda s, v: s + F.when(v["pred"] == c, v["weight"]).otherwise(0.0))
            weights = [of(c) for c in range(len(self.labels))]
            sums = votes.select(F.col("__key").alias(key), F.array(*weights).alias("__w"))
            out = sums.select(key, (F.array_position("__w", F.array_max("__w")) - 1).cast("int").alias("cls_pred"))
        return out.withColumn("label_pred", F.element_at(F.array(*[F.lit(v) for v in self.labels]), F.col("cls_pred") + 1) if self.labels else F.lit(None))

    def to_json(self) -> str:
        return json.dumps({"labels": self.labels, "voters": [asdict(v) for v in self.voters]})

    @classmethod
    def from_json(cls, text: str) -> RectangleClassifier:
        raw = json.loads(text)
        out = cls(len(raw["voters"]))
        out.labels = raw["labels"]
        axis = lambda a: Axis(tuple(Term(**t) for t in a["terms"]))
        for v in raw["voters"]:
            rules = [Rule(r["cls"], axis(r["x"]), axis(r["y"]), Bounds(**r["x_bounds"]), Bounds(**r["y_bounds"]), tuple(Rect(**q) for q in r["rects"])) for r in v["rules"]]
            out.voters.append(Voter(v["features"], v["roots"], {k: tuple(x) for k, x in v["limits"].items()}, rules))
        return out
