"""Constants and options of an analysis."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that results depend on: the margin of bounds, the shrink of grid coordinates, the guard of
# the *_eps transforms.
FUZZ0 = 1e-5
FUZZ1 = 0.99999
EPSILON = 1e-10


@dataclass(frozen=True)
class PairConfig:
    """Options of a run that generates axis pairs."""

    target: int = 0
    pairs: int = 50
    shuffle_seed: int = 0
    sign_seed: int = 1
    transform_seed: int = 2
    transforms: tuple[str, ...] = ("none", "square", "sqrt", "log", "log_eps", "inverse", "inverse_eps", "sigmoid", "sigmoid_eps", "logit", "logit_eps")
    incremental: bool = True
    mode: str = "2d"
    min_occupancy: float = 0.05
    max_attempts: int = 10
    max_failures: int = 5
    epsilon: float = EPSILON
    export_grids: bool = True
    export_points: bool = False
    exclude_normal: bool = False
