"""Upper tail of the normal distribution."""

from __future__ import annotations

import math


def upper_tail(z: float) -> float:
    """P(Z > z); exactly 0 from 15 on (1 below -15), 1 for NaN."""
    if math.isnan(z):
        return 1.0
    tail = 0.0 if abs(z) >= 15 else 0.5 * math.erfc(abs(z) / math.sqrt(2))
    return tail if z > 0 else 1.0 - tail
