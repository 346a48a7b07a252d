"""Text for axes, labels and paths."""

from __future__ import annotations

import re


def term_text(sign: int, feature: str, transform: str, plain_none: bool = True) -> str:
    inner = feature if plain_none and transform == "none" else f"{transform}({feature})"
    return ("-" if sign < 0 else "+") + inner


def axis_terms(axis, plain_none: bool = True) -> list[str]:
    """One signed text for each term, e.g. +log(size), -count."""
    return [term_text(t.sign, t.feature, t.transform, plain_none) for t in axis.terms]


def axis_title(axis) -> str:
    return ", ".join(axis_terms(axis))


def formula(axis) -> str:
    """Signed terms without separators, the transform always named."""
    return "".join(axis_terms(axis, plain_none=False))


def label_lines(label: str) -> list[str]:
    """'head (a,b)' as head and its parts, one a line."""
    m = re.fullmatch(r"\s*(.*?)\s*\((.*)\)\s*", label)
    return [label.strip()] if not m else [m[1], *(p.strip() for p in m[2].split(","))]


def path_safe(label: str) -> str:
    """A label for names of folders: spaces and slashes become underscores, brackets and commas go."""
    return re.sub(r"[(),]", "", re.sub(r"[ /]", "_", label))
