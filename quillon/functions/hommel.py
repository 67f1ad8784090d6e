"""Hommel's correction.

For ascending p-values let alpha(j) be Simes' p-value of the j largest: the least j * p(n - j + k) / k. The corrected p(i) is
the largest of min(j * p(i), alpha(j)) over all j. alpha does not increase with j while j * p(i) does, so the largest lies
where they cross. alpha(j) / j is the least slope from the point (n - j, 0) to the points (i, p(i)) right of it; all
points lie above that line, so it touches their lower hull. The hull of all points is the hull of the corners of the hulls
of their parts, and where the two curves cross follows from the corners alone: a table needs no more than them in one place.
"""

from __future__ import annotations

import numpy as np


def lower_hull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners of the lower convex hull of points in order of x."""
    hull: list[tuple[float, float]] = []
    for c in zip(np.asarray(x, float).tolist(), np.asarray(y, float).tolist(), strict=True):
        while len(hull) > 1:
            a, b = hull[-2], hull[-1]
            if (b[1] - a[1]) * (c[0] - b[0]) < (c[1] - b[1]) * (b[0] - a[0]):
                break
            hull.pop()
        hull.append(c)
    corners = np.array(hull).reshape(-1, 2)
    return corners[:, 0], corners[:, 1]


def corrected(p: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Corrected p-values of n tests whose points (last rank of a value, value) have the hull corners (x, y), in any order."""
    p = np.asarray(p, float)
    if n <= 1 or not len(p):
        return p.copy()
    slope = np.diff(y) / np.diff(x)
    meets = x[:-1] - np.divide(y[:-1], slope, out=np.full(len(slope), np.inf), where=slope > 0)  # where an edge meets the axis
    meets = np.maximum.accumulate(np.where(np.isfinite(meets), meets, -np.inf))
    # The slope of the tangent from (left, 0) grows with left; it is p where the corner between slopes below and above p has it.
    k = np.searchsorted(slope, p)
    with np.errstate(all="ignore"):
        left = np.where(p > 0, x[k] - y[k] / p, 0.0)
    near = np.clip(np.ceil(np.nan_to_num(left)), 0, n - 1)[:, None] + np.arange(-2, 3)
    near = np.clip(near, 0, n - 1)
    at = np.searchsorted(meets, near, side="right")
    steep = np.full(near.shape, np.inf)
    for step in (-1, 0, 1):
        c = np.clip(at + step, 0, len(x) - 1)
        steep = np.minimum(steep, np.divide(y[c], x[c] - near, out=np.full(near.shape, np.inf), where=x[c] > near))
    j = n - near
    return np.minimum(1.0, np.maximum(p, np.minimum(j * p[:, None], j * steep).max(1)))


def points(values: np.ndarray, last: np.ndarray, m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hull corners of distinct ascending values, whose last ranks are given, among m p-values of n tests; tests not given count as p = 1."""
    x, y = (last, values) if n <= m else (np.append(last, n), np.append(values, 1.0))
    return lower_hull(x, y)


def hommel(sorted_p: np.ndarray, n_tests: int | None = None) -> np.ndarray:
    """Corrected p-values of ascending ones."""
    p = np.asarray(sorted_p, float)
    n = len(p) if n_tests is None else max(len(p), n_tests)
    last = np.flatnonzero(np.append(p[1:] != p[:-1], True)) if len(p) else np.zeros(0, int)
    return corrected(p, *points(p[last], last + 1, len(p), n), n) if len(p) else p.copy()
