"""Where a series turns: breaks of a piecewise line, else peaks of the curvature, on a smoothed series."""

from __future__ import annotations

import numpy as np

from galvana.functions.kernels import break_points

#: Least and share of the points for the smoothing window, share of squares that a further break must take off, percentile of large curvatures.
WINDOW_LEAST, WINDOW_SHARE, ELBOW, LARGE = 11, 40, 0.08, 80


def centred_mean(y: np.ndarray, window: int) -> np.ndarray:
    """Mean of the odd ``window`` around each place, of what there is of it at the ends."""
    n = len(y)
    width = min(max(3, window) | 1, n if n % 2 else n - 1)
    if n < 3 or width < 3:
        return y.astype(float)
    total, k, half = np.concatenate([[0.0], np.cumsum(y)]), np.arange(n), width // 2
    lo, hi = np.maximum(0, k - half), np.minimum(n, k + half + 1)
    return (total[hi] - total[lo]) / (hi - lo)


def curvature_peaks(curvature: np.ndarray, most: int, apart: int) -> list[int]:
    """The largest local maxima of the curvature's size among its largest fifth, no nearer than ``apart``."""
    size = np.abs(curvature)
    known = size[np.isfinite(size)]
    if len(size) < 5 or not len(known):
        return []
    bar = np.percentile(known, LARGE)
    bar = bar if bar > 0 else np.percentile(known, 75)
    k = np.arange(2, len(size) - 2)
    at = k[np.isfinite(size[k]) & (size[k] >= bar) & (size[k] >= size[k - 1]) & (size[k] >= size[k + 1])]
    chosen: list[int] = []
    for i in sorted(at.tolist(), key=lambda i: (-size[i], -i)):
        if len(chosen) < most and all(abs(i - j) >= apart for j in chosen):
            chosen.append(i)
    return sorted(chosen)


def turns(x: np.ndarray, y: np.ndarray, breaks: int = 2, least: int = 40, method: str = "hybrid", window: int | None = None) -> dict | None:
    """Places where the series turns, the smoothed series, its slope per 100 and its curvature; None for a short series.

    The first break always counts, a further one if it takes 8 % off the squares.
    ``hybrid`` asks the curvature where the line has no break at all.
    """
    n = len(x)
    if n < max(2 * least, 40):
        return None
    even = centred_mean(y, window or max(WINDOW_LEAST, n // WINDOW_SHARE))
    fade = np.gradient(even, x) * 100
    curvature = np.gradient(fade, x)
    places: list[int] = []
    if method in ("piecewise", "hybrid"):
        last = np.inf
        for b in range(1, breaks + 1):
            found, squares = break_points(x, even, b, least)
            if len(found) < b or b > 1 and not last - squares >= ELBOW * last > 0:
                break
            places, last = np.searchsorted(x, found).tolist(), squares
    if method == "curvature" or method == "hybrid" and not places:
        places = curvature_peaks(curvature, breaks, max(least, n // 20))
    return {"places": places, "even": even, "fade": fade, "curvature": curvature}


def slope(x: np.ndarray, y: np.ndarray) -> float:
    """Per 100 of x; NaN for fewer than two points."""
    return float(np.polyfit(x, y, 1)[0] * 100) if len(x) >= 2 else np.nan
