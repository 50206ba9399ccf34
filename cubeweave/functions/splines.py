"""Smooth interpolation of one series with NumPy."""

from __future__ import annotations

import numpy as np


def hermite(x: np.ndarray, y: np.ndarray, slope: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubics through values and slopes."""
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    t = (at - x[k]) / h
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h * slope[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h * slope[k + 1]


def spline_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the cubic spline whose third derivative is continuous at the second and last but one knot."""
    n = len(x)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        b[i] = 3 * (h[i] * d[i - 1] + h[i - 1] * d[i])
    if n == 3:
        a[0, :2], b[0] = (1, 1), 2 * d[0]
        a[2, 1:], b[2] = (1, 1), 2 * d[1]
    else:
        a[0, :2], b[0] = (h[1], h[0] + h[1]), ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
        a[-1, -2:], b[-1] = (h[-1] + h[-2], h[-2]), (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    return np.linalg.solve(a, b)


def pchip_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes that keep each interval monotone: weighted harmonic means of its neighbours."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    out = np.zeros(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = (np.sign(d[1:]) == np.sign(d[:-1])) & (d[1:] != 0) & (d[:-1] != 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0)
    for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        out[end] = 0 if np.sign(s) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s
    return out


def akima_slopes(x: np.ndarray, y: np.ndarray, modified: bool = False) -> np.ndarray:
    """Slopes that lean to the side where neighbouring slopes change least."""
    d = np.diff(y) / np.diff(x)
    m = np.concatenate(([3 * d[0] - 2 * d[1], 2 * d[0] - d[1]], d, [2 * d[-1] - d[-2], 3 * d[-1] - 2 * d[-2]]))
    w = np.abs(np.diff(m))
    if modified:
        w = w + 0.5 * np.abs(m[1:] + m[:-1])
    a, b = w[2:], w[:-2]
    total = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 1e-9 * total.max(initial=0), (a * m[1:-2] + b * m[2:-1]) / total, (m[1:-2] + m[2:-1]) / 2)


def polynomial(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The one polynomial through all points, in barycentric form."""
    scale = 4 / (x.max() - x.min())
    w = np.array([1 / np.prod((x[i] - np.delete(x, i)) * scale) for i in range(len(x))])
    gap = at[:, None] - x
    hit = gap == 0
    terms = w / np.where(hit, 1, gap)
    out = (terms @ y) / terms.sum(1)
    rows, cols = np.nonzero(hit)
    out[rows] = y[cols]
    return out


def evaluate(x: np.ndarray, y: np.ndarray, at: np.ndarray, method: str) -> np.ndarray:
    """Values at ``at``; missing outside the range of ``x``, and everywhere for fewer than two points."""
    if len(x) < 2:
        return np.full(len(at), np.nan)
    if len(x) == 2 or method in ("linear", "slinear"):
        out = np.interp(at, x, y)
    elif method in ("cubic", "spline"):
        out = hermite(x, y, spline_slopes(x, y), at)
    elif method == "pchip":
        out = hermite(x, y, pchip_slopes(x, y), at)
    elif method in ("akima", "makima"):
        out = hermite(x, y, akima_slopes(x, y, method == "makima"), at)
    elif method in ("polynomial", "barycentric", "krogh", "quadratic"):
        if method == "quadratic":
            k = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 3)
            out = np.array([polynomial(x[i : i + 3], y[i : i + 3], np.array([p]))[0] for i, p in zip(k, at)])
        else:
            out = polynomial(x, y, at)
    else:
        raise ValueError(f"no interpolation method {method}")
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)
