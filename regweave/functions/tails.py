"""Tail probabilities used after small solves (vectorised over numpy arrays)."""

from __future__ import annotations

import math

import numpy as np


def _each(fn, x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([fn(v) for v in x.ravel()], dtype=float).reshape(x.shape)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def normal_two_sided(z) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def beta_reg(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb = np.where(flip, b, a), np.where(flip, a, b)
    xx = np.where(flip, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb)
                       + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
    tiny = 1e-300
    c = np.ones_like(xx)
    d = 1.0 - (aa + bb) * xx / (aa + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 400):
        num = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
        d = 1.0 + num * d
        c = 1.0 + num / c
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = np.where(np.abs(c) < tiny, tiny, c)
        f = f * d * c
        num = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
        d = 1.0 + num * d
        c = 1.0 + num / c
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        f = f * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    r = np.where((xx <= 0), 0.0, front * f)
    return np.where(flip, 1.0 - r, r)


def student_two_sided(t, df: float) -> np.ndarray:
    t = np.asarray(t, float)
    if not df > 0:
        return np.full(t.shape, np.nan)
    p = beta_reg(df / 2.0, 0.5, df / (df + np.where(np.isfinite(t), t, 0.0) ** 2))
    return np.where(np.isnan(t), np.nan, np.where(np.isinf(t), 0.0, p))
