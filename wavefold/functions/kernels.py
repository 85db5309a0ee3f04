"""Interpolation kernels as matrices of weights."""

from __future__ import annotations

import numpy as np


def lanczos(x: np.ndarray, half: int) -> np.ndarray:
    return np.where(np.abs(x) < half, np.sinc(x) * np.sinc(x / half), 0.0)


def linear(x: np.ndarray, half: int) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def lagrange(x: np.ndarray, half: int) -> np.ndarray:
    """Weights of the polynomial through the 2 half samples around a place; x: samples less the place."""
    used = np.flatnonzero((x > -half) & (x <= half))
    out = np.zeros_like(x)
    for j in used:
        others = used[used != j]
        out[j] = np.prod(x[others] / (x[others] - x[j]))
    return out


KERNELS = {"lanczos": lanczos, "linear": linear, "lagrange": lagrange}


def weights(n: int, places: np.ndarray, kernel: str, half: int, narrow: bool = True) -> np.ndarray:
    """A row for each place (in samples) with the weights of the n samples, which are those of the kernel as they are; zero for a place beyond them. Near the ends the kernel narrows, so that it stays inside, or with narrow=False is cut. One sample alone holds everywhere."""
    if n == 1:
        return np.ones((len(places), 1))
    at = np.arange(n)
    out = np.zeros((len(places), n))
    for i, p in enumerate(places):
        if 0 <= p <= n - 1:
            base = min(n - 2, int(np.floor(p)))
            out[i] = KERNELS[kernel](at - p, min(half, min(base, n - 2 - base) + 1) if narrow else half)
    return out


def lagrange_axis(axis: np.ndarray, places: np.ndarray, points: int) -> np.ndarray:
    """A row for each place with the weights of the samples of an uneven, ascending axis: the polynomial through the `points` around it, fewer near the ends; beyond the ends the straight line through the last two."""
    n = len(axis)
    out = np.zeros((len(places), n))
    for i, p in enumerate(places):
        base = int(np.clip(np.searchsorted(axis, p, side="right") - 1, 0, max(0, n - 2)))
        room = 1 if p < axis[0] or p > axis[-1] else min(points // 2, base + 1, n - 1 - base)
        used = np.arange(base - room + 1, base + room + 1) if n > 1 else np.array([0])
        for j in used:
            others = used[used != j]
            out[i, j] = np.prod((p - axis[others]) / (axis[j] - axis[others]))
    return out
