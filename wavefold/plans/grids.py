"""Grids and job settings, planned on the driver."""

from __future__ import annotations

import math
import os

import numpy as np


def merge(base, over):
    """Settings with others laid over them: maps key by key, sequences place by place, all else replaced."""
    if over is None:
        raise ValueError("nothing to merge")
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: merge(base[k], v) if k in base else v for k, v in over.items()}
    if isinstance(base, list) and isinstance(over, list):
        return [merge(a, b) for a, b in zip(base, over, strict=False)] + over[len(base) :] + base[len(over) :]
    return over


def settings(*layers: dict, overrides: list[str] = ()) -> dict:
    """Layers in order, then key=value overrides; dots lead into maps, and text expands environment variables."""
    out: dict = {}
    for layer in layers:
        out = merge(out, layer)
    for item in overrides:
        key, _, value = item.partition("=")
        tree: dict | str = os.path.expandvars(value)
        for part in reversed(key.split(".")):
            tree = {part: tree}
        out = merge(out, tree)
    return out


def physics(keys: set[str]) -> str:
    """Which wave equation the configured volumes ask for."""
    if keys & {"dip", "azimuth", "dipx", "dipy", "pjx", "pjy"}:
        return "TTI"
    return "VTI" if keys & {"delta", "epsilon"} else "ISO"


def depths_by_time(velocity: np.ndarray, dz: float, dt: float, zmax: float) -> np.ndarray:
    """Depths at equal travel times through a profile: the irregular z axis."""
    z = np.arange(len(velocity)) * dz
    time = np.concatenate([[0], np.cumsum(dz / 2 * (1 / velocity[1:] + 1 / velocity[:-1]))])
    n = int(time[np.searchsorted(z, min(zmax, z[-1]), side="right") - 1] / dt) + 1
    return np.interp(np.arange(n) * dt, time, z)


def snapped(low: float, high: float, origin: float, step: float, increment: int) -> tuple[float, int]:
    """The first line at or above low that falls on the increments from the origin, and how many lines lie up to high."""
    first = math.ceil((low - origin) / (step * increment) - 1e-9) * increment
    last = math.floor((high - origin) / (step * increment) + 1e-9) * increment
    return origin + first * step, max(0, (last - first) // increment + 1)


def smooth_least(profile: np.ndarray, rounds: int) -> np.ndarray:
    """Rounds of the 1-2-1 mean that never rise above the profile."""
    out = profile.astype(float)
    for _ in range(rounds):
        padded = np.pad(out, 1, mode="edge")
        out = np.minimum(out, 0.25 * padded[:-2] + 0.5 * out + 0.25 * padded[2:])
    return out
