"""Lossy codecs for stored wavefields, a trace or slab a row: steps of its range, a 16-bit pseudo-float of its largest magnitude, or pairs of samples whose bits follow the ranges of their sums and differences."""

from __future__ import annotations

from functools import cache

import numpy as np

# The pseudo-float's code is a number of steps of 2**-30 below 1024 and of 2**-14 from there on; behind LOG, 10 bits of fraction for each of 16 powers of two from 2**-20 on. ONE and BEYOND stand
# for 1 and for what is greater; SIGN is the sign's bit.
FINE, COARSE, LEAST_POWER, FRACTION = 30, 14, -20, 10
LOG, ONE, BEYOND, SIGN = 0x4000, 1, 0x8000, 0x8000
#: Slabs that nowhere reach this are zero.
NOTHING = 1e-25


def encode_steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row in signed 16-bit steps of its largest magnitude; returns the steps and the scales."""
    scale = np.abs(x).max(axis=1)
    safe = np.where(scale > 0, scale, 1)
    return np.rint(x / safe[:, None] * 32767).astype(np.int16), scale.astype(np.float32)


def decode_steps(words: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return words.astype(np.float64) * (scale.astype(np.float64)[:, None] / 32767)


@cache
def table16() -> np.ndarray:
    """The value of each code, made by the rule above."""
    code = np.arange(LOG)
    plain = np.where(code < 1 << FRACTION, code * 2.0**-FINE, code * 2.0**-COARSE)
    plain[ONE] = 1.0
    power = LEAST_POWER + np.arange(16)
    logs = (2.0**power)[:, None] * (1 + np.arange(1 << FRACTION) / (1 << FRACTION))
    positive = np.concatenate([plain, logs.ravel()])
    negative = -positive
    negative[0] = np.nan
    return np.concatenate([positive, negative])


def encode16(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row over its largest magnitude as pseudo-floats: the sixteen powers of two below 1/16 have ten bits of fraction each, what is above and far below is in even steps, cut off towards zero."""
    scale = np.abs(x).max(axis=1, initial=0.0)
    y = x / np.where(scale > NOTHING, scale, np.inf)[:, None]
    m = np.abs(y)
    fraction, power = np.frexp(m)  # m = fraction * 2**power, fraction from 1/2 on
    power = power.astype(int) - 1
    logs = LOG | (np.clip(power - LEAST_POWER, 0, 15) << FRACTION) | np.floor((2 * fraction - 1) * (1 << FRACTION)).astype(int)
    linear = np.floor(m * 2.0 ** np.where(power >= -4, COARSE, FINE)).astype(int)
    code = np.where(m == 1, ONE, np.where((power >= -4) | (power < LEAST_POWER), linear, logs))
    code = np.where(power < -29, 0, code)
    code = np.where((code > 0) & (y < 0), code | SIGN, code)
    return np.where(m > 1, BEYOND, code).astype(np.uint16), scale


def decode16(words: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return table16()[words] * scale[:, None]


def split_bits(total: np.ndarray, half: np.ndarray, bits: int) -> np.ndarray:
    """How many of the bits of a pair its sum gets, given the ranges of sums and differences: those with which the two steps are least together, the fewest among equals."""
    first = np.arange(bits + 1)
    error = total[:, None] / 2.0 ** first[None, :] + half[:, None] / 2.0 ** (bits - first)[None, :]
    return np.where((total > 0) & (half > 0), error.argmin(axis=1), np.where((total > 0) & (half == 0), bits, bits // 2))


def encode_pairs(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours as half sums and half differences in so many bits a pair, dealt by split_bits(). Returns the codes (two kinds of a row), the ranges, and the bits of the sums. An odd last sample is a sum by itself."""
    odd = x.shape[1] % 2
    a, b = x[:, ::2], np.concatenate([x[:, 1::2], x[:, -1:]], axis=1) if odd else x[:, 1::2]
    parts = np.stack([(a + b) / 2, (a - b) / 2])
    ranges = 2 * np.abs(parts).max(axis=2, initial=0.0)
    first = split_bits(ranges[0], ranges[1], bits)
    steps = 2.0 ** np.stack([first, bits - first]) - 1
    scale = np.divide(steps, ranges, out=np.zeros_like(ranges), where=ranges > 0)
    return np.rint((parts + ranges[:, :, None] / 2) * scale[:, :, None]).astype(np.uint32), ranges, first


def decode_pairs(words: np.ndarray, ranges: np.ndarray, first: np.ndarray, bits: int, n: int) -> np.ndarray:
    steps = 2.0 ** np.stack([first, bits - first]) - 1
    # A kind without bits is zero.
    size = np.divide(ranges, steps, out=np.zeros_like(ranges), where=steps > 0)
    total, half = np.where(steps[:, :, None] > 0, words * size[:, :, None] - ranges[:, :, None] / 2, 0.0)
    out = np.empty((total.shape[0], 2 * total.shape[1]))
    out[:, ::2], out[:, 1::2] = total + half, total - half
    if n % 2:
        out[:, -2] = total[:, -1]
    return out[:, :n]


def _pairs(bits: int):
    return lambda x: decode_pairs(*encode_pairs(x, bits), bits, x.shape[1])


CODECS = {
    "steps": lambda x: decode_steps(*encode_steps(x)),
    "16": lambda x: decode16(*encode16(x)),
    "16p": _pairs(32),
    "8p": _pairs(16),
    "none": lambda x: x.astype(np.float32).astype(np.float64),
}
