"""Functions of whole traces: native array expressions, and NumPy over Arrow batches for what needs a spectrum."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Traces = Callable[[np.ndarray], np.ndarray]


def map_traces(df: DataFrame, keep: list[str], samples: str, function: Traces, name: str = "samples") -> DataFrame:
    """Applies a function of matrices (a row a trace) to all traces of df, those of one length in a batch at once. A null or empty trace stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            lengths = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()])
            out: list = column.to_pylist() if (lengths == 0).any() else [None] * len(lengths)
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                rows = function(np.asarray(column.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), n))
                for i, row in zip(at, rows, strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.list_(pa.float64()))], [*keep, name])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, F.col(samples).cast("array<double>")).mapInArrow(run, f"{kinds}`{name}` array<double>")


def time_shift(shift: float) -> Traces:
    """Shifts traces by so many samples, fractions too, by a phase ramp; what leaves at one end enters at the other."""

    def apply(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        phase = np.exp(-2j * np.pi * np.fft.rfftfreq(n) * shift)
        if n % 2 == 0 and shift != int(shift):
            phase[-1] = np.cos(np.pi * shift)
        return np.fft.irfft(np.fft.rfft(x, axis=1) * phase, n, axis=1)

    return apply


def band_pass(dt: float, corners: tuple[float, float, float, float], power: float = 0.0, phase: float = 0.0) -> Traces:
    """Cosine-edged band, times frequency to a power, turned by a phase in radians."""
    a, b, c, d = corners

    def apply(x: np.ndarray) -> np.ndarray:
        f = np.fft.rfftfreq(x.shape[1], dt)
        weight = np.interp(f, [a, b, c, d], [0, 1, 1, 0], left=0, right=0)
        weight = 0.5 - 0.5 * np.cos(np.pi * weight)
        with np.errstate(divide="ignore"):
            weight = weight * np.where(f > 0, (2 * np.pi * f) ** power, 0.0 if power else 1.0)
        return np.fft.irfft(np.fft.rfft(x, axis=1) * weight * np.exp(1j * phase * (f > 0)), x.shape[1], axis=1)

    return apply


def phase_correction(dt: float, inverse: bool = False) -> Traces:
    """Takes the dispersion of second-order time steps out of traces (or puts it in): samples the spectrum at the frequency a step of dt turns into the true one."""

    def apply(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        w = 2 * np.pi * np.fft.rfftfreq(n, dt)
        half = np.clip(w * dt / 2, 0, np.pi / 2)
        true = 2 / dt * np.sin(half) if not inverse else 2 / dt * np.arcsin(np.clip(half, 0, 1))
        kernel = np.exp(-1j * true[:, None] * dt * np.arange(n)[None, :])
        return np.fft.irfft(x @ kernel.T, n, axis=1)

    return apply


def spectral_derivative(step: float, times: int = 1) -> Traces:
    """The derivative by wavenumbers; the Nyquist one counts for even orders only."""

    def apply(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        k = (2j * np.pi * np.fft.rfftfreq(n, step)) ** times
        if n % 2 == 0 and times % 2:
            k[-1] = 0
        return np.fft.irfft(np.fft.rfft(x, axis=1) * k, n, axis=1)

    return apply


def cosine_derivative(step: float) -> Traces:
    """The derivative by cosines: of the trace continued evenly beyond both ends, so that ends need not meet; the result is odd there."""

    def apply(x: np.ndarray) -> np.ndarray:
        both = np.concatenate([x, x[:, ::-1]], axis=1)
        return spectral_derivative(step)(both)[:, : x.shape[1]]

    return apply


def compact_derivative(step: float) -> Traces:
    """The fourth-order implicit first derivative, one banded solve for all traces of a batch; one-sided third order at the ends."""

    def apply(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if n < 4:
            return np.gradient(x, step, axis=1) if n > 1 else np.zeros_like(x)
        low, mid, high = np.full(n, 0.25), np.ones(n), np.full(n, 0.25)
        low[0] = high[-1] = 0.0
        high[0] = low[-1] = 2.0
        right = np.empty_like(x)
        right[:, 1:-1] = 0.75 * (x[:, 2:] - x[:, :-2]) / step
        right[:, 0] = (-2.5 * x[:, 0] + 2 * x[:, 1] + 0.5 * x[:, 2]) / step
        right[:, -1] = (2.5 * x[:, -1] - 2 * x[:, -2] - 0.5 * x[:, -3]) / step
        for i in range(1, n):
            m = low[i] / mid[i - 1]
            mid[i] -= m * high[i - 1]
            right[:, i] -= m * right[:, i - 1]
        out = np.empty_like(x)
        out[:, -1] = right[:, -1] / mid[-1]
        for i in range(n - 2, -1, -1):
            out[:, i] = (right[:, i] - high[i] * out[:, i + 1]) / mid[i]
        return out

    return apply


def resample(old_step: float, new_step: float, n: int, kernel: str = "lanczos", half: int = 9) -> Traces:
    """n samples at a new step, each a weighted sum of those within half old samples; places beyond the trace are zero."""
    from wavefold.functions.kernels import weights

    return lambda x: x @ weights(x.shape[1], np.arange(n) * new_step / old_step, kernel, half).T


# Native expressions on arrays


def pad(samples: Column, n: int, value: Column | None = None) -> Column:
    """Extended to n samples with the last one, or with a value."""
    fill = F.element_at(samples, -1) if value is None else value
    return F.when(F.size(samples) > 0, F.concat(samples, F.array_repeat(fill, F.greatest(n - F.size(samples), F.lit(0))))).otherwise(samples)


def cut(samples: Column, first: int, n: int) -> Column:
    """n samples from the one at first (from 0)."""
    return F.slice(samples, first + 1, n)


def hold(samples: Column, index: int) -> Column:
    """The value at an index over the whole column."""
    return F.array_repeat(F.get(samples, F.lit(index)), F.size(samples))


def ramp_reversed(samples: Column, ramp: int, scale: float) -> Column:
    """Scaled, the first samples ramped up, and in reversed order."""
    return F.reverse(F.transform(samples, lambda x, i: x * scale * F.least(F.lit(1.0), (i + 1) / F.lit(float(ramp + 1)))))


def nonzero_span(samples: Column) -> Column:
    """First and last index of a sample that isn't zero; null where all are."""
    at = F.filter(F.transform(samples, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.struct(F.element_at(at, 1).alias("first"), F.element_at(at, -1).alias("last")))


def normalise(samples: Column) -> Column:
    """Over the largest magnitude, unless that is next to nothing."""
    most = F.array_max(F.transform(samples, F.abs))
    return F.transform(samples, lambda x: F.when(most > 1.2e-37, x / most).otherwise(x))


def gain_by_time(samples: Column, dt: float) -> Column:
    """Samples times their time."""
    return F.transform(samples, lambda x, i: x * i * dt)


def undo_gain(samples: Column, dt: float) -> Column:
    """Samples over their time, the first one zero: what gain_by_time() put on, at the step that the samples have by now."""
    return F.transform(samples, lambda x, i: F.when(i == 0, 0.0).otherwise(x / (F.greatest(i, F.lit(1)) * dt)))
