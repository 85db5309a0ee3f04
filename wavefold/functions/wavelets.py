"""Source wavelets, one for each kind of source of a table: a few hundred samples each, designed inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: All wavelets but given ones are scaled by this.
GAIN = 1e5


def ricker(nt: int, dt: float, peak: float) -> np.ndarray:
    t = (np.arange(nt) - nt // 2) * dt
    a = (np.pi * peak * t) ** 2
    return GAIN * (1 - 2 * a) * np.exp(-a)


def ormsby(nt: int, dt: float, corners: tuple[float, float, float, float]) -> np.ndarray:
    t = (np.arange(nt) - nt // 2) * dt
    a, b, c, d = corners
    term = lambda f: (np.pi * f * np.sinc(f * t)) ** 2
    w = (term(d) - term(c)) / (np.pi * (d - c)) - (term(b) - term(a)) / (np.pi * (b - a))
    return GAIN * w / np.abs(w).max()


def delta(nt: int, dt: float, at: int = 0) -> np.ndarray:
    w = np.zeros(nt)
    w[at] = GAIN
    return w


def spiky(nt: int, dt: float, most: float) -> np.ndarray:
    """A flat spectrum up to a frequency, cosine-edged over its last fifth."""
    f = np.fft.rfftfreq(nt, dt)
    edge = np.clip((most - f) / (0.2 * most), 0, 1)
    w = np.fft.fftshift(np.fft.irfft(0.5 - 0.5 * np.cos(np.pi * edge), nt))
    return GAIN * w / np.abs(w).max()


def minimum_phase(w: np.ndarray) -> np.ndarray:
    """The wavelet of the same amplitude spectrum whose energy comes first, by the folded cepstrum."""
    n = 8 * len(w)
    spectrum = np.abs(np.fft.fft(w, n))
    cepstrum = np.fft.ifft(np.log(np.maximum(spectrum, 1e-8 * spectrum.max()))).real
    fold = np.zeros(n)
    fold[0], fold[1 : n // 2], fold[n // 2] = 1, 2, 1
    return np.fft.ifft(np.exp(np.fft.fft(cepstrum * fold))).real[: len(w)]


WAVELETS = {"ricker": ricker, "ormsby": ormsby, "delta": delta, "spiky": spiky}


def shaped(w: np.ndarray, dt: float, power: float, phase: float) -> np.ndarray:
    """A wavelet times angular frequency to a power, turned by a phase in radians: what a source of another dimension or of two poles takes."""
    if not power and not phase:
        return w
    n = 2 * len(w)
    f = 2 * np.pi * np.fft.rfftfreq(n, dt)
    gain = np.where(f > 0, np.maximum(f, 1e-30) ** power, 0.0 if power else 1.0)
    return np.fft.irfft(np.fft.rfft(w, n) * gain * np.exp(1j * phase * (f > 0)), n)[: len(w)]


def made(kind: str, corners: list[float], nt: int, dt: float) -> np.ndarray:
    """A wavelet by its kind: ricker by its peak, spiky by its highest frequency, ormsby by four corners, delta; a name that ends in "-minimum" has its energy first."""
    name, _, phase = kind.partition("-")
    w = delta(nt, dt, nt // 2) if name == "delta" else ormsby(nt, dt, tuple(corners)) if name == "ormsby" else WAVELETS[name](nt, dt, corners[0])
    if phase not in ("", "minimum"):
        raise ValueError(f"no wavelet is known by the name {kind}")
    return minimum_phase(w) if phase else w


def design(sources: DataFrame, kind: str, corners: str, nt: int, dt: float, power: str | None = None, phase: str | None = None) -> DataFrame:
    """(kind, corners, power, phase, n_sources, samples): a wavelet for each kind of source there is, however many sources share it; designs come to as many rows as there are kinds."""
    powers = [F.col(c).cast("double").alias(name) if c else F.lit(0.0).alias(name) for c, name in ((power, "power"), (phase, "phase"))]
    kinds = sources.groupBy(F.col(kind).alias("kind"), F.col(corners).cast("array<double>").alias("corners"), *powers).agg(F.count(F.lit(1)).alias("n_sources"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            designs = [shaped(made(k, c, nt, dt), dt, p, q) for k, c, p, q in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([d.tolist() for d in designs], pa.list_(pa.float64()))], [*b.schema.names, "samples"])

    return kinds.mapInArrow(run, "kind string, corners array<double>, power double, phase double, n_sources bigint, samples array<double>")
