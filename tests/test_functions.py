"""Analytic and identity tests of trace functions, kernels, codecs and grids."""

import numpy as np
import pytest

from wavefold.functions import codecs, kernels, traces, wavelets
from wavefold.plans import grids


def test_shift_there_and_back():
    x = np.random.default_rng(0).normal(size=(3, 65))
    assert np.allclose(traces.time_shift(-2.37)(traces.time_shift(2.37)(x)), x)
    assert np.allclose(traces.time_shift(3)(x), np.roll(x, 3, axis=1))


def test_derivatives_of_a_sine():
    n, k = 64, 3
    t = np.arange(n) / n
    x = np.sin(2 * np.pi * k * t)[None]
    assert np.allclose(traces.spectral_derivative(1 / n)(x), 2 * np.pi * k * np.cos(2 * np.pi * k * t))
    assert np.allclose(traces.spectral_derivative(1 / n, 2)(x), -((2 * np.pi * k) ** 2) * x)
    assert np.abs(traces.compact_derivative(1 / n)(x) - 2 * np.pi * k * np.cos(2 * np.pi * k * t)).max() < 0.1


@pytest.mark.parametrize("kernel", ["linear", "lagrange"])
def test_kernels_keep_constants(kernel):
    w = kernels.weights(30, np.linspace(0, 29, 57), kernel, 4)
    assert np.allclose(w.sum(axis=1), 1)
    assert (kernels.weights(30, np.array([-1.0, 30.0]), kernel, 4) == 0).all()
    if kernel != "lanczos":
        assert np.allclose(w @ np.arange(30.0), np.linspace(0, 29, 57))


@pytest.mark.parametrize(("name", "steps"), [("steps", 32767), ("16p", 32767), ("8p", 127)])
def test_codecs_lose_half_a_step(name, steps):
    x = np.random.default_rng(1).normal(size=(5, 33))
    assert (np.abs(codecs.CODECS[name](x) - x) <= 1.01 * np.abs(x).max(axis=1, keepdims=True) / steps).all()


def test_pseudo_floats():
    table = codecs.table16()
    assert len(table) == 65536 and table[1] == 1 and np.isnan(table[0x8000]) and (np.diff(table[0x4000:0x8000]) > 0).all()
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 400)) * 10.0 ** rng.uniform(-8, 0, size=(6, 400))
    x[1, 7], x[2] = 0.0, 0.0
    words, scale = codecs.encode16(x)
    y = codecs.decode16(words, scale)
    m = np.abs(x) / np.where(scale > 0, scale, 1)[:, None]
    bound = np.where(m >= 2**-4, 2.0**-14, np.where(m >= 2**-20, m * 2.0**-10, np.where(m >= 2**-29, 2.0**-30, 2.0**-29)))
    assert (np.abs(y - x) <= bound * np.where(scale > 0, scale, 1)[:, None] * (1 + 1e-12)).all() and (np.abs(y) <= np.abs(x)).all() and not y[2].any()
    assert (np.abs(y[[0, 1, 3, 4, 5]]).max(axis=1) == scale[[0, 1, 3, 4, 5]]).all()  # the largest is kept
    code = np.arange(2, 0x8000)
    assert (codecs.encode16(np.append(1.0, table[code])[None])[0][0, 1:] == code).all()  # what codes stand for has these codes


def test_bits_of_pairs_follow_the_ranges():
    total, half = np.array([8.0, 1.0, 1.0, 5.0, 0.0, 0.0]), np.array([8.0, 0.25, 1024.0, 0.0, 3.0, 0.0])
    assert codecs.split_bits(total, half, 16).tolist() == [8, 9, 3, 16, 8, 8]
    x = np.random.default_rng(2).normal(size=(4, 9))
    smooth = np.cumsum(np.cumsum(x, axis=1), axis=1)
    words, ranges, first = codecs.encode_pairs(smooth, 32)
    y = codecs.decode_pairs(words, ranges, first, 32, 9)
    steps = ranges / (2.0 ** np.stack([first, 32 - first]) - 1)
    assert (np.abs(y - smooth) <= steps.sum(axis=0)[:, None] * 0.51).all()
    alike = np.repeat(x[:, :3], 2, axis=1)  # no differences: all bits go to the sums
    assert np.allclose(codecs.CODECS["16p"](alike), alike, atol=1e-8)
    assert codecs.CODECS["8p"](np.zeros((2, 5))).tolist() == [[0.0] * 5] * 2


def test_phase_correction_keeps_low_frequencies():
    t = np.arange(256) * 0.004
    x = np.exp(-(((t - 0.5) / 0.08) ** 2))[None]
    assert np.abs(traces.phase_correction(0.004)(x) - x).max() < 0.05


def test_band_pass_removes_what_is_outside():
    t = np.arange(500) * 0.002
    low, inside = np.sin(2 * np.pi * 2 * t)[None], np.sin(2 * np.pi * 30 * t)[None]
    f = traces.band_pass(0.002, (8, 12, 60, 80))
    assert np.abs(f(low)).max() < 1e-6 and np.abs(f(inside) - inside).max() < 1e-6


def test_minimum_phase_keeps_the_spectrum_and_comes_early():
    w = wavelets.ricker(129, 0.002, 25.0)
    m = wavelets.minimum_phase(w)
    early = lambda x: np.cumsum(x**2)[40] / (x**2).sum()
    assert early(m) > early(w)


def test_settings():
    base = {"a": {"b": 1, "c": [1, 2]}, "d": 3}
    assert grids.settings(base, {"a": {"c": [9]}}, overrides=["a.b=5"]) == {"a": {"b": "5", "c": [9, 2]}, "d": 3}
    with pytest.raises(ValueError):
        grids.merge(base, None)
    assert [grids.physics(k) for k in ({"vel"}, {"epsilon"}, {"dip", "delta"})] == ["ISO", "VTI", "TTI"]
    assert grids.snapped(101, 199, 0, 12.5, 2) == (125.0, 3)
    z = grids.depths_by_time(np.full(101, 2000.0), 10.0, 0.01, 1000.0)
    assert np.allclose(np.diff(z), 20.0)
    assert (grids.smooth_least(np.array([5.0, 1, 5, 5]), 3) <= [5, 1, 5, 5]).all()


def test_lagrange_is_exact_for_polynomials_on_uneven_axes():
    axis = np.array([0.0, 1.0, 2.5, 4.0, 4.5, 7.0, 10.0])
    places = np.array([0.0, 0.3, 2.5, 3.3, 5.0, 9.0, 10.0, 11.0, -1.0])
    for points, degree, inside in ((2, 1, slice(None)), (4, 3, slice(2, 5))):
        m = kernels.lagrange_axis(axis, places, points)
        assert np.allclose((m @ axis**degree)[inside], (places**degree)[inside])
    assert np.allclose(kernels.lagrange_axis(axis, axis, 6), np.eye(7))


def test_kernels_at_the_ends():
    assert (kernels.weights(1, np.array([0.0, 5.0]), "lanczos", 4) == 1).all()
    m = kernels.weights(10, np.array([-0.1, 0.0, 0.5, 4.5, 9.0, 9.1]), "lanczos", 4)
    assert not m[[0, 5]].any() and np.allclose(m[1], np.eye(10)[0]) and np.allclose(m[4], np.eye(10)[9])
    assert np.flatnonzero(np.abs(m[2]) > 1e-12).tolist() == [0, 1] and len(np.flatnonzero(np.abs(m[3]) > 1e-12)) == 8


def test_image_filters(spark):
    from wavefold.functions import images

    nx, nz = 16, 32
    x, z = np.meshgrid(np.arange(nx), np.arange(nz), indexing="ij")
    wave = np.sin(2 * np.pi * (2 * x / nx + 3 * z / nz))
    cells = spark.createDataFrame([(k, int(i), int(j), float(v)) for k in (1, 2) for i, j, v in zip(x.ravel(), z.ravel(), wave.ravel() * k, strict=True)], "shot int, ix long, iz long, value double")
    rows = images.filter_images(cells, ["shot"], (nx, nz), (1.0, 1.0), images.laplacian).collect()
    k2 = (2 * np.pi * 2 / nx) ** 2 + (2 * np.pi * 3 / nz) ** 2
    assert len(rows) == 2 * nx * nz and all(abs(r["value"] + k2 * r["shot"] * wave[r["ix"], r["iz"]]) < 1e-9 for r in rows)
    one = images.direction(0, 1e-9)(*images.wavenumbers((nx, nz), (1.0, 1.0))) ** 2 + images.direction(1, 1e-9)(*images.wavenumbers((nx, nz), (1.0, 1.0))) ** 2
    assert np.allclose(one.ravel()[1:], -1)


def test_wavelets_of_sources(spark):
    rows = [("ricker", [25.0], 0.0, 0.0), ("ricker", [25.0], 0.0, 0.0), ("ricker-minimum", [25.0], 0.0, 0.0), ("ormsby", [4.0, 8.0, 40.0, 60.0], 1.0, np.pi / 2), ("spiky", [50.0], 0.5, 0.0), ("delta", [], 0.0, 0.0)]
    df = spark.createDataFrame(rows, "kind string, corners array<double>, power double, phase double")
    got = {(r["kind"]): r for r in wavelets.design(df, "kind", "corners", 128, 0.004, "power", "phase").collect()}
    assert len(got) == 5 and got["ricker"]["n_sources"] == 2
    assert np.allclose(got["ricker"]["samples"], wavelets.ricker(128, 0.004, 25.0)) and np.argmax(got["delta"]["samples"]) == 64
    w = wavelets.ormsby(128, 0.004, (4.0, 8.0, 40.0, 60.0))
    # Once the angular frequency and a quarter turn: the derivative.
    inside = slice(20, 108)
    dense = wavelets.ormsby(128 * 16, 0.004 / 16, (4.0, 8.0, 40.0, 60.0))
    slope = np.gradient(dense * np.abs(w).max() / np.abs(dense).max(), 0.004 / 16)[::16]
    assert np.abs(np.array(got["ormsby"]["samples"]) - slope)[inside].max() < 0.02 * np.abs(slope).max()
    early = np.cumsum(np.square(got["ricker-minimum"]["samples"]))
    assert early[32] > 0.95 * early[-1]
