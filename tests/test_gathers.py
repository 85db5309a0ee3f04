"""Slant stacks, weaving, stored images, uneven axes and band-limited impulses against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.operators import axes, gathers, lookups, receivers, weave
from wavefold.sources import images

SLOW, DT, NT = [-2e-4, 0.0, 1.1e-4, 3e-4], 0.004, 40
PLACES = {0: [0.0, 40.0, 75.0, 130.0, 170.0, 260.0], 1: [10.0, 55.0, 90.0]}


def matrix(xs):
    """Events by slowness and time to samples by place and time."""
    out = np.zeros((len(xs), NT, len(SLOW), NT))
    for i, x in enumerate(xs):
        for k, p in enumerate(SLOW):
            for tau in range(NT):
                u = tau + p * x / DT
                for t in (int(np.floor(u)), int(np.floor(u)) + 1):
                    if 0 <= t < NT:
                        out[i, t, k, tau] += 1 - abs(u - t)
    return out.reshape(len(xs) * NT, len(SLOW) * NT)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    events = {g: rng.normal(size=len(SLOW) * NT) * (rng.random(len(SLOW) * NT) < 0.1) for g in PLACES}
    samples = {g: matrix(xs) @ events[g] for g, xs in PLACES.items()}
    rows = [(g, x, t, float(samples[g].reshape(len(xs), NT)[i, t])) for g, xs in PLACES.items() for i, x in enumerate(xs) for t in range(NT)]
    return samples, spark.createDataFrame(rows, "g int, x double, it long, v double")


def arrays(df, names, shape):
    out = {g: np.zeros(shape(g)) for g in PLACES}
    for r in df.collect():
        out[r["g"]][tuple(names(r))] = r["v"]
    return out


def test_slant_stack_and_model_are_adjoint(spark, data):
    samples, rows = data
    stacked = gathers.slant_stack(rows, ["g"], "x", "it", "v", SLOW, DT, NT)
    got = arrays(stacked, lambda r: (r["ip"], r["itau"]), lambda g: (len(SLOW), NT))
    for g, xs in PLACES.items():
        assert np.allclose(got[g].ravel(), matrix(xs).T @ samples[g])
    laid = gathers.model(stacked, ["g"], "v", rows, "x", "it", SLOW, DT, NT)
    back = arrays(laid, lambda r: (PLACES[r["g"]].index(r["x"]), r["it"]), lambda g: (len(PLACES[g]), NT))
    for g, xs in PLACES.items():
        assert np.allclose(back[g].ravel(), matrix(xs) @ (matrix(xs).T @ samples[g]))


def test_least_squares_by_rounds(spark, data):
    """The events after some rounds are those of conjugate gradients in NumPy, gather by gather, and model the gathers."""
    samples, rows = data
    rounds, damping = 5, 1e-3
    events = gathers.least_squares(rows, ["g"], "x", "it", "v", SLOW, DT, NT, rounds, damping)
    got = arrays(events, lambda r: (r["ip"], r["itau"]), lambda g: (len(SLOW), NT))
    for g, xs in PLACES.items():
        a = matrix(xs)
        m, s = np.zeros(a.shape[1]), a.T @ samples[g]
        p = s.copy()
        for _ in range(rounds):
            q = a @ p
            alpha = s @ s / (q @ q + damping * p @ p)
            m, new = m + alpha * p, s - alpha * (a.T @ q + damping * p)
            p, s = new + (new @ new) / (s @ s) * p, new
        assert np.allclose(got[g].ravel(), m, atol=1e-8)
        assert np.linalg.norm(a @ m - samples[g]) < 0.1 * np.linalg.norm(samples[g])


def test_deghosting_takes_the_ghost_out(spark):
    depth, velocity = 7.5, 1500.0
    rng = np.random.default_rng(3)
    clean = np.zeros((len(SLOW), NT))
    clean[:, 4:25] = rng.normal(size=(len(SLOW), 21))
    delays = 2 * depth * np.sqrt(1 / velocity**2 - np.array(SLOW) ** 2)
    w = 2 * np.pi * np.fft.rfftfreq(2 * NT, DT)
    ghosted = np.fft.irfft(np.fft.rfft(clean, 2 * NT, axis=1) * (1 - 0.6 * np.exp(-1j * w * delays[:, None])), 2 * NT, axis=1)[:, :NT]
    rows = [(0, k, t, float(ghosted[k, t])) for k in range(len(SLOW)) for t in range(NT)]
    out = gathers.deghost(spark.createDataFrame(rows, "g int, ip long, itau long, v double"), ["g"], "v", SLOW, DT, NT, depth, velocity, -0.6, 1e-6)
    got = np.zeros_like(clean)
    for r in out.collect():
        got[r["ip"], r["itau"]] = r["v"]
    assert np.abs(got - clean).max() < 0.25 * np.abs(ghosted - clean).max()


def test_weaving_finds_band_limited_volumes(spark):
    n = {"a": 8, "b": 6, "c": 5}
    f = lambda x, y, z: 1 + np.cos(2 * np.pi * (2 * x / 8 + 0.1)) * np.sin(2 * np.pi * y / 6) + np.cos(2 * np.pi * (z / 5 + 0.3)) * np.cos(2 * np.pi * x / 8)
    rows = [(7, i, j, k, float(f(i, j, k))) for i in range(8) for j in range(6) for k in range(5)]
    out = weave.weave(spark.createDataFrame(rows, "g int, a int, b int, c int, v double"), ["g"], n, "v").collect()
    assert len(out) == 8 * 8 * 6 * 5
    assert all(r["v"] == pytest.approx(f(r["a"] / 2, r["b"] / 2, r["c"] / 2), abs=1e-9) for r in out)


def test_stored_images_count_each_batch_once(spark, tmp_path):
    path, kinds = f"file://{tmp_path}/image", "x bigint, il bigint, v bigint"
    part = lambda rows: spark.createDataFrame(rows, kinds)
    read = lambda: {(r["x"], r["il"]): r["v"] for r in images.image(spark, path, kinds, ["x", "il"], "v").collect()}
    assert read() == {}
    images.accumulate(path, part([(0, 0, 1), (0, 70, 2), (0, 0, 4)]), ["x", "il"], "il", "v", 1)
    images.accumulate(path, part([(0, 0, 10), (1, 70, 20)]), ["x", "il"], "il", "v", 2)
    whole = {(0, 0): 15, (0, 70): 2, (1, 70): 20}
    assert read() == whole
    images.accumulate(path, part([(0, 0, 10), (1, 70, 20)]), ["x", "il"], "il", "v", 2)  # once more
    assert read() == whole
    images.fold(spark, path, kinds, ["x", "il"], "v")
    images.accumulate(path, part([(0, 0, 10), (1, 70, 20)]), ["x", "il"], "il", "v", 2)  # and after the fold
    assert read() == whole
    images.accumulate(path, part([(0, 0, 100)]), ["x", "il"], "il", "v", 3)
    images.fold(spark, path, kinds, ["x", "il"], "v")
    assert read() == whole | {(0, 0): 115}


def test_lines_must_fall_on_the_image(spark):
    rows = spark.createDataFrame([(i, 1) for i in range(5)], "il bigint, v int")
    got = images.aligned(rows, {"il": ((7, 4), (3, 2, 8))}).orderBy("il").collect()
    assert [r["il"] for r in got] == [2, 4, 6]
    for partial in ((8, 4), (7, 3)):
        with pytest.raises(ValueError, match="don't fall"):
            images.aligned(rows, {"il": (partial, (3, 2, 8))})


def test_uneven_derivatives_are_those_of_polynomials(spark):
    z = [0.0, 1.0, 2.5, 3.0, 5.5, 7.0, 11.0, 12.0]
    f = lambda x: 2 + 3 * x - 0.5 * x**2
    rows = spark.createDataFrame([(k, i, f(x)) for k in (0, 1) for i, x in enumerate(z)], "k int, i long, v double")
    for order, want in ((1, lambda x: 3 - x), (2, lambda x: -1.0)):
        got = axes.derivative(rows, ["k"], "i", "v", "d", z, order, 5).collect()
        assert len(got) == 16
        for r in got:
            inner = min(max(r["i"], 1), len(z) - 2)
            assert r["d"] == pytest.approx(want(z[inner]), abs=1e-9)
    with pytest.raises(ValueError, match="ascending"):
        axes.derivative(rows, ["k"], "i", "v", "d", [0.0, 0.0])
    assert [r["at"] for r in spark.createDataFrame([(x,) for x in (-1.0, 0.5, 2.5, 4.25, 12.0, 99.0)], "z double").select(lookups.axis_index(F.col("z"), z).alias("at")).collect()] == pytest.approx([0, 0.5, 2, 3.5, 7, 7])


def test_axis_index_of_a_long_axis(spark):
    z = np.cumsum(np.random.default_rng(1).random(777) + 0.01)
    at = np.random.default_rng(2).uniform(z[0], z[-1], 50)
    got = spark.createDataFrame([(float(x),) for x in at], "z double").select(lookups.axis_index(F.col("z"), z.tolist()).alias("at")).collect()
    assert [r["at"] for r in got] == pytest.approx(np.interp(at, z, np.arange(777)).tolist())


@pytest.mark.parametrize("band", [(0.2, 0.4, False), (0.25, 0.25, False), (0.3, 0.3, True)])
def test_band_limited_gather_is_adjoint_to_scatter(spark, band):
    rng = np.random.default_rng(6)
    xs, cells = rng.uniform(0, 20, 30), rng.normal(size=21)
    places = spark.createDataFrame([(i, float(x), float(a)) for i, (x, a) in enumerate(zip(xs, rng.normal(size=30), strict=True))], "id int, x double, a double")
    grid = spark.createDataFrame([(i, float(v)) for i, v in enumerate(cells)], "ix long, v double")
    put = lookups.spread_band(places, "x", 21, 4, *band).groupBy("ix").agg(F.sum(F.col("w") * F.col("a")).alias("s"))
    read = lookups.gather_bands(places.select("id", "x"), ["id"], "x", 21, 4, {"r": band}, grid, "v")
    left = sum(r["s"] * cells[r["ix"]] for r in put.collect())
    amplitudes = {r["id"]: r["a"] for r in places.collect()}
    right = sum(r["r"] * amplitudes[r["id"]] for r in read.collect())
    assert read.count() == 30 and left == pytest.approx(right, abs=1e-9)


def test_a_dipole_reads_a_slope(spark):
    place = spark.createDataFrame([(0, 25.3)], "id int, x double")
    low = 0.02
    for f, want in ((lambda x: 1.0, 0.0), (lambda x: np.sin(0.2 * x), None)):
        grid = spark.createDataFrame([(i, float(f(i))) for i in range(51)], "ix long, v double")
        r = lookups.gather_bands(place, ["id"], "x", 51, 20, {"one": (0.3, 0.3, False), "two": (0.3, 0.3, True)}, grid, "v").first()
        if want is None:
            assert r["one"] == pytest.approx(f(25.3), abs=low) and np.sign(r["two"]) == -np.sign(np.cos(0.2 * 25.3))
        else:
            assert r["one"] == pytest.approx(1.0, abs=low) and r["two"] == pytest.approx(0.0, abs=low)
    with pytest.raises(ValueError, match="slope"):
        lookups.spread_band(place, "x", 1, 4, 0.3, 0.3, True)


def test_as_of_by_buckets(spark):
    rng = np.random.default_rng(9)
    table = [(int(k), float(x), int(a), int(b)) for k, x, a, b in zip(rng.integers(0, 3, 80), rng.integers(-300, 300, 80) / 2, rng.integers(0, 4, 80), rng.integers(0, 9, 80), strict=True)]
    table += [(0, 5.0, 1, 1), (0, 5.0, 1, 7), (0, 5.0, 0, 9)]
    rows = [(i, int(k), float(x)) for i, (k, x) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(-320, 320, 200) / 2, strict=True))] + [(900, 0, None), (901, 0, 5.0)]
    want = {}
    for i, k, x in rows:
        known = [(y, a, b) for kk, y, a, b in table if kk == k and x is not None and y <= x]
        want[i] = max(known)[1:] if known else (None, None)
    df, lines = spark.createDataFrame(rows, "id int, k int, x double"), spark.createDataFrame(table, "k int, y double, a int, b int")
    for width in (3.0, 64.0, 1e6):
        got = {r["id"]: (r["a"], r["b"]) for r in lookups.as_of(df, ["k"], "x", lines, "y", ["a", "b"], width).collect()}
        assert got == want


def test_receiver_lines_by_frequency_and_wavenumber(spark):
    n, length, dx, dt = 6, 10, 20.0, 0.004
    x = np.random.default_rng(8).normal(size=(2, n, length))
    x[1, 3] = 0.0  # a receiver that is not there
    rows = [(g, r, x[g, r].tolist()) for g in (0, 1) for r in range(n) if (g, r) != (1, 3)] + [(0, 9, x[0, 0].tolist()), (1, 2, [1.0])]
    weight = receivers.obliquity(1500.0, 2.0, 5.0, 0.15)
    w, k = 2 * np.pi * np.fft.fftfreq(length, dt), 2 * np.pi * np.fft.fftfreq(n, dx)
    want = np.fft.ifft2(np.fft.fft2(x, axes=(1, 2)) * weight(np.abs(w)[None, :], k[:, None])[None], axes=(1, 2)).real
    out = receivers.filter_line(spark.createDataFrame(rows[:-1], "g int, r int, s array<double>"), ["g"], "r", "s", n, length, dx, dt, weight).collect()
    assert len(out) == 2 * n
    assert all(np.allclose(r["s"], want[r["g"], r["r"]]) for r in out)
    assert weight(np.array([100.0]), np.array([1.0]))[0] == 0 and weight(np.array([0.0]), np.array([0.0]))[0] == 0
