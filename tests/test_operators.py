"""Edge rules, sources and the missing-subpackage guard."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.operators import lookups, reductions, stencils
from wavefold.sources import cubes


def series(spark, values):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k int, i int, v double")


def in_order(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def test_box_mean_repeats_edges(spark):
    x = np.random.default_rng(0).normal(size=25)
    padded = np.pad(x, 3, mode="edge")
    want = [padded[i : i + 7].mean() for i in range(25)]
    assert np.allclose(in_order(stencils.box_mean(series(spark, x), ["k"], "i", "v", 3), "mean"), want)


def test_medians(spark):
    x = [3.0, 1, 4, 1, 5, 9, 2, 6]
    assert in_order(stencils.median3(series(spark, x), ["k"], "i", "v"), "median") == pytest.approx([3, 3, 1, 4, 5, 5, 6, 6])
    padded = np.pad(x, 2, mode="edge")
    assert in_order(stencils.running_median(series(spark, x), ["k"], "i", "v", 2), "median") == [float(np.median(padded[i : i + 5])) for i in range(8)]


def test_stencils_take_places_not_rows(spark):
    """A gap in a line is a gap: the rows on either side of it are no neighbours."""
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in ((0, 1), (1, 2), (2, 4), (10, 8), (11, 16), (500, 3))], "k int, i int, v double")
    assert in_order(stencils.box_mean(rows, ["k"], "i", "v", 1), "mean") == pytest.approx([4 / 3, 7 / 3, 3, 12, 12, 3])
    one = [0, 0.8, -0.2, 4 / 105, -1 / 280]
    x = np.zeros(520)
    x[[0, 1, 2, 10, 11, 500]] = 1, 2, 4, 8, 16, 3
    want = [sum(c * (x[i + k] - (x[i - k] if i >= k else 0)) for k, c in enumerate(one)) for i in (0, 1, 2, 10, 11, 500)]
    assert in_order(stencils.derivative(rows, ["k"], "i", "v", "d"), "d") == pytest.approx(want)
    fine = {r["fine"]: r["v"] for r in stencils.upsample(rows, ["k"], "i", "v").collect()}
    assert fine[1] == 1.5 and fine[5] == 4 and fine[21] == 12 and fine[1001] == 3
    assert stencils.weighted(rows, ["k"], "i", "v", [0.25, 0.5, 0.25], "s").filter("i = 2").first()["s"] == pytest.approx((0.25 * 2 + 0.5 * 4) / 0.75)


def test_windows_of_stencils_are_blocks(spark, capsys):
    stencils.box_mean(series(spark, [1, 2, 3]), ["k"], "i", "v", 2).explain()
    plan = capsys.readouterr().out
    assert "__block" in plan and "NestedLoop" not in plan


def test_blocks_hold_few_rows_twice(spark):
    line = spark.range(100_000).select(F.lit(0).alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    for half in (1, 10, 100):
        n = stencils.blocks(line, "i", half).count()
        assert n <= 100_000 * (1 + 2 * half / max(stencils.BLOCK, 16 * half)) + 2 * half + 1


@pytest.mark.parametrize("half", [1, 2, 5])
def test_stencils_across_block_borders(spark, monkeypatch, half):
    """Lines longer than blocks, with gaps, nulls and negative places, against loops over true places."""
    monkeypatch.setattr(stencils, "BLOCK", 4)
    rng = np.random.default_rng(half)
    lines = {k: {int(i): (None if rng.random() < 0.1 else float(rng.integers(0, 50))) for i in rng.choice(np.arange(-70, 260), n, replace=False)} for k, n in ((0, 1), (1, 40), (2, 300))}
    rows = spark.createDataFrame([(k, i, v) for k, line in lines.items() for i, v in line.items()], "k int, i long, v double")
    weights = [0.1 + 0.05 * j for j in range(2 * half + 1)]
    one = stencils.differences(2 * half, True)
    want = {}
    for k, line in lines.items():
        lo, hi = min(line), max(line)
        for i in line:
            near = [line.get(min(max(i + d, lo), hi)) for d in range(-half, half + 1)]
            there = sorted(v for v in near if v is not None)
            inside = [(line.get(i + d) or 0.0) * one[abs(d)] for d in range(-half, half + 1)]
            mass = sum(w for w, v in zip(weights, near, strict=True) if v is not None)
            smooth = sum(w * v for w, v in zip(weights, near, strict=True) if v is not None) / mass * sum(weights) if there else None
            want[k, i] = (line[i], sum(there) / len(there) if there else None, there[(len(there) - 1) // 2] if there else None, smooth, sum(inside))
    results = [
        stencils.box_mean(rows, ["k"], "i", "v", half, "r"), stencils.running_median(rows, ["k"], "i", "v", half, "r"),
        stencils.weighted(rows, ["k"], "i", "v", weights, "r"), stencils.derivative(rows, ["k"], "i", "v", "r", second=True, accuracy=2 * half),
    ]
    for at, df in enumerate(results, 1):
        got = {(r["k"], r["i"]): r for r in df.collect()}
        assert got.keys() == want.keys()
        for key, w in want.items():
            assert got[key]["v"] == w[0] and (got[key]["r"] is None) == (w[at] is None) and (w[at] is None or got[key]["r"] == pytest.approx(w[at])), (at, key)


def test_filters_of_volumes_equal_numpy(spark):
    x = np.random.default_rng(3).normal(size=(5, 6, 4))
    cells = spark.createDataFrame([(i, j, k, float(x[i, j, k])) for i in range(5) for j in range(6) for k in range(4)], "a int, b int, c int, v double")
    want = x
    for axis, half in ((1, 2), (0, 1), (2, 1)):
        padded = np.pad(want, [(half, half) if n == axis else (0, 0) for n in range(3)], mode="edge")
        want = np.stack([np.take(padded, range(i, i + want.shape[axis]), axis) for i in range(2 * half + 1)]).mean(axis=0)
    got = stencils.along_axes(cells, [], ["a", "b", "c"], "v", [("b", stencils.mean_along("v", 2)), ("a", stencils.mean_along("v", 1)), ("c", stencils.mean_along("v", 1))])
    assert all(r["v"] == pytest.approx(want[r["a"], r["b"], r["c"]]) for r in got.collect())
    for accuracy in (2, 8, 16):
        t = np.arange(-accuracy, accuracy + 1, dtype=float)
        for second in (False, True):
            c = stencils.differences(accuracy, second)
            both = np.array([*((1 if second else -1) * v for v in c[:0:-1]), *c])
            n = len(c) - 1
            k = np.arange(-n, n + 1, dtype=float)
            assert (both * k**2).sum() == pytest.approx(2 if second else 0, abs=1e-9) and (both * k).sum() == pytest.approx(0 if second else 1, abs=1e-9) and len(t)


def test_lag_join_equals_loops(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 9, 20), rng.integers(1, 9, 20)
    left, right = (spark.createDataFrame([(0, t, int(v)) for t, v in enumerate(x)], "k int, t int, v long") for x in (a, b))
    from pyspark.sql import functions as F

    got = {r["lag"]: r["correlation"] for r in lookups.lag_join(left, right, ["k"], "t", 2, F.col("v"), F.col("v")).collect()}
    assert got == {lag: sum(int(a[t] * b[t + lag]) for t in range(20) if 0 <= t + lag < 20) for lag in range(-2, 3)}


def test_lag_join_is_an_equi_join(spark, capsys):
    from pyspark.sql import functions as F

    t = spark.range(10).select(F.lit(0).alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    lookups.lag_join(t, t, ["k"], "t", 2, F.col("v"), F.col("v")).explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_linear_lookups_are_exact_for_planes_and_keep_points_apart(spark):
    cells = spark.createDataFrame([(i, j, 2.0 * i - 3.0 * j) for i in range(5) for j in range(4)], "ix long, iy long, v double")
    places = [(0.5, 0.25), (3.9, 2.2), (-0.5, 3.5), (0.5, 0.25), (4.0, 3.0)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "id int, x double, y double")
    got = {r["id"]: r["v"] for r in lookups.bilinear(points, ["id"], cells, "x", "y", (5, 4), "v").collect()}
    assert got == pytest.approx({k: 2 * x - 3 * y for k, (x, y) in enumerate(places)})
    clamped = lookups.linear(points, ["id"], {"ix": "x", "iy": "y"}, {"ix": 5, "iy": 4}, cells, "v", clamp=True)
    assert {r["id"]: r["v"] for r in clamped.collect()} == pytest.approx({k: 2 * min(max(x, 0), 4) - 3 * min(max(y, 0), 3) for k, (x, y) in enumerate(places)})
    holed = lookups.bilinear(points, ["id"], cells.filter("ix <> 1"), "x", "y", (5, 4), "v")
    assert {r["id"] for r in holed.filter("v IS NULL").collect()} == {0, 2, 3}
    assert lookups.bilinear(points.limit(0), ["id"], cells, "x", "y", (5, 4), "v").count() == 0


def test_regrid_keeps_planes_and_slowness(spark):
    source, target = {"a": (0.0, 2.0, 4), "b": (1.0, 1.0, 1), "c": (0.0, 1.0, 3)}, {"a": (-1.0, 1.0, 9), "b": (0.0, 1.0, 2), "c": (0.0, 0.5, 5)}
    cells = spark.createDataFrame([(i, 0, k, 1 / (10.0 + i + 5 * k)) for i in range(4) for k in range(3)], "a long, b long, c long, v double")
    got = lookups.regrid(cells, source, target, "v", reciprocal=True).collect()
    assert len(got) == 90
    assert all(1 / r["v"] == pytest.approx(10 + min(max((r["a"] - 1) / 2, 0), 3) + 5 * r["c"] * 0.5) for r in got)


def test_layered_velocity_keeps_the_time(spark):
    cells = spark.createDataFrame([(i, z, 1000.0 + 100 * z) for i in range(3) for z in range(6)], "ix long, z long, v double")
    points = spark.createDataFrame([(7, 0.4), (8, 5.0)], "id int, x double")
    rows = lookups.layered(cells, points, ["id"], {"ix": "x"}, {"ix": 3}, "z", 10.0, 25.0, "v").collect()
    time = sum(10 / (1000.0 + 100 * z) for z in range(6))
    for i in (7, 8):
        assert sum(r["covered"] / r["v"] for r in rows if r["id"] == i) == pytest.approx(time)


def test_vectors(spark):
    from pyspark.sql import functions as F

    from wavefold.operators import vectors

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 7)) * 3
    x[0, :6] = 0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double, angle double")
    a, b = (tuple(F.col(f"{n}{k}") for k in range(3)) for n in "ab")
    turned = vectors.rotate(a, b, F.col("angle") * 40)
    out = df.select("id", F.array(*vectors.cross(a, b)).alias("cross"), F.array(*vectors.project(a, b)).alias("project"), F.array(*turned).alias("turned"), vectors.norm(turned).alias("long"))
    for r in out.collect():
        u, v, angle = x[r["id"], :3], x[r["id"], 3:6], np.radians(x[r["id"], 6] * 40)
        assert np.allclose(r["cross"], np.cross(u, v)) and r["long"] == pytest.approx(np.linalg.norm(u))
        n = v / np.linalg.norm(v) if v.any() else v
        assert np.allclose(r["project"], n * (u @ n)) and np.allclose(r["turned"], u * np.cos(angle) + np.cross(n, u) * np.sin(angle) + n * (n @ u) * (1 - np.cos(angle)))


def test_surveys_delays_and_templates(spark):
    from pyspark.sql import functions as F

    from wavefold.operators import frames

    s = frames.survey([(0.0, 0.0, 1, 1), (300.0, 400.0, 11, 1), (-80.0, 60.0, 1, 5)])
    assert s.spacing == (50.0, 25.0)
    with pytest.raises(ValueError, match="corners"):
        frames.survey([(0.0, 0.0, 1, 1), (-80.0, 60.0, 1, 5), (300.0, 400.0, 11, 1)])
    x, y = frames.place_of_lines(F.lit(4), F.lit(3), s)
    assert spark.range(1).select(*frames.lines_of_place(x, y, s)).first() == (4, 3)
    lines = spark.createDataFrame([("# all",), ("",), ("7  1.5 2 0.25 3 4 0.5 # two",), ("8",)], "t string")
    assert [tuple(r) for r in frames.parse_delays(lines, "t").collect()] == [(7, None, 1.5, 2.0, 0.25), (7, None, 3.0, 4.0, 0.5)]
    with pytest.raises(Exception, match="not a delay line"):
        frames.parse_delays(spark.createDataFrame([("7 1 2",)], "t string"), "t").collect()
    data = spark.createDataFrame([(1, 3, "c"), (1, 2, "b")], "shot int, r int, d string")
    template = spark.createDataFrame([(1, 8, 80), (1, 9, 90)], "shot int, r int, h int")
    assert {(r["r"], r["d"], r["h"]) for r in frames.with_template(data, template, ["shot"], ["r"], ["h"]).collect()} == {(2, "b", 80), (3, "c", 90)}
    with pytest.raises(Exception, match="counts"):
        frames.with_template(data, template.limit(1), ["shot"], ["r"], ["h"]).collect()


def test_stored_shots_are_read_by_bucket(spark, tmp_path, capsys):
    from wavefold.sources.tables import extract_shots, store_shots

    traces = spark.range(500).selectExpr("id % 50 AS shot", "id AS trace")
    store_shots(traces, f"{tmp_path}/shots", "shot", 8)
    some = extract_shots(spark, f"{tmp_path}/shots", "shot", [3, 17], 8)
    assert sorted(r["trace"] for r in some.collect()) == sorted(i for i in range(500) if i % 50 in (3, 17))
    some.explain("formatted")
    assert "PartitionFilters: [isnotnull(bucket" in capsys.readouterr().out.replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket")
    assert extract_shots(spark, f"{tmp_path}/shots", "shot").count() == 500


def test_tapers_and_cones(spark):
    from pyspark.sql import functions as F

    from wavefold.operators import tapers

    i = F.col("id")
    rows = spark.range(9).select("id", tapers.edges(i, 9, 3).alias("e"), tapers.boundary(i, 9, 2, 0.8).alias("b"), tapers.smooth_step(i / 8).alias("s"), reductions.cone_weight(i, F.lit(3.0)).alias("c"), reductions.cone_weight(i, F.lit(-1.0)).alias("none")).orderBy("id").collect()
    assert [r["e"] for r in rows] == pytest.approx([0, 0.25, 0.75, 1, 1, 1, 0.75, 0.25, 0])
    assert [r["b"] for r in rows] == pytest.approx([0.8, 0.9, 1, 1, 1, 1, 1, 0.9, 0.8])
    assert rows[0]["s"] == 0 and rows[4]["s"] == pytest.approx(0.5) and rows[8]["s"] == 1
    assert [r["c"] for r in rows] == pytest.approx([1, 1, 1, 1, 0.75, 0.25, 0, 0, 0]) and not any(r["none"] for r in rows)


def test_mirror_is_odd(spark):
    got = in_order(lookups.mirror(series(spark, [0, 0, 7, 1, 2]), ["k"], "i", 2, "v", -1), "v")
    assert got == [-2, -1, 0, 1, 2]


def test_empty_tables(spark):
    empty = series(spark, [])
    assert stencils.box_mean(empty, ["k"], "i", "v", 2).count() == 0
    assert reductions.whiten(empty, "v", 0.1).count() == 0


@pytest.mark.parametrize("order", ["<", ">"])
def test_cube_round_trip(spark, tmp_path, order):
    cube = np.arange(2 * 3 * 4, dtype=np.float32).reshape(2, 3, 4)
    header = {"x0": 100.0, "nx": 3, "dx": 25.0, "y0": 0.0, "ny": 2, "dy": 50.0, "nz": 4, "dz": 5.0}
    raw = cubes.header_bytes(header) + cube.tobytes()
    if order == ">":
        raw = np.frombuffer(raw, "<u4").astype(">u4").tobytes()
    (tmp_path / "a.fdm").write_bytes(raw)
    traces = cubes.read_cubes(spark, f"file://{tmp_path}/a.fdm")
    rows = traces.orderBy("iy", "ix").collect()
    assert [list(r["samples"]) for r in rows] == cube.reshape(6, 4).tolist() and rows[1]["x"] == 125.0
    if order == "<":
        cubes.write_cubes(traces.withColumn("file", F.lit("b.fdm")), f"file://{tmp_path}/out", header)
        back = (tmp_path / "out" / "b.fdm").read_bytes()
        assert back[512:] == cube.tobytes() and cubes.read_header(back)["vmax"] == 23.0


def test_entry_point_without_the_training_data_package(tmp_path):
    """The entry point imports, and keeps its other queries, where that package and the pipeline are gone."""
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "wavefold").mkdir()
    for p in (root / "wavefold").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "wavefold" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'stack_bins' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_records_round_trip(spark, tmp_path):
    from wavefold.sources.records import Layout, read_records, write_records

    layout = Layout({"shot": (9, "int"), "sx": (73, "double"), "rz": (41, "float")}, samples=5, skip=16)
    rows = [(f"{s}.rec", i, s, 100.5 + i, -float(i), [float(i + k) for k in range(5)]) for s in (7, 8) for i in range(40)]
    traces = spark.createDataFrame(rows, "file string, ordinal int, shot int, sx double, rz double, samples array<float>").repartition(7)
    write_records(traces, f"file://{tmp_path}/out", layout)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["7.rec", "8.rec"]
    raw = (tmp_path / "out" / "7.rec").read_bytes()
    (tmp_path / "a.rec").write_bytes(raw + b"rest")
    assert len(raw) == 16 + 40 * (240 + 20) and raw[16 + 8 : 16 + 12] == (7).to_bytes(4, "big")
    read = read_records(spark, f"file://{tmp_path}/a.rec", layout, range_bytes=1000)
    assert read.rdd.getNumPartitions() == 11  # one file, many tasks; each trace in one of them
    want = [(i, 7, 100.5 + i, -float(i), [float(i + k) for k in range(5)]) for i in range(40)]
    assert [(r["ordinal"], r["shot"], r["sx"], r["rz"], list(r["samples"])) for r in read.orderBy("ordinal").collect()] == want
    heads = read_records(spark, f"file://{tmp_path}/out", layout, header_only=True, range_bytes=700)
    assert "samples" not in heads.columns
    assert sorted((r["shot"], r["ordinal"], r["sx"]) for r in heads.collect()) == sorted((s, i, x) for _, i, s, x, _, _ in rows)


def test_layouts_of_jobs():
    from wavefold.sources.records import job_layout

    layout = job_layout({"shot_id": 9, "sx": 73, "iline": -1}, 100, {"sx": "float"}, order="<")
    assert layout.fields == {"xline": (193, "int"), "shot_id": (9, "int"), "sx": (73, "float")} and layout.header == 240
    with pytest.raises(ValueError, match="no such field"):
        job_layout({"colour": 1}, 10)


def test_cubes_are_written_and_read_by_many_tasks(spark, tmp_path):
    nx, ny, nz = 7, 5, 6
    header = {"nx": nx, "ny": ny, "nz": nz, "dx": 10.0, "dy": 20.0, "dz": 5.0}
    rows = [(f"{c}.fdm", y, x, [float(c * 1000 + y * 100 + x * 10 + k) for k in range(8 if x == 1 else 4)]) for c in (1, 2) for y in range(ny) for x in range(nx) if (y, x) != (2, 3)]
    traces = spark.createDataFrame(rows, "file string, iy int, ix int, samples array<float>").repartition(6)
    cubes.write_cubes(traces, f"file://{tmp_path}/out", header)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["1.fdm", "2.fdm"]
    read = cubes.read_cubes(spark, f"file://{tmp_path}/out", range_bytes=300)
    assert read.rdd.getNumPartitions() == 2 * -(-(512 + 4 * nx * ny * nz) // 300)
    want = {(f, y, x): ([*s, 0.0, 0.0] if len(s) == 4 else s[:6]) for f, y, x, s in rows} | {(f, 2, 3): [0.0] * 6 for f in names}
    assert {(r["path"].split("/")[-1], r["iy"], r["ix"]): list(r["samples"]) for r in read.collect()} == want
    head = cubes.read_header((tmp_path / "out" / "2.fdm").read_bytes()[:512])
    assert (head["vmin"], head["vmax"], head["nx"]) == (0.0, 2463.0, 7)
    got = cubes.cube_range(read, "path").orderBy("path").collect()
    assert [(r["vmin"], r["vmax"]) for r in got] == [(0.0, 1463.0), (0.0, 2463.0)]
    places = cubes.read_cubes(spark, f"file://{tmp_path}/out/1.fdm", stride=2, columns=["iy", "ix"])
    assert sorted(map(tuple, places.collect())) == [(y, x) for y in range(0, ny, 2) for x in range(0, nx, 2)]


def test_writers_refuse_and_clean_up(spark, tmp_path):
    header = {"nx": 2, "ny": 1, "nz": 3}
    bad = [("a.fdm", 0, 2, [1.0]), ("a.fdm", 1, 0, [1.0]), ("../a", 0, 0, [1.0]), (None, 0, 0, [1.0])]
    for i, row in enumerate(bad):
        with pytest.raises(Exception, match="outside|file's name"):
            cubes.write_cubes(spark.createDataFrame([row], "file string, iy int, ix int, samples array<float>"), f"file://{tmp_path}/{i}", header)
        assert list((tmp_path / str(i)).iterdir()) == []
    (tmp_path / "short.fdm").write_bytes(cubes.header_bytes({"nx": 5, "ny": 5, "nz": 5, "dx": 1.0}) + bytes(40))
    with pytest.raises(Exception, match="ends too early"):
        cubes.read_cubes(spark, f"file://{tmp_path}/short.fdm").collect()
    cubes.write_cubes(spark.createDataFrame([], "file string, iy int, ix int, samples array<float>"), f"file://{tmp_path}/none", header)
    assert cubes.read_cubes(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="mounted"):
        from wavefold.sources.ranges import local

        local("s3://bucket/a")


@pytest.mark.parametrize("half", [1, 4])
def test_scatter_is_the_adjoint_of_gather(spark, half):
    rng = np.random.default_rng(2)
    places = spark.createDataFrame([(i, float(x), float(a)) for i, (x, a) in enumerate(zip(rng.uniform(6, 40, 30), rng.normal(size=30), strict=True))], "id int, x double, a double")
    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=50))], "ix long, v double")
    a = {r["id"]: r["a"] for r in places.collect()}
    v = {r["ix"]: r["v"] for r in cells.collect()}
    one = sum(r["v"] * a[r["id"]] for r in lookups.gather(places, ["id"], {"ix": "x"}, cells, "v", half).collect())
    two = sum(r["added"] * v[r["ix"]] for r in lookups.scatter(places, {"ix": "x"}, "a", half).collect())
    assert one == pytest.approx(two)


def test_stream_is_stacked_to_its_end(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from pyspark.sql.streaming import StreamingQuery

    from wavefold.streaming.stacking import stack_stream

    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self, timeout and 0.001))  # any limit is over at once
    spark.range(0, 600, 1, 6).write.parquet(f"{tmp_path}/rows")
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    got = stack_stream(spark, source, [(F.col("id") % 2).alias("ix")], F.col("id"), str(tmp_path)).orderBy("ix").collect()
    assert [tuple(r) for r in got] == [(0, sum(range(0, 600, 2)), 300), (1, sum(range(1, 600, 2)), 300)]
    assert not spark.streams.active


def test_as_of_orders_places_not_rows(spark, capsys):
    rows = spark.createDataFrame([(i, i % 2, i % 7) for i in range(60)] + [(60, None, 3), (61, 0, None)], "id long, k int, day int")
    places = spark.createDataFrame([(k, d, 10 * d + k) for k in (0, 1) for d in (2, 5)], "k int, at_day int, v int")
    out = lookups.as_of(rows, ["k"], "day", places, "at_day", ["v"])
    last = lambda k, day: max((10 * d + k for d in (2, 5) if k is not None and day is not None and d <= day), default=None)
    assert {(r["id"], r["v"]) for r in out.collect()} == {(r["id"], last(r["k"], r["day"])) for r in rows.collect()}
    assert out.count() == 62
    out.explain()
    plan = capsys.readouterr().out
    window = plan[plan.index("Window") :]
    assert "NestedLoop" not in plan and "id#" not in window[: window.index("Union")]
    assert "HashAggregate" in window


def test_raw_cubes_are_read_in_ranges(spark, tmp_path):
    cube = np.arange(3 * 4 * 5, dtype=np.float32).reshape(3, 4, 5) + 1000
    (tmp_path / "a.bin").write_bytes(cube.tobytes())
    rows = cubes.read_raw_cube(spark, f"file://{tmp_path}/a.bin", (4, 3, 5), (1, 0, 1), (2, 2, 3)).orderBy("iy", "ix").collect()
    assert [(r["iy"], r["ix"], list(r["samples"])) for r in rows] == [(y // 2, x // 2, cube[y, x, 1::3].tolist()) for y in (0, 2) for x in (1, 3)]
    assert cubes.load_model(spark, f"file://{tmp_path}/a.bin", True, (4, 3, 5)).count() == 12
    cube[2, 1, 3] = np.nan
    (tmp_path / "b.bin").write_bytes(cube.tobytes())
    with pytest.raises(Exception, match="not finite or too small"):
        cubes.load_model(spark, f"file://{tmp_path}/b.bin", True, (4, 3, 5)).collect()
    with pytest.raises(ValueError, match="format"):
        cubes.load_model(spark, "file:///a.segy")


def test_unknown_formats_are_errors(spark):
    from wavefold.sources import tables

    with pytest.raises(ValueError, match="format"):
        tables.save(spark.range(1), "file:///tmp/x.su")


def _generated(df):
    """Lines of a plan that make several rows of one."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]


def _odd_field(seed):
    """Cells with holes, also at negative places, and places across borders of bricks: one has no coordinate, two have one key."""
    rng = np.random.default_rng(seed)
    cells = {(i, j): float(v) for (i, j), v in zip([(i, j) for i in range(-4, 9) for j in range(-3, 7)], rng.normal(size=130), strict=True) if rng.random() < 0.8}
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-6, 11, 40), rng.uniform(-5, 9, 40), strict=True))]
    return cells, [*places, (0, 1.25, 2.5), (50, 3.0, 2.0), (51, None, 1.0)]


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("half", [1, 3])
def test_gather_keeps_a_row_a_receiver(spark, monkeypatch, half, few):
    monkeypatch.setattr(lookups, "BRICK", 9)
    cells, places = _odd_field(half)
    weight = lambda x, i: 1 - abs(x - i) if half == 1 else np.sinc(x - i) * np.sinc((x - i) / half)
    want = {}
    for k, x, y in places:
        reach = [] if x is None else [(i, j) for i in range(int(np.floor(x)) + 1 - half, int(np.floor(x)) + half + 1) for j in range(int(np.floor(y)) + 1 - half, int(np.floor(y)) + half + 1)]
        want[k] = None if x is None else want.get(k, 0.0) + sum(weight(x, i) * weight(y, j) * cells.get((i, j), 0.0) for i, j in reach)
    got = lookups.gather(spark.createDataFrame(places, "id int, x double, y double"), ["id"], {"ix": "x", "iy": "y"}, spark.createDataFrame([(*p, v) for p, v in cells.items()], "ix int, iy int, v double"), "v", half, few=few)
    assert all("__b_" in line for line in _generated(got))  # only cells are dealt to several bricks
    got = {r["id"]: r["v"] for r in got.collect()}
    assert got.pop(51) is None and want.pop(51) is None
    assert got == pytest.approx(want)


def test_small_files_share_a_task(spark, tmp_path):
    from wavefold.sources.records import Layout, read_records, write_records

    layout = Layout({"shot": (9, "int")}, samples=3)
    rows = [(f"{s}.rec", i, s, None if i == 1 else [float(s + k) for k in range(i)]) for s in range(60) for i in range(6)]
    write_records(spark.createDataFrame(rows, "file string, ordinal int, shot int, samples array<float>").repartition(3), f"file://{tmp_path}/out", layout)
    read = read_records(spark, f"file://{tmp_path}/out", layout)
    assert read.rdd.getNumPartitions() == 1
    want = {(f, i): (s, [*(v or []), 0.0, 0.0, 0.0][:3]) for f, i, s, v in rows}
    assert {(r["path"].split("/")[-1], r["ordinal"]): (r["shot"], list(r["samples"])) for r in read.collect()} == want
    heads = read_records(spark, f"file://{tmp_path}/out", layout, header_only=True, range_bytes=100 << 10)
    assert 6 <= heads.rdd.getNumPartitions() <= 12  # a file counts 16 kB besides its own bytes
    assert sorted((r["shot"], r["ordinal"]) for r in heads.collect()) == sorted((s, i) for _, i, s, _ in rows)


@pytest.mark.parametrize("name", ["record_headers", "record_files"])
def test_records_stand_a_round_at_a_time(spark, tmp_path, monkeypatch, name):
    import duckdb

    from wavefold.plans import volume_queries  # noqa: F401  (registers its queries)
    from wavefold.plans.registry import ORACLE_SQL, QUERIES
    from wavefold.sources import records

    folder, stood, write = "/root/testdata/sf0.001", [], records.write_records
    monkeypatch.setattr(records, "ROUND_BYTES", 500_000)
    monkeypatch.setattr(records, "shared_folder", lambda _, name: f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    monkeypatch.setattr(records, "write_records", lambda *a: (write(*a), stood.append(sum(f.stat().st_size for f in tmp_path.rglob("*.rec")))))
    got = QUERIES[name](spark, folder).toPandas()
    assert len(stood) >= 3 and max(stood) < sum(stood) and not list(tmp_path.rglob("*.rec"))
    want = duckdb.sql(ORACLE_SQL[name].replace("FROM lineitem", f"FROM '{folder}/lineitem.parquet'")).df()
    columns = sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and all((a[c] == b[c]).all() for c in columns)


def _lines_sum(cells, x, y, clamp, reciprocal):
    """Bilinear in a grid of 9 x 7 by loops; None where a corner with a weight is not there."""
    x, y = (min(max(x, 0.0), 8.0), min(max(y, 0.0), 6.0)) if clamp else (x, y)
    i, j = min(max(int(np.floor(x)), 0), 7), min(max(int(np.floor(y)), 0), 5)
    near = [((x - i if a else 1 - (x - i)) * (y - j if b else 1 - (y - j)), cells.get((i + a, j + b))) for a in (0, 1) for b in (0, 1)]
    near = [(w, v) for w, v in near if w != 0]
    return None if any(v is None for _, v in near) else sum(w / v if reciprocal else w * v for w, v in near)


def _check_linear(spark, monkeypatch, few, **how):
    monkeypatch.setattr(lookups, "BRICK", 9)
    monkeypatch.setattr(lookups, "FEW", few)
    cells, places = _odd_field(7)
    cells = {p: 2.0 + abs(v) for p, v in cells.items()}
    want = {}
    for k, x, y in places:
        v = None if x is None else _lines_sum(cells, x, y, how.get("clamp"), how.get("reciprocal"))
        want[k] = v if k not in want else None if None in (v, want[k]) else v + want[k]
    if how.get("reciprocal"):
        want = {k: v if v is None else 1 / v for k, v in want.items()}
    if not how.get("clamp"):
        want.pop(51)  # no coordinate: no corner; clamped it lies at the edge, in Spark and in SQL
    else:
        v = _lines_sum(cells, 0.0, 1.0, True, how.get("reciprocal"))
        want[51] = None if v is None else 1 / v if how.get("reciprocal") else v
    got = lookups.linear(spark.createDataFrame(places, "id int, x double, y double"), ["id"], {"ix": "x", "iy": "y"}, {"ix": 9, "iy": 7}, spark.createDataFrame([(*p, v) for p, v in cells.items()], "ix int, iy int, v double"), "v", **how)
    assert all("__b_" in line for line in _generated(got))  # only cells are dealt to several bricks
    got = {r["id"]: r["v"] for r in got.collect()}
    assert set(got) == set(want) and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None})


@pytest.mark.parametrize("few", [0, 1000])
def test_linear_keeps_a_row_a_point(spark, monkeypatch, few):
    _check_linear(spark, monkeypatch, few)


def test_linear_by_slowness_keeps_a_row_a_point(spark, monkeypatch):
    """As trilinear_slowness asks for it: clamped, by reciprocals."""
    _check_linear(spark, monkeypatch, 1000, clamp=True, reciprocal=True)


@pytest.mark.parametrize("few", [False, True])
def test_ghosts_keep_a_row_a_receiver(spark, monkeypatch, few):
    monkeypatch.setattr(lookups, "BRICK", 9)
    cells, places = _odd_field(5)
    field = spark.createDataFrame([(*p, v) for p, v in cells.items()], "ix int, iy int, v double")
    receivers = spark.createDataFrame(places, "id int, x double, y double")
    mirrored = receivers.withColumn("y", 3.0 - F.col("y"))
    own, ghost = ({r["id"]: r["v"] for r in lookups.gather(r, ["id"], {"ix": "x", "iy": "y"}, field, "v").collect()} for r in (receivers, mirrored))
    got = lookups.gather_less_ghost(receivers, ["id"], {"ix": "x", "iy": "y"}, "iy", 1.5, field, "v", few=few)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and all("__b_" in line for line in _generated(got))  # only cells are dealt to several bricks
    got = {r["id"]: r["v"] for r in got.collect()}
    assert got.pop(51) is None and own.pop(51) is None
    assert got == pytest.approx({k: v - ghost[k] for k, v in own.items()})
