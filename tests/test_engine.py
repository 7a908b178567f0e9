"""Plans, lanes, stencils and whole-raster algorithms."""

import math
import os
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.errors import PlanError
from rasterloom.field import Combine, Curves, Erosion, Filters, Landforms, Lands, Masks, Noises, Shapes, Strata, Terrain, Vec
from rasterloom.functions import noise
from rasterloom.functions.lanes import Blocks, u32_mul
from rasterloom.operators import metrics, raster, stencils, windows
from rasterloom.plans.blocks import block, export
from rasterloom.plans.evaluate import halo, order
from rasterloom.plans.rows import sample_grid, with_fields


def test_u32_multiplication_wraps():
    x = np.random.default_rng(0).integers(0, 1 << 32, 2000)
    assert (u32_mul(Blocks, x, noise.PHI) == (x.astype(np.uint64) * np.uint64(noise.PHI) & np.uint64(0xFFFFFFFF)).astype(np.int64)).all()


def test_arguments_are_checked():
    for bad in (
        lambda: Noises.fBm(octavs=3), lambda: Noises.fBm(octaves=0), lambda: Noises.fBm(kind="perlin"), lambda: Curves.Smoothstep(input=Terrain.Const(), min=1, max=1), lambda: Curves.Clamp(input=Terrain.Const(), min=2, max=1),
        lambda: Filters.Blur(input=Terrain.Const(), radius=33), lambda: Filters.Blur(input=Terrain.Const(), radius=4, method="median"), lambda: Terrain.Normals(input=Terrain.Const()), lambda: Noises.Cellular(domain=3),
        lambda: Terrain.Const() + Terrain.Const(domain=3), lambda: Vec.Combine(Terrain.Const()), lambda: Terrain.Gradient(), lambda: Terrain.Coords().w,
    ):
        with pytest.raises(PlanError):
            bad()


def test_equal_expressions_are_one_node():
    a = lambda: Noises.fBm(frequency=0.01, octaves=2) * 2 + 1
    assert len(order([a(), a()])) == len(order([a()]))
    assert halo([Filters.Blur(input=Erosion.Thermal(input=a(), iterations=5), radius=3)]) == 8
    assert Erosion.Thermal(input=a(), iterations=5).node != Erosion.Thermal(input=a(), iterations=6).node
    with pytest.raises(PlanError):
        halo([Erosion.Thermal(input=Erosion.Thermal(input=a(), iterations=200), iterations=200)])


def test_numbers_take_the_domain_of_the_other_operand():
    assert (1 - Terrain.Const(domain=3)).domain == 3


@pytest.mark.parametrize("kind", list(noise.BASES))
def test_gradients_are_derivatives(kind):
    rng = np.random.default_rng(1)
    p = tuple(rng.uniform(-40, 40, 500) for _ in range(2))
    e = 1e-6
    v, gx, gz = noise.fbm(Blocks, p, kind=kind, frequency=0.11, octaves=3, seed=5)
    up = noise.fbm(Blocks, (p[0] + e, p[1]), kind=kind, frequency=0.11, octaves=3, seed=5)[0]
    side = noise.fbm(Blocks, (p[0], p[1] + e), kind=kind, frequency=0.11, octaves=3, seed=5)[0]
    near = lambda a, b: np.mean(np.abs(a - b) < 1e-3 * (1 + np.abs(b)))
    assert near((up - v) / e, gx) > 0.98 and near((side - v) / e, gz) > 0.98


@pytest.mark.parametrize("multiscale", ["none", "signal", "elevation"])
def test_simplex3_gradient(multiscale):
    rng = np.random.default_rng(2)
    p = tuple(rng.uniform(-9, 9, 400) for _ in range(3))
    v, *g = noise.fbm(Blocks, p, frequency=0.3, octaves=3, seed=5, multiscale=multiscale)
    for k in range(3):
        q = tuple(c + (1e-6 if j == k else 0) for j, c in enumerate(p))
        d = (noise.fbm(Blocks, q, frequency=0.3, octaves=3, seed=5, multiscale=multiscale)[0] - v) / 1e-6
        assert np.mean(np.abs(d - g[k]) < 1e-3) > 0.97
    assert np.abs(v).max() <= 1.3


def test_export_does_not_depend_on_sections(spark):
    h = Noises.fBm(frequency=0.02, octaves=4, amplitude=90)
    outputs = {
        "a": Erosion.Hydraulic(input=Erosion.Thermal(input=h, iterations=6), iterations=5), "b": Filters.Expand(input=h, radius=3, shape="disk", falloff="cone"), "c": Filters.Blur(input=h, radius=2, method="median"),
        "d": Filters.Displace(input=h, by=Vec.Combine(h * 0.05, h * -0.02), radius=4), "e": Noises.Cells(frequency=0.05, style="F2-F1", lattice="hex"), "n": Terrain.Normals(input=h),
        "f": Erosion.Thermal(input=h, iterations=4, two_phase=True, talus=0.1, rock=0.4).talus, "g": Masks.Curvature(input=h), "s": Shapes.Mask(Shapes.Polygon(points=((5.0, 5.0), (60.0, 9.0), (30.0, 55.0))), feather=3),
    }
    one, many = (export(spark, outputs, (-16, 0), (48, 40), 1.0, s, 7).orderBy("sz", "sx").toPandas() for s in (64, 16))
    assert one.equals(many) and len(one) == 64 * 40


def test_volumes(spark):
    v = Noises.fBm(domain=3, frequency=0.1, octaves=2)
    one, many = (export(spark, {"v": Filters.Blur(input=v, radius=1)}, (0, 0, 0), (12, 6, 10), 1.0, s).orderBy("sy", "sz", "sx").toPandas() for s in (16, 4))
    assert one.equals(many) and len(one) == 12 * 6 * 10


def test_lanes_agree(spark):
    p = Shapes.Warp(amplitude=3.0, octaves=1)
    fields = {
        "a": Noises.Ridged(frequency=0.05, octaves=1, position=p), "b": Curves.Terrace(input=Noises.fBm(octaves=1, amplitude=40), step=3), "c": Shapes.Union(Shapes.Ellipse(radii=(6.0, 3.0), at=(9.0, 9.0), rotation=20.0), Shapes.Rect(size=(8.0, 4.0), rounding=1.0), smooth=2.0),
        "e": Landforms.Pyramid(size=(20.0, 14.0), height=9.0), "f": Noises.fBm(kind="terraced", octaves=2, multiscale="elevation"),
    }
    arrays = block(fields, (0, 0), (12, 10), 1.0, 99, np.float64)
    for (name, field), a in zip(sorted(fields.items()), arrays, strict=True):
        rows = with_fields(sample_grid(spark, 12, 10), {name: field}, F.col("sx"), F.col("sz"), seed=99).orderBy("sz", "sx").toPandas()
        assert np.allclose(rows[name].to_numpy(), a.ravel(), atol=1e-9), name


def test_shapes():
    at = lambda f, x, z: block({"f": f}, (x, z), (1, 1), 1.0, 0, np.float64)[0][0, 0]
    assert at(Shapes.Circle(radius=5.0, at=(3.0, 0.0)), 3, 9) == 4 and at(Shapes.Rect(size=(4.0, 2.0)), 5, 0) == 3
    triangle = Shapes.Polygon(points=((0.0, 0.0), (10.0, 0.0), (0.0, 10.0)))
    assert at(triangle, 2, 2) == -2 and at(triangle, -3, 5) == 3 and at(Shapes.Polyline(points=((0.0, 0.0), (10.0, 0.0))), 5, 4) == 4
    assert at(Landforms.Cone(radius=10.0, height=50.0), 0, 0) == 50 and at(Landforms.Bowl(radius=10.0, depth=5.0), 0, 0) == -5
    assert at(Shapes.Spline(((0.0, 0.0), (5.0, 5.0), (10.0, 0.0))), 5, 5) == pytest.approx(0)


def test_thermal_keeps_mass_inside():
    h = np.zeros((40, 40))
    h[20, 20] = 50
    out, _ = stencils.thermal(h, iterations=10, talus=0.5)
    assert out.sum() == pytest.approx(50) and out.max() < 50 and out[20, 21] > 0
    lost, _ = stencils.thermal(h, iterations=10, talus=0.5, mass_balance=0.3)
    assert lost.sum() < 50


def test_hydraulic_stays_finite_and_cuts():
    h = np.add.outer(np.linspace(60, 0, 48), np.random.default_rng(3).normal(size=48))
    out, water, sediment = stencils.hydraulic(h, iterations=40)
    assert np.isfinite(out).all() and (water >= 0).all() and (out < h).any() and (out > h).any()


def test_window_lane_matches_blocks(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 90, (14, 17))
    df = spark.createDataFrame([(x, z, int(a[z, x])) for z in range(14) for x in range(17)], "x long, z long, v long").repartition(3)
    array = lambda d: d.orderBy("z", "x").toPandas()["v"].to_numpy().reshape(14, 17)
    f = a.astype(float)
    assert np.allclose(array(windows.blur(df, 2)), stencils.box_mean(f, 2))
    for shape in ("square", "disk", "diamond", "octagon"):
        assert np.allclose(array(windows.expand(df, 3, shape)), stencils.expand(f, 3, shape)) and np.allclose(array(windows.shrink(df, 3, shape)), stencils.shrink(f, 3, shape))
    assert np.allclose(array(windows.expand(df, 2, "disk", "round", 3.0)), stencils.expand(f, 2, "disk", "round", 3.0))
    assert np.allclose(array(windows.median(df, 1)), stencils.median(f, 1))
    assert np.allclose(array(windows.thermal(df.selectExpr("x", "z", "cast(v as double) v"), 2, talus=5.0)), stencils.thermal(f, 2, talus=5.0)[0])


def flood(land):
    label = np.full(land.shape, -1)
    for z, x in np.ndindex(land.shape):
        if label[z, x] < 0:
            todo, name = deque([(z, x)]), z * land.shape[1] + x
            label[z, x] = name
            while todo:
                p, q = todo.popleft()
                for r, s in ((p + 1, q), (p - 1, q), (p, q + 1), (p, q - 1)):
                    if 0 <= r < land.shape[0] and 0 <= s < land.shape[1] and label[r, s] < 0 and land[r, s] == land[p, q]:
                        label[r, s] = name
                        todo.append((r, s))
    return label


def test_labels_bodies_and_distance(spark):
    land = np.random.default_rng(5).random((18, 23)) < 0.55
    df = spark.createDataFrame([(x, z, bool(land[z, x]), z * 23 + x) for z in range(18) for x in range(23)], "x long, z long, land boolean, cell long")
    labels = raster.label(df)
    expected = flood(land)
    got = labels.orderBy("z", "x").toPandas()["label"].to_numpy().reshape(18, 23)
    assert (got == expected).all()
    for r in raster.bodies(labels, 23, 18).collect():
        at = np.argwhere(expected == r.label)
        assert r.cells == len(at) and r.edge == int((at == 0).any() or (at[:, 0] == 17).any() or (at[:, 1] == 22).any())
    d = raster.distance(df.select("x", "z", "land")).orderBy("z", "x").toPandas()["d2"].to_numpy().reshape(18, 23)
    s = np.argwhere(land)
    assert all(d[z, x] == ((s - (z, x)) ** 2).sum(axis=1).min() for z, x in np.ndindex(18, 23))


def test_flood_and_flow():
    h = np.full((9, 9), 5.0)
    h[4, 4] = 1
    filled, cells = raster.priority_flood(h)
    assert (filled == 5).all() and len(cells) == 81
    slope = np.add.outer(np.arange(12.0), np.zeros(12))
    receiver, area = raster.flow(*(raster.priority_flood(slope, 1e-6)), 1.0)
    assert receiver[5, 5] == 4 * 12 + 5 and area[0, 1:-1].sum() == pytest.approx(10 * 11) and receiver[0, 3] == -1


def test_stream_power_carves_and_wind_keeps_sand():
    rng = np.random.default_rng(6)
    h = raster.stream_power(rng.random((20, 20)), np.full((20, 20), 1.0), 50.0, 25, k=2e-3)
    assert (h[1:-1, 1:-1] > 0).all() and h.max() < 26
    sand = rng.integers(0, 5, (12, 16)) * 3.0
    assert raster.wind(sand, iterations=4, smooth=0).sum() == sand.sum()
    assert raster.wind(sand, iterations=4, smooth=2).sum() == pytest.approx(sand.sum())
    land = rng.random((15, 15)) < 0.7
    height = rng.random((15, 15))
    to, area = raster.coast_drain(land, height)
    own = np.arange(225).reshape(15, 15)
    assert area[to == own].sum() == (to >= 0).sum() and (to[~land] == -1).all() and not area[to < 0].any()
    down = np.where(to >= 0, to, own)
    for _ in range(225):
        down = down.ravel()[down]
    assert (to.ravel()[down] == down)[to >= 0].all()  # every way ends at the coast
    assert (raster.coast_drain(np.ones((5, 5), bool), np.ones((5, 5)))[0] == -1).all()


def test_drainage_in_tiers():
    rng = np.random.default_rng(3)
    receiver = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, 200)])
    count = np.ones(200)
    for k in range(199, 0, -1):
        count[receiver[k]] += count[k]
    assert (raster.gathered(receiver, 1.0) == count).all() and sorted(np.concatenate(raster.tiers(receiver)).tolist()) == list(range(200))
    h = rng.random((12, 14)) * 50
    cap = raster.capped(h, 0.5, 1.0, np.zeros(h.shape, bool))
    z, x = np.mgrid[0:12, 0:14]
    far = lambda i, j: (np.maximum(abs(z - i), abs(x - j)) - np.minimum(abs(z - i), abs(x - j))) + np.minimum(abs(z - i), abs(x - j)) * math.sqrt(2)
    assert np.allclose(cap, np.min([h[i, j] + 0.5 * far(i, j) for i in range(12) for j in range(14)], axis=0))
    sand = rng.integers(0, 9, (6, 20))
    lee = raster.lee(sand, 1.5)
    for i in range(6):
        for j in range(20):
            assert lee[i, j] == any(sand[i, (j - d) % 20] - 1.5 * d > sand[i, j] for d in range(1, 21))
    heap = np.zeros((16, 16), np.int64)
    heap[8, 8] = 60
    flat = raster.slumped(heap, 2.0, 500)
    assert flat.sum() == 60 and flat.min() >= 0 and np.abs(flat - np.roll(flat, 1, 0)).max() <= 2


def test_distances(spark):
    rng = np.random.default_rng(12)
    for share in (0.02, 0.3, 0.0):
        mask = rng.random((13, 17)) < share
        df = spark.createDataFrame([(x, z, bool(mask[z, x]), bool(z % 5 == 0 and x % 7 == 0)) for z in range(13) for x in range(17)], "x long, z long, land boolean, other boolean")
        square = {(r.x, r.z): r.d2 for r in raster.distance(df).collect()}
        steps = {(r.x, r.z): r.d1 for r in raster.manhattan(df).collect()}
        at = np.argwhere(mask)
        for z in range(13):
            for x in range(17):
                assert square[x, z] == (min((z - a) ** 2 + (x - b) ** 2 for a, b in at) if len(at) else None)
                assert steps[x, z] == (min(abs(z - a) + abs(x - b) for a, b in at) if len(at) else None)
        other = [(z, x) for z in range(0, 13, 5) for x in range(0, 17, 7)]
        assert metrics.min_channel(df, "land", "other").first().steps == (min(abs(z - a) + abs(x - b) for a, b in at for z, x in other) if len(at) else None)


def test_measures(spark):
    h = np.add.outer(np.zeros(20), np.arange(20.0))
    h[5, 9] -= 4
    out = metrics.pits(h, 1.0, 6.0)
    assert out["pits"] == 1 and out["deepest"] == pytest.approx(3, abs=0.01) and out["density"] > 0
    m = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("c", 9.0), ("d", None)], "metric string, value double")
    got = {r.metric: r.ok for r in metrics.accepted(m, [("a", 0.0, None, False), ("b", None, 2.0, False), ("c", None, 2.0, True), ("d", 0.0, 1.0, False)]).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}


def test_rank_picks(spark):
    v = np.random.default_rng(7).integers(0, 30, 101).tolist()
    df = spark.createDataFrame([(x,) for x in v], "v long")
    row = metrics.ranked(df, "v", {"a": 0.0, "b": 0.5, "c": 0.99, "d": 1.0}).first()
    s = sorted(v)
    assert tuple(row) == (s[0], s[int(0.5 * 101)], s[int(0.99 * 101)], s[-1])


def test_iterations_scale_with_spacing():
    assert (Erosion.scaled(24, 2.0), Erosion.scaled(24, 4.0), Erosion.scaled(24, 1.0), Erosion.scaled(1, 16.0)) == (24, 6, 96, 1)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from rasterloom import queries

    c, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("events", "part"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("pw_terrace", "sdf_polygon", "noise_billow", "cells_f2f1", "win_median3", "displace_bilinear", "stat_hypsometry", "flow_receiver_d8"):
        a, b = queries.QUERIES[name](spark, sf).toPandas(), c.execute(queries.SQL[name]).df()
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(float) for x in (a, b))
        assert a.equals(b), name


def test_combine_atan2_at_the_origin():
    assert block({"f": Combine.Atan2(y=Terrain.Const(), x=Terrain.Const())}, (0, 0), (1, 1), 1.0)[0][0, 0] == 0
    assert math.isclose(block({"f": Curves.Power(input=Terrain.Const(value=-4.0), exponent=0.5)}, (0, 0), (1, 1), 1.0)[0][0, 0], -2.0)


def test_curve_tables():
    points = ((0.0, 0.0), (10.0, 5.0), (20.0, 6.0), (40.0, 30.0))
    at = lambda f, x: block({"f": f}, (x, 0), (1, 1), 1.0, 0, np.float64)[0][0, 0]
    straight, smooth = (Curves.Table(Terrain.Coords().x, points, s) for s in (False, True))
    assert at(straight, 5) == pytest.approx(2.5, abs=0.02) and at(straight, -9) == 0 and at(straight, 99) == 30 and at(smooth, 10) == pytest.approx(5, abs=0.05)
    curve = [at(smooth, x) for x in range(41)]
    assert all(a <= b + 1e-9 for a, b in zip(curve, curve[1:], strict=False))
    flat = Curves.Equalize(Terrain.Coords().x, [float(k * k) for k in range(65)])
    assert at(flat, 1024) == pytest.approx(2048, rel=0.02)
    with pytest.raises(PlanError):
        Curves.Table(Terrain.Coords().x, ((0, 0), (0, 1)))


def test_grid_wraps_and_holds():
    values = tuple(float(k) for k in range(12))
    at = lambda f, x, z: block({"f": f}, (x, z), (1, 1), 1.0, 0, np.float64)[0][0, 0]
    hold, wrap = (Terrain.Grid(values=values, size=(4, 3), wrap=w) for w in (False, True))
    assert at(hold, 2, 1) == 6 and at(hold, 99, 1) == 7 and at(wrap, 6, 4) == 6 and at(wrap, -1, 0) == 3


def test_gullies_and_strata(spark):
    h = Noises.fBm(frequency=0.01, octaves=3, amplitude=80)
    g = Erosion.Gullies(input=h, cell=40.0, strength=6.0)
    top, moved, bed = Strata.Apply(h, step=12.0, tilt=5.0, layers=2)
    outputs = {"g": g, "c": g.channels, "t": top, "m": moved, "b": bed, "a": Erosion.Accumulate(h, iterations=4)}
    one, many = (export(spark, outputs, (0, 0), (48, 48), 1.0, s, 5).orderBy("sz", "sx").toPandas() for s in (64, 16))
    assert one.equals(many) and one["c"].between(0, 1).all() and (one["m"] >= 0).all() and one["m"].max() > 0
    base = block({"h": h}, (0, 0), (48, 48), 1.0, 5)[0].ravel()
    assert 0 < np.abs(one["g"].to_numpy() - base).max() <= 6.1


def test_raster_arrays():
    mask = np.zeros((9, 9), bool)
    mask[4, 4] = True
    assert raster.square(mask, 1, [2]).sum() == 25 and (raster.square(mask, 1, [2, -2]) == mask).all()
    v = np.arange(20.0).reshape(4, 5)
    assert raster.resample(v, np.array([1.5, 9.0]), np.array([0.5, 0.0]), -1).tolist() == [4.0, -1.0]
    assert raster.resample(v, np.array([1.6]), np.array([2.4]), nearest=True).tolist() == [12.0]
    assert np.allclose(raster.box3(np.ones((6, 6)), 2), 1) and raster.wetness(np.array([2500.0]), np.array([0.0]), 50.0)[0] == pytest.approx((math.log(50 / 1e-3) - 4) / 10)


def test_hydraulic_rows_match_blocks(spark):
    rng = np.random.default_rng(9)
    a = rng.random((11, 13)) * 40
    df = spark.createDataFrame([(x, z, float(a[z, x])) for z in range(11) for x in range(13)], "x long, z long, v double")
    got = windows.hydraulic(df, 2, rain=1.0).orderBy("z", "x").toPandas()
    for column, expected in zip(("v", "water", "sediment"), stencils.hydraulic(a, 2, rain=1.0), strict=True):
        assert np.allclose(got[column].to_numpy().reshape(11, 13), expected), column


def test_accumulation_counts_what_is_upstream(spark):
    rng = np.random.default_rng(10)
    receiver = [None] + [int(rng.integers(0, k)) for k in range(1, 60)]
    receiver[30:40] = list(range(29, 39))  # a long path
    df = spark.createDataFrame([(k, r) for k, r in enumerate(receiver)], "cell long, receiver long")
    count = [1] * 60
    for k in range(59, 0, -1):
        count[receiver[k]] += count[k]
    assert [tuple(r) for r in raster.accumulate(df).orderBy("cell").collect()] == list(enumerate(count))


def test_drainage():
    bowl = np.full((30, 30), 20.0)
    bowl += np.arange(30)[:, None] * 0.01
    bowl[10:20, 10:20] = 5  # a lake: 100 cells, 15 deep
    bowl[25, 25] -= 1  # breached
    bowl[3, 3] -= 8  # too small for a lake, too deep to breach: filled
    out = raster.drain(bowl, cell=50.0, breach=3.0, lake_area=2e5, lake_depth=2.0, channel_area=20 * 2500.0)
    assert out["lake"].sum() == 100 and (out["lake"][10:20, 10:20]).all() and out["level"][15, 15] == pytest.approx(20.1, abs=0.05) and out["height"][15, 15] == 5
    assert out["height"][25, 25] == bowl[25, 25] and (out["height"] < bowl - 1e-9).any() and out["height"][3, 3] >= bowl[2, 3] - 0.02
    assert out["area"][out["receiver"] < 0].sum() == pytest.approx(900 * 2500) and out["river"].any() and not out["sea"].any()
    shore = np.add.outer(np.zeros(12), np.arange(12.0))
    wet = raster.drain(shore, cell=1.0, sea_level=3.0, channel_area=4.0)
    assert wet["sea"][:, :4].all() and not wet["sea"][:, 4:].any() and wet["receiver"][5, 4] in (5 * 12 + 3,)
    with pytest.raises(ValueError):
        raster.drain(np.ones((5, 5)), edges=False)


def test_lands_join_cut_and_name():
    circle = lambda x, r: Shapes.Circle(radius=r, at=(x, 0.0))
    coast, ident = Lands.Compose([{"shape": circle(0.0, 10.0)}, {"shape": circle(40.0, 10.0), "smooth": 2.0}, {"role": "water", "shape": circle(0.0, 3.0)}])
    at = lambda f, x: block({"f": f}, (x, 0), (1, 1), 1.0, 0, np.float64)[0][0, 0]
    assert at(coast, 0) == 3 and at(coast, 6) == -3 and at(coast, 40) == -10 and [at(ident, x) for x in (0, 19, 21, 60)] == [1, 1, 2, 2]
    some = Lands.Scatter(12, (0.0, 0.0, 300.0, 200.0), (5.0, 20.0), seed=4)
    assert len(some) == 12 and (block({"c": Lands.Compose(some)[0]}, (0, 0), (300, 200), 1.0)[0] < 0).any()
    with pytest.raises(PlanError):
        Lands.Compose([{"role": "water", "shape": circle(0.0, 1.0)}])


def test_hillshade_and_spectrum():
    wall = np.zeros((20, 30))
    wall[:, 15] = 10
    east, west = (raster.hillshade(wall, 1.0, a, 45.0) for a in (90.0, 270.0))
    assert (east[:, 6:13] == 0).all() and (east[:, 18:] > 0).all() and (west[:, 18:24] == 0).all() and np.allclose(east[:, :4], math.sin(math.pi / 4))
    assert (raster.hillshade(wall.T, 1.0, 0.0)[17:24] == 0).all() and (raster.hillshade(wall.T, 1.0, 180.0)[6:13] == 0).all()
    rng = np.random.default_rng(11)
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(128), np.fft.fftfreq(128)))
    f[0, 0] = 1
    h = np.fft.ifft2(np.fft.fft2(rng.normal(size=(128, 128))) / f**1.5).real
    assert raster.spectrum(h)[2] == pytest.approx(-3, abs=0.35)


def test_sampling_reads_through():
    from rasterloom.plans.sample import sample, sample_grid

    h = Noises.fBm(frequency=0.03, octaves=3, amplitude=20)
    x, z = np.array([3.0, 10.5, 40.0]), np.array([7.0, -2.25, 11.0])
    plain = sample(h, x, z, seed=5)
    assert np.allclose(sample(Filters.Blur(input=Erosion.Thermal(input=h), radius=4), x, z, seed=5), plain) and not sample(Erosion.Thermal(input=h).talus, x, z).any()
    moved = Filters.Displace(input=h, by=Vec.Combine(Terrain.Const(value=2.0), h * 0.1))
    assert np.allclose(sample(moved, x, z, seed=5), sample(h, x + 2, z + plain * 0.1, seed=5))
    g = sample(Terrain.Gradient(input=h * 2), x, z, 0.5, 5)
    assert np.allclose(g[:, 0], sample(h, x + 0.5, z, seed=5) * 2 - sample(h, x - 0.5, z, seed=5) * 2)
    assert np.allclose(sample_grid(h, (0, 0), (8, 6), 1.0, 5), block({"h": h}, (0, 0), (8, 6), 1.0, 5, np.float64)[0])
    mixed = Combine.Blend(a=h, b=Vec.Combine(h, h).z * 3, mask=h.gradient.x)
    assert sample(mixed, x, z, seed=5)[0] == pytest.approx(block({"f": mixed}, (3, 7), (1, 1), 1.0, 5, np.float64)[0][0, 0])


def test_composed_erosion():
    h = Noises.fBm(frequency=0.02, octaves=3, amplitude=40, offset=10)
    base = block({"h": h}, (0, 0), (40, 40), 1.0, 2, np.float64)[0]
    at = lambda f: block({"f": f}, (0, 0), (40, 40), 1.0, 2, np.float64)[0]
    surface, depth = Erosion.Snow(h, snowfall=3.0, iterations=8)
    assert (at(depth) >= 0).all() and np.allclose(at(surface), base + at(depth)) and 0 < at(depth).mean() < 6
    none, _ = Erosion.Snow(h, line=1000.0, iterations=2, stickiness=50.0)
    assert np.allclose(at(none), base)
    shore, beach, cliff = Erosion.Coastal(h, level=10.0, beach=4.0, flatness=0.25)
    near = abs(base - 10) < 4
    assert np.allclose(at(shore)[near], 10 + (base - 10)[near] * 0.25) and at(beach)[abs(base - 10) > 4].max() == 0 and not at(cliff).any()
    worn, talus = Erosion.Weathering(h, fracture=8.0, boulders=4.0, iterations=6)
    assert (at(talus) >= -1e-9).all() and np.isfinite(at(worn)).all()
    carved, cut = Erosion.Multiscale(h * 3, (0.0, 0.0, 400.0, 300.0), cell=25.0, iterations=10, detail=0)
    assert block({"c": cut}, (0, 0), (400, 300), 1.0, 2)[0].min() < 0 and block({"c": cut}, (500, 0), (5, 5), 1.0, 2)[0].max() == 0
    like = Terrain.Mimic(h, h * 2 + 5, (0.0, 0.0, 640.0, 640.0), roughness=0.0, seed=2)
    assert np.allclose(at(like), base * 2 + 5, rtol=1e-6)


def test_fields_around_curves(spark):
    from rasterloom.operators import curves

    rng = np.random.default_rng(4)
    points = [(c, i, float(x), float(z), float(10 - i), 1.0 + i) for c in (1, 2) for i, (x, z) in enumerate(rng.random((5, 2)) * 30)]
    df = spark.createDataFrame(points, "curve int, i int, x double, z double, level double, half_width double")
    cells = spark.createDataFrame([(x, z) for z in range(30) for x in range(30)], "x long, z long")
    got = {(r.x, r.z): r for r in curves.curve_field(cells, df, 5.0, 4.0).collect()}
    for x in range(30):
        for z in range(30):
            best = None
            for p, q in zip(points, points[1:], strict=False):
                if p[0] == q[0]:
                    d = np.subtract(q[2:4], p[2:4])
                    t = min(max(np.dot(np.subtract((x, z), p[2:4]), d) / np.dot(d, d), 0), 1)
                    away = float(((np.subtract((x, z), p[2:4]) - t * d) ** 2).sum())
                    best = min(best, (away, p[0], p[1], p[4] + (q[4] - p[4]) * t)) if best else (away, p[0], p[1], p[4] + (q[4] - p[4]) * t)
            if best[0] <= 25 - 1e-9:
                r = got[x, z]
                assert r.curve == best[1] and r.d2 == pytest.approx(best[0]) and r.level == pytest.approx(best[3])
            elif best[0] > 25 + 1e-9:
                assert (x, z) not in got


def frames_to_the_end(df) -> int:
    """How many window frames run from a row to the end of its partition: Spark reads those anew for each row, in the square of the partition."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("currentrow$(), unboundedfollowing$()")


def test_distance_down_tall_columns(spark):
    df = spark.range(12000).select((F.col("id") % 3).alias("x"), F.floor(F.col("id") / 3).alias("z"), F.col("id").isin(1500, 1507, 7001).alias("land"))
    out = raster.distance(df)
    assert not frames_to_the_end(out)
    at = [(i // 3, i % 3) for i in (1500, 1507, 7001)]
    assert all(r.d2 == min((r.z - a) ** 2 + (r.x - b) ** 2 for a, b in at) for r in out.collect())


def test_steps_down_tall_columns(spark):
    df = spark.range(12000).select((F.col("id") % 3).alias("x"), F.floor(F.col("id") / 3).alias("z"), F.col("id").isin(1500, 1507, 7001).alias("land"))
    out = raster.manhattan(df)
    assert not frames_to_the_end(out)
    at = [(i // 3, i % 3) for i in (1500, 1507, 7001)]
    assert all(r.d1 == min(abs(r.z - a) + abs(r.x - b) for a, b in at) for r in out.collect())


def query_and_sql(spark, folder, name: str, value: str, rows: int = 40) -> list[list[tuple]]:
    """The sorted rows of a query and of its SQL over an event raster whose value is an SQL expression of event_id."""
    import duckdb

    from rasterloom import queries

    file = f"{folder}/events.parquet"
    duckdb.sql(f"SELECT range AS event_id, CAST({value} AS DOUBLE) AS value FROM range({rows * 100})").write_parquet(file)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{file}'")
    sql = con.sql(queries.SQL[name])
    return [sorted(map(tuple, queries.QUERIES[name](spark, str(folder)).select(*sql.columns).collect())), sorted(sql.fetchall())]


def test_aspect_where_the_gradient_has_zeros(spark, tmp_path):
    """Plateaus and slopes along the axes: most cells have a zero in their gradient."""
    got, sql = query_and_sql(spark, tmp_path, "win_aspect", "hash(event_id) % 3")
    assert got == sql and {-3.141593, 0.0, 1.570796, -1.570796} < {r[2] for r in sql}


def test_radius_maps_scale_the_window(spark, tmp_path):
    """A map of 1 is the whole window, one of 0 the sample itself, between them a window of the same shape."""
    a = np.random.default_rng(9).random((20, 20))
    for shape in ("square", "diamond", "octagon", "disk"):
        for f in (stencils.expand, stencils.shrink):
            for share, radius in ((0.0, 0), (0.5, 2), (1.0, 4), (3.0, 4)):
                assert (f(a, 4, shape, reach=np.full(a.shape, share)) == (f(a, radius, shape) if radius else a)).all()
    got, sql = query_and_sql(spark, tmp_path, "win_expand_map", "hash(event_id) % 600")
    assert got == sql


def test_tiles_of_tables_match_blocks(spark):
    """However a table is cut, a plan gives what it gives over the whole array; gaps are an error."""
    from rasterloom.plans.tables import over_raster

    rng = np.random.default_rng(8)
    a = rng.random((37, 45)) * 30
    df = spark.createDataFrame([(x, z, float(a[z, x])) for z in range(37) for x in range(45)], "x long, z long, v double")
    v = Terrain.Column("v")
    plan = {"t": Erosion.Thermal(input=v, iterations=5, talus=2.0, two_phase=True), "m": Filters.Expand(input=v, radius=2, shape="octagon"), "s": Strata.Apply(v, step=5.0, smoothness=2)[0]}
    one, many = (over_raster(df, plan, section=s).orderBy("z", "x").toPandas() for s in (64, 1))
    assert np.allclose(one, many) and np.allclose(one["t"].to_numpy().reshape(37, 45), stencils.thermal(a, 5, talus=2.0, two_phase=True)[0]) and np.allclose(one["m"].to_numpy().reshape(37, 45), stencils.expand(a, 2, "octagon"))
    with pytest.raises(Exception, match="gaps"):
        over_raster(df.where("not (x = 7 and z = 7)"), plan).count()
