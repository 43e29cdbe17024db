"""Hand-computed values and properties of the catalog and raster operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicat.functions import curves, formulas, photo, whitebalance
from lumicat.operators import catalog, demosaic, detail, edits, exposure, geometry, histogram, match, mosaics, tiles, window


def values(spark, expressions: dict[str, str]) -> dict:
    return spark.range(1).select(*[F.expr(e).alias(k) for k, e in expressions.items()]).first().asDict()


def line(spark, numbers, name="v"):
    return spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(numbers)], f"frame long, y long, x long, {name} double")


def raster(spark, a):
    return spark.createDataFrame([(0, y, x, float(a[y][x])) for y in range(len(a)) for x in range(len(a[0]))], "frame long, y long, x long, v double")


def grid(df, c, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[c]
    return out


@pytest.mark.parametrize("rgb, hsv", [((65535, 0, 0), (0, 1, 1)), ((0, 65535, 0), (1 / 3, 1, 1)), ((10000, 20000, 40000), (0.611111, 0.75, 0.610361)), ((30000, 30000, 30000), (0, 0, 0.457771)), ((40000, 10000, 20000), (0.944444, 0.75, 0.610361))])
def test_hsv(spark, rgb, hsv):
    got = values(spark, dict(zip("hsv", formulas.hsv(*map(formulas.num, rgb)), strict=True)))
    assert all(abs(got[k] - v) < 1e-5 for k, v in zip("hsv", hsv, strict=True))


def test_color_round_trips(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, r)) for r in rng.integers(1, 65535, (300, 3))]
    df = spark.createDataFrame(rows, "r double, g double, b double")

    def close(columns, tolerance):
        names = list("rgb")
        out = df.select(*names, *[F.expr(e).alias(f"o{i}") for i, e in enumerate(columns)]).toPandas()
        assert np.allclose(out[names].to_numpy(), out[["o0", "o1", "o2"]].to_numpy(), rtol=tolerance, atol=tolerance * 65535)

    close(formulas.rgb_from_hsv(*formulas.hsv("r", "g", "b")), 1e-9)
    close(formulas.rgb_from_hsl(*formulas.hsl("r", "g", "b")), 1e-9)
    close(formulas.xyz_from_lab(*formulas.lab_from_xyz("r", "g", "b")), 1e-9)
    close(formulas.xyz_from_oklab(*formulas.oklab_from_xyz("r", "g", "b")), 1e-5)
    close(formulas.matrix3(formulas.inverse3(formulas.XYZ_FROM_SRGB), *formulas.matrix3(formulas.XYZ_FROM_SRGB, "r", "g", "b")), 1e-9)


def test_transfer_curves(spark):
    got = values(spark, {"pq1": formulas.pq("1e0"), "pq10": formulas.pq("10e0"), "back": formulas.pq_inverse(formulas.pq("3e0")), "hlg": formulas.hlg_inverse(formulas.hlg("4e0")), "aces": formulas.acescct_inverse(formulas.acescct("5e-1"))})
    assert abs(got["pq1"] - 0.508078) < 1e-6 and abs(got["pq10"] - 0.751827) < 1e-6
    assert abs(got["back"] - 3) < 1e-9 and abs(got["hlg"] - 4) < 1e-6 and abs(got["aces"] - 0.5) < 1e-9
    for kind in formulas.GAMMAS:
        g = values(spark, {"x": formulas.gamma_inverse(formulas.gamma("3e-1", kind), kind)})
        assert abs(g["x"] - 0.3) < 1e-6


def test_singular_matrix():
    with pytest.raises(ValueError):
        formulas.inverse3(((1, 2, 3), (2, 4, 6), (0, 0, 1)))


def test_shutter_text(spark):
    df = spark.createDataFrame([(x,) for x in (0.004, 0.5, 0.4, 0.6, 1.0, 2.5, 2.25, 30.0, 0.0)], "s double")
    got = df.select(photo.shutter_text("s").alias("t"), photo.shutter_seconds(photo.shutter_text("s")).alias("b")).collect()
    assert [r.t for r in got] == ["1/250", "1/2", "1/2", "0.6", "1", "2.5", "2.2", "30", "0"]
    assert [r.b for r in got][:3] == [0.004, 0.5, 0.5]
    bad = spark.createDataFrame([("1/0",), ("x",), ("",), ("3",)], "t string").select(photo.shutter_seconds("t").alias("s")).collect()
    assert [r.s for r in bad] == [0.0, 0.0, 0.0, 3.0]


def test_paths(spark):
    df = spark.createDataFrame([("/a.b/c.NEF",), ("/a.b/c",), ("x.y z",), ("p/.hid",)], "p string")
    got = df.select(photo.extension("p").alias("e"), photo.without_extension("p").alias("s"), photo.file_type("p").alias("t")).collect()
    assert [tuple(r) for r in got] == [("NEF", "/a.b/c", "nef"), ("", "/a.b/c", "b/c"), ("", "x.y z", "y z"), ("hid", "p/", "hid")]


def test_dark_frames(spark):
    darks = spark.createDataFrame([("d1", "m", "x", 100, 0.01, 0), ("d2", "m", "x", 100, 0.01, 5000), ("d3", "m", "x", 400, 0.02, 0), ("d4", "m", "x", 1600, 0.5, 0)], "frame_id string, make string, model string, iso int, shutter double, ts long")
    probes = spark.createDataFrame([(1, "m", "x", 100, 0.01, 2400), (2, "m", "x", 100, 0.01, 2600), (3, "M", "X", 200, 0.02, 0), (4, "m", "other", 100, 0.01, 0)], "shot_id int, make string, model string, iso int, shutter double, ts long")
    got = {r.shot_id: (r.frame_id, r.distance) for r in match.dark_frames(probes, darks).collect()}
    assert got == {1: ("d1", 0.0), 2: ("d2", 0.0), 3: ("d3", 1.0), 4: (None, None)}


def test_nearest_level(spark):
    levels = spark.createDataFrame([("c", i) for i in (100, 200, 400, 800)], "camera string, level_iso int")
    probes = spark.createDataFrame([(i, "c", i) for i in (0, 50, 150, 300, 600, 5000)], "shot_id int, camera string, iso int")
    got = {r.shot_id: r.level_iso for r in match.nearest_level(probes, levels, "camera").collect()}
    assert got == {0: 100, 50: 100, 150: 200, 300: 400, 600: 800, 5000: 800}


def test_calibration_groups(spark):
    df = spark.createDataFrame([("k", t) for t in (0, 3600 * 5, 3600 * 7, 3600 * 12, 3600 * 20)], "key string, ts long")
    got = [r.group_start // 3600 for r in match.calibration_groups(df, ["key"]).orderBy("ts").collect()]
    assert got == [0, 0, 7, 7, 20]


def test_box_blur(spark):
    for r, want in ((1, [1.5, 2, 3, 5.666667, 7]), (2, [2, 2.5, 4, 4.75, 5.666667])):
        got = window.box_blur(line(spark, [1, 2, 3, 4, 10]), {"o": "v"}, r).orderBy("x").collect()
        assert np.allclose([x.o for x in got], want, atol=1e-5)


def test_percentiles(spark):
    got = histogram.percentile(line(spark, range(10)), "v", {"a": 0.05, "b": 0.5, "c": 0.95}).first()
    assert np.allclose([got.a, got.b, got.c], [0.5, 5, 9])
    assert abs(histogram.percentile(line(spark, [1, 1, 2, 10]), "v", {"a": 0.5}).first().a - 3) < 1e-6
    assert histogram.percentile(line(spark, [4, 4]), "v", {"a": 0.5}).first().a == 4


def test_mad(spark):
    for numbers, want in (([-3, 1, 2.9, -5, 8, 0], 4.447739), ([2, 2, 2, 2], 3.706449)):
        assert abs(histogram.mad(line(spark, numbers), F.col("v"), 32768).first().mad - want) < 1e-5


def test_lookup(spark):
    at = [0.5, 1.5, -1.0, 5.0]
    df = spark.createDataFrame([(x,) for x in at], "x double")
    clipped = [r.o for r in df.select(curves.lookup([0, 10, 30], F.col("x")).alias("o")).collect()]
    free = [r.o for r in df.select(curves.lookup([0, 10, 30], F.col("x"), False, False).alias("o")).collect()]
    assert clipped == [5, 20, 0, 30] and free == [5, 20, -10, 90]


def test_lanczos(spark):
    got = geometry._resample(line(spark, range(0, 80, 10)), ["v"], "x", geometry.lanczos_taps(8, 4)).orderBy("x").collect()
    assert np.allclose([r.v for r in got], [5.060359, 24.493432, 45.506568, 64.939641], atol=1e-5)
    same = geometry._resample(line(spark, [7] * 5), ["v"], "x", geometry.lanczos_taps(5, 10)).collect()
    assert all(abs(r.v - 7) < 1e-9 for r in same)


def test_green_equalize(spark):
    df = spark.createDataFrame([(0, y, x, 100.0 if y == 0 else 110.0) for y in (0, 1) for x in (0, 1)], "frame long, y long, x long, v double")
    out = histogram.equalize_groups(df, "v", F.col("y") == 0, F.lit(True)).collect()
    assert {r.y: round(r.v, 6) for r in out} == {0: 105.0, 1: 105.0}


def test_history(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(["exp", "exp", "wb", "exp", "exp"])], "image long, seq long, event string")
    assert [r.seq for r in edits.collapse_history(df).orderBy("seq").collect()] == [1, 2, 4]


def test_names_and_queue(spark):
    names = spark.createDataFrame([(i, "a.jpg") for i in range(3)], "i int, name string")
    assert [r.unique_name for r in catalog.unique_names(names, "name", "i").orderBy("i").collect()] == ["a.jpg", "a-1.jpg", "a-2.jpg"]
    many = spark.range(101).select("id", F.lit("a.jpg").alias("name"))
    assert catalog.unique_names(many, "name", "id").where("unique_name is null").count() == 1
    q = spark.createDataFrame([("P", 0, True), ("q1", 1, False)], "entry string, seq long, processing boolean")
    new = spark.createDataFrame([("a", 0, False), ("b", 1, False)], "entry string, seq long, processing boolean")
    assert [r.entry for r in catalog.add_entries(q, new, head=True).orderBy("seq").collect()] == ["P", "b", "a", "q1"]
    assert [r.entry for r in catalog.add_entries(q, new).orderBy("seq").collect()] == ["P", "q1", "a", "b"]


def test_name_filter(spark):
    df = spark.createDataFrame([("xdef.nef",), ("abc.jpg",), ("zzz.nef",)], "file string")
    keep = lambda names: [r.file for r in df.where(catalog.name_predicate(F.col("file"), names)).collect()]
    assert keep("!=abc,DEF,") == ["zzz.nef"] and keep("abc,DEF,") == ["xdef.nef", "abc.jpg"] and len(keep(",")) == 3


def test_text_rules(spark):
    df = spark.createDataFrame([("re:^nikon", "NIKON D70", True), ("Nikon d70", "NIKON D70", True), ("x", "y", False), ("x", "y", True)], "w string, v string, e boolean")
    assert [r.m for r in df.select(photo.text_match(F.col("w"), F.col("v"), F.col("e")).alias("m")).collect()] == [True, True, True, False]


def test_originals(spark):
    rows = [(1, "/a/x.nef", "/a"), (2, "/a/X.jpg", "/a"), (3, "/a/y.tmp", "/a"), (4, "/a/y.jpg", "/a"), (5, "/b/x.jpg", "/b")]
    df = spark.createDataFrame(rows, "shot_id int, file string, folder string")
    got = {r.shot_id: r.original_id for r in catalog.mark_originals(df, ["jpg", "nef"]).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 3, 5: 5}


def test_renames_and_moves(spark):
    df = spark.createDataFrame([(1, "/a/x.nef"), (2, "/a/y.nef"), (3, "/b/x.nef")], "shot_id int, file string")
    names = spark.createDataFrame([(1, "z"), (2, "x.nef"), (3, "q/w.nef")], "shot_id int, new_name string")
    got = {r.shot_id: (r.file, r.renamed) for r in catalog.rename(df, names).collect()}
    assert got == {1: ("/a/z.nef", True), 2: ("/a/y.nef", False), 3: ("/b/x.nef", False)}
    moved = {r.shot_id: r.file for r in catalog.copy_or_move(df, df.where("shot_id = 3"), "/a", True).collect()}
    assert moved == {1: "/a/x.nef", 2: "/a/y.nef", 3: "/a/x-1.nef"}
    assert catalog.copy_or_move(df, df.where("shot_id = 3"), "/a", False).count() == 4


def test_geometry_is_reversible(spark):
    a = np.arange(12).reshape(3, 4)
    df = raster(spark, a)
    once = geometry.rotate(df, 4, 3, 90)
    assert (grid(once, "v", 4, 3) == np.rot90(a, -1)).all()
    back = geometry.rotate(geometry.rotate(geometry.rotate(once, 3, 4, 90), 4, 3, 90), 3, 4, 90)
    assert (grid(back, "v", 3, 4) == a).all()
    assert (grid(geometry.flip(geometry.flip(df, 4, 3, True), 4, 3, True), "v", 3, 4) == a).all()


def test_resize_solver_and_tiles():
    assert geometry.resize_scale("fit", 200, 100, box=(100, 25)) == 0.25
    assert geometry.resize_scale("scale", 10, 10, 1.000001) == 1.0
    t = geometry.tiles(1024, 128, 3000, 800)
    assert t["tiles_x"] == 4 and t["tile_width"] % 2 == 0 and t["skip_x"] == t["tile_width"] - 128 and t["tiles_y"] == 1


def test_spot_dependencies():
    spots = [{"source": (0, 0, 5), "target": (50, 50, 5)}, {"source": (52, 50, 5), "target": (90, 90, 5)}, {"source": (91, 90, 4), "target": (10, 90, 4)}, {"source": (200, 0, 3), "target": (300, 0, 3)}]
    assert geometry.spot_dependencies(spots, {2}) == {0, 1, 2}
    assert geometry.spot_dependencies(spots, {3}) == {3}


def test_demosaic_of_a_constant(spark):
    df = raster(spark, np.full((6, 6), 9.0)).withColumn("c", demosaic.rggb(F.col("x"), F.col("y")))
    out = demosaic.bilinear(df, "v").collect()
    assert len(out) == 36 and all((r.r, r.g, r.b) == (9, 9, 9) for r in out)
    assert demosaic.half_size(df, "v").count() == 9


def test_hot_pixel_is_found(spark):
    a = np.full((15, 15), 100.0) + np.arange(225).reshape(15, 15) % 3
    a[7, 8] = 5000
    got = window.hot_pixels(raster(spark, a), "v", 20.0).where("bad").collect()
    assert [(r.y, r.x) for r in got] == [(7, 8)]


def test_gaussian_and_guided_filters_keep_constants(spark):
    df = raster(spark, np.full((9, 9), 4.0))
    assert all(abs(r.o - 4) < 1e-9 for r in window.gaussian_blur(df, {"o": "v"}, 1.2).collect())
    assert all(abs(r.o - 4) < 1e-9 for r in window.guided_filter(df, "v", "v", "o", 2, 0.1).collect())


def test_tiles_equal_the_whole_frame(spark):
    a = np.random.default_rng(0).normal(100, 20, (70, 50))
    whole = tiles.gaussian(a, 2.0)
    got = tiles.apply_kernel(raster(spark, a), ["v"], lambda v: {"o": tiles.gaussian(v, 2.0)}, ["o"], size=32, halo=8)
    assert got.count() == a.size and np.allclose(grid(got, "o", 70, 50), whole)


def test_kernels():
    rng = np.random.default_rng(1)
    a = rng.uniform(50, 200, (40, 40))
    details, rest = tiles.a_trous(a, 4)
    assert np.allclose(sum(details) + rest, a)
    assert np.allclose(tiles.recursive_gaussian(np.full((20, 20), 3.0), 4.0), 3.0)
    assert np.allclose(tiles.bilateral(np.full((9, 9), 3.0), 1.5, 10.0), 3.0)
    blurred = tiles.gaussian(a, 1.0)
    assert np.abs(tiles.richardson_lucy(blurred, 1.0, 20) - a)[5:-5, 5:-5].mean() < np.abs(blurred - a)[5:-5, 5:-5].mean()
    n = tiles.grain((30, 30), 0, 0, 1.0, 4.0)
    assert np.allclose(n[10:20, 5:25], tiles.grain((10, 20), 10, 5, 1.0, 4.0)) and n.std() > 0.1
    hole = a.copy()
    hole[10:14, 10:14] = 9999
    assert tiles.inpaint(hole, hole == 9999).max() < 250
    deep = np.full((140, 150), 9999.0)
    deep[0, 0] = 7.0
    assert (tiles.inpaint(deep, deep == 9999) == 7).all()
    assert (tiles.inpaint(deep, deep > 0) == deep).all()
    assert np.allclose(tiles.false_color(a, a, a)[1], a)


def test_detail_kernels():
    from lumicat.operators import detail

    rng = np.random.default_rng(4)
    a = rng.uniform(50, 200, (48, 48))
    assert np.allclose(detail.pyramid_equalizer(a, [1.0, 1.0, 1.0]), a)
    assert detail.pyramid_equalizer(a, [2.0]).std() > a.std()
    flat = np.full((20, 20), 7.0)
    for f in (lambda v: detail.edge_sharpen(v, 0.5, 2), lambda v: detail.micro_contrast(v, 0.5, 1.0)):
        assert np.allclose(f(flat), flat)
    y, x = np.indices((64, 64), dtype=float)
    clean = 100 + 20 * np.sin(y / 7) * np.cos(x / 9)
    assert np.allclose(detail.resample(clean, lambda yy, xx: (yy, xx)), clean)
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[3:6, 3:6] = False
    assert detail.flood_mask(ring).sum() == 25
    k = detail.radial_shift(0.1, 4, 4, 4)(np.array([4.0]), np.array([8.0]))
    assert np.allclose(k, ([4.0], [8.4]))


def test_demosaic_methods(spark):
    df = raster(spark, np.full((12, 12), 9.0)).withColumn("c", demosaic.rggb(F.col("x"), F.col("y")))
    from lumicat.operators import mosaics

    y, x = np.indices((40, 40), dtype=float)
    truth = np.stack((120 + 60 * np.sin(y / 6), 130 + 50 * np.sin((x + y) / 7), 110 + 40 * np.cos(x / 5)), 2)
    red, green, blue = mosaics._places((40, 40))
    mosaic = np.where(red, truth[..., 0], np.where(green, truth[..., 1], truth[..., 2]))
    for f in mosaics.METHODS.values():
        out = np.stack(f(mosaic), 2)
        assert np.abs(out - truth)[6:-6, 6:-6].mean() < 5
        assert np.allclose(out[..., 1][green], mosaic[green]) and np.allclose(out[..., 0][red], mosaic[red])
    for method in ("bilinear", "mono", "half", "dual", *mosaics.METHODS):
        rows = demosaic.demosaic(df, "v", method).collect()
        assert rows and all(abs(r.r - 9) < 1e-9 and abs(r.g - 9) < 1e-9 and abs(r.b - 9) < 1e-9 for r in rows)
    with pytest.raises(ValueError):
        demosaic.demosaic(df, "v", "unknown")


def test_curves(spark):
    pts = [(0, 0), (0.25, 0.4), (0.75, 0.6), (1, 1)]
    for make in (curves.linear, curves.spline, curves.catmull_rom):
        c = make(pts)
        assert all(abs(c(x) - y) < 1e-6 for x, y in pts) and c(-1) == 0 and c(2) == 1
    assert curves.in_gamma(curves.linear([(0, 0), (1, 1)])) == []
    assert curves.flat([])(0.3) == 0.5 and abs(curves.flat([(0.25, 0.0), (0.75, 1.0)])(0.0) - 0.5) < 1e-9
    assert curves.parametric(0, 0, 0, 0)(0.4) == 0.4
    table = curves.exposure_table(0, 0, 0, 0, 0, 0, 0.5)
    assert np.allclose(table, np.linspace(0, 1, 256))
    df = spark.createDataFrame([(0.2, 0.5, 0.9)], "r double, g double, b double")
    out = df.select(*curves.film_like(F.col("r"), F.col("g"), F.col("b"), [0.0, 0.5, 1.0])).first()
    assert np.allclose(tuple(out), (0.2, 0.5, 0.9))
    cube = [(r / 2, g / 2, b / 2) for b in range(3) for g in range(3) for r in range(3)]
    assert np.allclose(tuple(df.select(*curves.cube_lookup(F.col("r"), F.col("g"), F.col("b"), cube, 3)).first()), (0.2, 0.5, 0.9))


def test_temperatures():
    for t in (2500, 4500, 6500, 12000):
        m = whitebalance.multipliers(t, 1.1)
        back, green = whitebalance.temperature_of(*m)
        assert abs(back - t) < 2 and abs(green - 1.1) < 1e-3
    assert whitebalance.multipliers(3000)[2] > whitebalance.multipliers(9000)[2]
    x, y, z = whitebalance.white(6504)
    assert abs(x - 0.9505) < 0.01 and abs(z - 1.089) < 0.02


def test_auto_exposure(spark):
    dark = {b: 1000 - b for b in range(20, 400)}
    bright = {b: 10 + b % 7 for b in range(1000, 8000)}
    flat = {500: 100}
    rows = [(f, b, n) for f, h in enumerate((dark, bright, flat, {})) for b, n in h.items()]
    hist = spark.createDataFrame(rows, "frame long, bin long, n long")
    got = {r.frame: r for r in exposure.auto_exposure(hist, 3, 0.02).collect()}
    assert got[0].expcomp > max(1, got[1].expcomp) and 0 <= got[0].contr <= 100 and -100 <= got[0].bright <= 100
    assert got[2].asDict() == {"frame": 2, "expcomp": 0.0, "bright": 0, "contr": 0, "black": 0, "hlcompr": 0, "hlcomprthresh": 0}
    assert 3 not in got and exposure.auto_exposure(hist.limit(0), 3, 0.02).count() == 0
    # the order statistics against the sorted values
    stats = {r.frame: r for r in exposure.levels(hist, 0.02, 8192, "frame").collect()}
    for f, h in ((0, dark), (1, bright)):
        v = np.repeat(list(h), list(h.values()))
        # each level fills up anew behind the one before
        want, held = [], 0
        for b in sorted(h):
            held += h[b]
            if len(want) < 8 and held > len(v) * exposure.LEVELS[len(want)]:
                want.append(math.log2(1 + b))
                held = 0
        assert stats[f].level == pytest.approx([*want, held, *[0.0] * 8][:8])
        allowed = len(v) * 0.02 // 100
        assert (stats[f].black, stats[f].white) == (v[int(allowed)], v[-1 - int(allowed)])


def test_histograms_keep_their_mass(spark):
    a = np.random.default_rng(2).integers(0, 65535, (20, 30))
    df = raster(spark, a)
    h = histogram.histogram(df, {"v": F.col("v")})
    assert h.agg(F.sum("n")).first()[0] == a.size
    assert histogram.rebin(h, 8).agg(F.sum("n")).first()[0] == a.size
    assert histogram.cumulative(h).agg(F.max("cum")).first()[0] == a.size
    m = histogram.median_bin(h).first().median
    assert m == int(np.sort(a.ravel())[a.size // 2 - 1])


def test_white_level_scale(spark):
    df = spark.createDataFrame([(1.4,), (2.0,), (3.3,), (9.0,)], "f double")
    got = [r.w for r in df.select(match.white_level(F.lit(1000.0), F.col("f"), {1.4: 1.2, 2.0: 1.1, 4.0: 1.05}, F.lit(1150.0)).alias("w")).collect()]
    assert np.allclose(got, [1150, 1100, 1050, 1000])


def test_undo_redo():
    assert [edits.undo_position(p, 5) for p in (4, 0, -1)] == [3, 0, 3]
    assert [edits.redo_position(p, 5) for p in (3, 4, -1)] == [4, 4, 3]
    assert math.isfinite(1.0)


LOCAL = {
    "bilateral": (lambda a: tiles.bilateral(a, 1.5, 8000.0), 4),
    "false colour": (lambda a: tiles.false_color(a, a * 0.7 + 1000, a * 0.5, 2)[0], 4),
    "edge sharpening": (lambda a: detail.micro_contrast(detail.edge_sharpen(a, 0.2, 2), 0.3, 1.0), 4),
    "gaussian": (lambda a: tiles.gaussian(a, 1.2), 4),
    "pyramid": (lambda a: detail.pyramid_equalizer(a, [1.3, 1.1], 500.0), 6),
    **{f"{n} mosaic": (lambda a, f=f: f(a)[0] + 3 * f(a)[2], 14) for n, f in mosaics.METHODS.items()},
}


@pytest.mark.parametrize("name", LOCAL)
def test_local_kernels_leave_no_seams(spark, name):
    """Several tiles with a halo give what the whole frame gives."""
    kernel, halo = LOCAL[name]
    a = np.random.default_rng(5).integers(0, 65535, (50, 60)).astype(float)
    rows = tiles.apply_kernel(raster(spark, a), ["v"], lambda v: {"o": kernel(v)}, ["o"], 16, halo, 2)
    assert np.allclose(grid(rows, "o", 50, 60), kernel(a), rtol=1e-9, atol=1e-6)


def test_kernels_of_mosaics_keep_their_colours(spark):
    a = np.random.default_rng(6).integers(0, 65535, (40, 44)).astype(float)
    f = mosaics.METHODS["adaptive"]
    rows = tiles.apply_kernel(raster(spark, a), ["v"], lambda v: {"o": f(v)[0]}, ["o"], 10, 7, 2)  # an odd halo is widened
    assert np.allclose(grid(rows, "o", 40, 44), f(a)[0])
    with pytest.raises(ValueError, match="period"):
        tiles.apply_kernel(raster(spark, a), ["v"], lambda v: {"o": v}, ["o"], 9, 4, 2)


def test_weighted_triangle_moves_towards_the_ends(spark):
    curve = [0.0, 0.7, 1.0]  # 0.5 -> 0.7
    df = spark.createDataFrame([(0.5, 0.25, 0.75)], "r double, g double, b double")
    got = df.select(*curves.weighted_triangle(F.col("r"), F.col("g"), F.col("b"), curve)).first()
    at = {0.5: 0.7, 0.25: 0.35, 0.75: 0.85}

    def moved(a, b):
        return b + (at[a] - a) * (b / a if b < a else (1 - b) / (1 - a))

    for c, value in zip((0.5, 0.25, 0.75), got, strict=True):
        assert value == pytest.approx(0.5 * at[c] + 0.25 * sum(moved(a, c) for a in at if a != c))
    white = spark.createDataFrame([(1.0, 1.0, 0.5)], "r double, g double, b double")
    assert all(v <= 1 for v in white.select(*curves.weighted_triangle(F.col("r"), F.col("g"), F.col("b"), curve)).first())
