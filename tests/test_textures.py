"""Six-by-six mosaics and textures near the sampling limit: exactness, seams, and how near they come to what was sampled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicat.operators import demosaic as D
from lumicat.operators import mosaics as M
from lumicat.operators import textures as X
from lumicat.operators.tiles import apply_kernel


def quality(made, scene, margin=8):
    d = np.stack(made)[:, margin:-margin, margin:-margin] - np.stack(scene)[:, margin:-margin, margin:-margin]
    return 10 * np.log10(65535**2 / np.mean(d * d))


def scene(size=120, seed=0):
    """Edges of all directions and softness, stripes, and slowly changing hue."""
    y, x = np.mgrid[0:size, 0:size].astype(float)
    r = np.random.default_rng(seed)
    light = np.zeros((size, size))
    for _ in range(25):
        a = r.uniform(0, np.pi)
        light += r.uniform(-1, 1) / (1 + np.exp(-(np.cos(a) * x + np.sin(a) * y - r.uniform(-60, 200)) / r.uniform(0.5, 3)))
    light = (light - light.min()) / np.ptp(light) * 0.7 + 0.15 + 0.04 * np.sin(0.9 * x + 0.25 * y) * (y < 50)
    hue = 0.15 * np.sin(x / 30) + 0.1 * np.cos(y / 25)
    return [np.clip(light * (1 + k * hue), 0, 1) * 60000 for k in (1, 0, -1)]


def sampled(planes, pattern):
    return np.choose(X._masks(planes[0].shape, pattern), planes)


def zone(size=144, strength=1.0, centre=(72, 72), tint=(1, 1, 1)):
    y, x = np.mgrid[0:size, 0:size].astype(float)
    plate = 30000 + 25000 * np.cos(np.pi * strength * ((x - centre[1]) ** 2 + (y - centre[0]) ** 2) / size)
    return [plate * t for t in tint]


@pytest.mark.parametrize("size", ((30, 42), (13, 17), (12, 12)))
def test_six_by_six_is_exact_on_flat_frames_and_ramps(size):
    y, x = np.mgrid[0 : size[0], 0 : size[1]].astype(float)
    for planes in ([np.full(size, v) for v in (1000.0, 5000.0, 300.0)], [1000 + 30 * y + 50 * x, 9000 + 20 * y - 10 * x, 500 + 10 * x + 70 * y]):
        for passes in (1, 3):
            made = X.six_by_six(sampled(planes, X.XTRANS), passes)
            assert max(np.abs(a - b).max() for a, b in zip(made, planes, strict=True)) < 1e-6


def test_six_by_six_keeps_samples_and_beats_the_fast_method(spark):
    for seed in (0, 1):
        planes = scene(seed=seed)
        v = sampled(planes, X.XTRANS)
        one, three = X.six_by_six(v, 1), X.six_by_six(v, 3)
        assert (np.choose(X._masks(v.shape, X.XTRANS), three) == v).all()
        y, x = np.indices(v.shape)
        rows = list(zip([0] * v.size, y.ravel().tolist(), x.ravel().tolist(), X._masks(v.shape, X.XTRANS).ravel().tolist(), v.ravel().tolist(), strict=True))
        fast = np.zeros((3, *v.shape))
        for r in D.xtrans_fast(spark.createDataFrame(rows, "frame long, y long, x long, c int, v double"), "v").collect():
            fast[:, r.y, r.x] = r.r, r.g, r.b
        assert quality(three, planes) > quality(one, planes) > quality(fast, planes) + 6


def test_another_pattern_and_small_frames():
    turned = tuple(zip(*X.XTRANS, strict=True))
    planes = [p.T for p in scene()]
    a = X.six_by_six(sampled(planes, turned), 1, turned)
    b = X.six_by_six(sampled([p.T for p in planes], X.XTRANS), 1)
    assert np.abs(a[0][10:-10, 10:-10] - b[0].T[10:-10, 10:-10]).mean() < 200
    for size in ((1, 1), (2, 5), (6, 6), (7, 3)):
        made = X.six_by_six(np.full(size, 7.0))
        assert all(np.isfinite(p).all() for p in made)


def test_weights_fit_planes():
    for color in range(3):
        for line in (None, *X.LINES):
            for y in range(6):
                for x in range(6):
                    taps = X.fit(X.XTRANS, color, line, 4, False)[6 * y + x]
                    at = np.array([(1, dy, dx) for dy, dx, _ in taps], float)
                    assert np.array([w for *_, w in taps]) @ at == pytest.approx([1, 0, 0], abs=1e-9)
                    assert all(X.XTRANS[(y + dy) % 6][(x + dx) % 6] == color and (dy, dx) != (0, 0) for dy, dx, _ in taps)


def test_textures_are_exact_inside_flat_frames_and_ramps():
    y, x = np.mgrid[0:40, 0:36].astype(float)
    for planes in ([np.full((40, 36), v) for v in (1000.0, 5000.0, 300.0)], [1000 + 30 * y + 50 * x, 9000 + 20 * y - 10 * x, 500 + 10 * x + 70 * y]):
        made = X.texture_aware(sampled(planes, X.BAYER))
        assert max(np.abs(a - b)[6:-6, 6:-6].max() for a, b in zip(made, planes, strict=True)) < 1e-6


def test_textures_beat_the_other_methods_on_zone_plates():
    for plate in (zone(), zone(strength=0.5, centre=(0, 0)), zone(strength=0.7, centre=(72, 0)), zone(tint=(0.9, 1, 0.7))):
        v = sampled(plate, X.BAYER)
        mine = quality(X.texture_aware(v), plate)
        assert mine > max(quality(f(v), plate) for f in M.METHODS.values())
    planes = scene()
    v = sampled(planes, X.BAYER)
    assert quality(X.texture_aware(v), planes) > quality(M.error_minimising(v), planes) - 1


@pytest.mark.parametrize(("method", "period", "size"), (("xtrans", 6, 36), ("xtrans_one", 6, 36), ("texture", 2, 40)))
def test_tiles_leave_no_seams(spark, method, period, size):
    planes = scene(80)
    v = sampled(planes, X.XTRANS if period == 6 else X.BAYER)
    y, x = np.indices(v.shape)
    px = spark.createDataFrame(list(zip([3] * v.size, y.ravel().tolist(), x.ravel().tolist(), v.ravel().tolist(), strict=True)), "frame long, y long, x long, v double")
    kernel = {"xtrans": lambda a: X.six_by_six(a, 3), "xtrans_one": lambda a: X.six_by_six(a, 1), "texture": X.texture_aware}[method]
    whole = kernel(v)
    tiles = apply_kernel(px, ["v"], lambda a: dict(zip("rgb", kernel(a), strict=True)), ["r", "g", "b"], size=size, halo={"xtrans": 24, "xtrans_one": 12, "texture": 22}[method], period=period)
    worst = max(abs(c - whole[k][r.y, r.x]) for r in tiles.collect() for k, c in enumerate((r.r, r.g, r.b)))
    assert worst < 1e-6
    by_name = D.demosaic(px, "v", method)
    assert by_name.count() == v.size and by_name.where(F.isnan("r") | F.isnan("g") | F.isnan("b")).count() == 0
