"""Operators of whole frames, on several tiles, against the same formulas over the whole array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicat.operators import detail, frames, tiles

from .test_fixtures import grid, raster

SHAPE = (50, 60)


@pytest.fixture(scope="module")
def rough():
    y, x = np.indices(SHAPE, dtype=float)
    noise = np.random.default_rng(8).normal(0, 900, SHAPE)
    return np.clip(20000 + 9000 * np.sin(y / 9) * np.cos(x / 11) + 12000 * (x > 31) + noise, 1, 65535)


def got(df, c="o"):
    return grid(df, c, *SHAPE)


def test_retinex(spark, rough):
    r = np.mean([np.log(rough) - np.log(tiles.gaussian(rough, s)) for s in (2.0, 5.0)], axis=0)
    want = np.clip(rough.mean() + 1.3 * rough.std() * (r - r.mean()) / r.std(), 0, rough.max())
    assert np.allclose(got(frames.retinex(raster(spark, rough), "v", "o", [2.0, 5.0], 1.3, 16)), want)
    assert np.allclose(got(frames.retinex(raster(spark, np.full(SHAPE, 7.0)), "v", "o", [2.0], size=32)), 7.0)


def test_wavelets(spark, rough):
    df = raster(spark, rough)
    details, rest = tiles.a_trous(rough, 3)
    noise = [np.median(np.abs(d)) / 0.6745 for d in details]
    want = rest + sum(g * (d**3 / (d * d + (t * n) ** 2)) for d, g, t, n in zip(details, (1.4, 1.2, 1.0), (2.0, 1.0, 0.0), noise, strict=True))
    several = got(frames.wavelet_equalize(df, "v", "o", [1.4, 1.2, 1.0], [2.0, 1.0, 0.0], 16))
    assert np.allclose(several, want, rtol=1e-3)
    assert np.allclose(several, got(frames.wavelet_equalize(df, "v", "o", [1.4, 1.2, 1.0], [2.0, 1.0, 0.0], 64)), rtol=1e-9)
    assert np.allclose(got(frames.wavelet_equalize(df, "v", "o", [1.0] * 3, size=16)), rough)


def test_shrinkage(spark, rough):
    df = raster(spark, rough)
    a = frames.shrink_coefficients(df, "v", "o", 3, 1.5, 16)
    assert np.allclose(got(a), got(frames.shrink_coefficients(df, "v", "o", 3, 1.5, 64)), rtol=1e-9)


def test_denoising_properties(spark):
    rng = np.random.default_rng(4)
    rng.uniform(50, 200, (48, 48))
    y, x = np.indices((64, 64), dtype=float)
    clean = 100 + 20 * np.sin(y / 7) * np.cos(x / 9)
    noisy = clean + rng.normal(0, 5, clean.shape)
    less = grid(frames.shrink_coefficients(raster(spark, noisy), "v", "o", 3, 1.5, 32), "o", 64, 64)
    assert np.abs(less - clean).mean() < 0.8 * np.abs(noisy - clean).mean()
    striped = np.full((64, 64), 100.0)
    striped[::8] += 4
    assert grid(frames.line_denoise(raster(spark, striped), "v", "o", 10.0), "o", 64, 64).std() < 0.3 * striped.std()
    flat = raster(spark, np.full((20, 20), 7.0))
    assert np.allclose(grid(frames.line_denoise(flat, "v", "o", 5.0), "o", 20, 20), 7)
    assert np.allclose(grid(frames.shrink_coefficients(flat, "v", "o", 2, 1.0, 8), "o", 20, 20), 7)


def test_defringe(spark, rough):
    a, b = rough - 20000, rough[::-1] - 24000
    a[20, 20] += 30000
    df = raster(spark, a).withColumnRenamed("v", "a").join(raster(spark, b).withColumnRenamed("v", "b"), ["frame", "y", "x"])
    c = (a - tiles.gaussian(a, 1.5)) ** 2 + (b - tiles.gaussian(b, 1.5)) ** 2
    limit = 1.3 * c.mean()
    w = np.pad(1 / (c + limit / 33 + 1e-12), 3, mode="edge")
    cut = lambda p, y, x: p[y : y + 7, x : x + 7]
    out = frames.defringe(df, "a", "b", 1.5, 1.3, 16)
    for plane, name in ((a, "a"), (b, "b")):
        p = np.pad(plane, 3, mode="edge")
        want = [[(cut(w, y, x) * cut(p, y, x)).sum() / cut(w, y, x).sum() if c[y, x] > limit else plane[y, x] for x in range(SHAPE[1])] for y in range(SHAPE[0])]
        assert np.allclose(got(out, name), want)


def test_line_denoise(spark, rough):
    striped = rough.copy()
    striped[::8] += 400
    want = striped
    for axis in (1, 0):
        mean = want.mean(axis)
        offset = np.clip(mean - tiles.gaussian(mean[:, None], 3.0)[:, 0], -300, 300)
        want = want - (offset[:, None] if axis == 1 else offset[None, :])
    assert np.allclose(got(frames.line_denoise(raster(spark, striped), "v", "o", 300.0)), want)


def test_edge_preserving_is_the_frames_solution(spark, rough):
    logs = np.log(rough)
    product, _ = frames._system(logs, 0.2, 1.0)
    n = logs.size
    matrix = np.stack([product(np.eye(n)[i].reshape(SHAPE)).ravel() for i in range(n)], 1)
    want = np.linalg.solve(matrix, logs.ravel()).reshape(SHAPE)
    rows = frames.edge_preserving(raster(spark, logs), "v", "o", 0.2, 1.0, 16, 12, 6)
    assert np.abs(got(rows) - want).max() < 1e-4 * np.ptp(want)
    base = want
    tone = np.exp(0.6 * base + 1.1 * (logs - base) + 0.4 * base.max())
    assert np.allclose(got(frames.compress_range(raster(spark, rough), "v", "o", 0.2, 1.0, 0.6, 1.1, 16, 12, 6)), tone, rtol=1e-3)


def test_poisson_and_gradient_domain(spark, rough):
    u = np.random.default_rng(2).normal(size=SHAPE)
    u -= u.mean()
    p = np.pad(u, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * u
    assert np.allclose(got(frames.poisson(raster(spark, lap), "v", "o")), u)
    out = got(frames.gradient_domain_map(raster(spark, rough), "v", "o"))
    assert 0 <= out.min() and out.max() <= 1 and out.std() > 0.05
    # without attenuation the logarithm comes back, between its own quantiles
    same = got(frames.gradient_domain_map(raster(spark, rough), "v", "o", beta=1.0))
    lo, hi = np.quantile(rough, (0.001, 0.999), method="inverted_cdf")
    assert np.allclose(same, np.clip((rough - lo) / (hi - lo), 0, 1), atol=0.01)


def test_fringe(spark):
    y, x = np.indices((64, 64), dtype=float)
    clean = 100 + 20 * np.sin(y / 7) * np.cos(x / 9)
    moved = detail.resample(clean, lambda yy, xx: (np.clip(yy + 0.7, 0, 63), np.clip(xx - 0.4, 0, 63)))
    df = raster(spark, moved).join(raster(spark, clean).withColumnRenamed("v", "ref"), ["frame", "y", "x"])
    several = grid(frames.correct_fringe(df, "ref", "v", "o", 16, size=16), "o", 64, 64)
    assert np.allclose(several, grid(frames.correct_fringe(df, "ref", "v", "o", 16, size=64), "o", 64, 64))
    assert np.abs(several - clean)[8:-8, 8:-8].mean() < 0.5 * np.abs(moved - clean)[8:-8, 8:-8].mean()
    fit = frames.fringe_shift(df, "ref", "v", 64).first()  # one block is too few
    assert (fit.h, fit.w, list(fit.cy), list(fit.cx)) == (64, 64, [0.0] * 3, [0.0] * 3)


def test_grain_joins_over_tiles(spark, rough):
    rows = tiles.apply_kernel(raster(spark, rough), ["v"], lambda v, at: {"o": tiles.grain(v.shape, at.y0, at.x0, 1.0, 3.0)}, ["o"], 16, 0, placed=True)
    assert np.allclose(got(rows), tiles.grain(SHAPE, 0, 0, 1.0, 3.0))


def test_quantiles_of_magnitudes(spark):
    df = spark.createDataFrame([(0, float(v)) for v in (0, 0, 0, -8, 100)] + [(1, 3.0)], "frame long, a double")
    q = {r.frame: r.a_q for r in frames.quantiles(df, ["a"], 0.5, "_q").collect()}
    assert q[0] == 0 and q[1] == pytest.approx(3, rel=0.002)
    assert frames.quantiles(df.where("frame = 0"), ["a"], 0.8, "_q").first().a_q == pytest.approx(8, rel=0.002)
    assert frames.quantiles(df.where(F.lit(False)), ["a"], 0.5, "_q").count() == 0
