"""Operators that need a whole frame: its statistics, or the solution of a system over it.

Local parts run on halo tiles or along lines.  Statistics are aggregates of one row a frame, joined back to its pixels;
systems are solved along lines or in rounds over overlapping tiles.  No task holds a frame, and the result doesn't depend on
the tiles' size.  Where a statistic is taken of a kernel's result, the kernel runs twice, once for each side of the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .detail import resample
from .tiles import Place, a_trous, apply_kernel, conjugate_gradient, gaussian, on_tiles, pixels, tile_pieces
from .window import _line

#: Bins an octave of the quantiles of magnitudes.
BINS = 256
#: Counts that a task holds before it merges them.
HELD = 1 << 18


def quantiles(px: DataFrame, columns: list[str], share: float, suffix: str) -> DataFrame:
    """(frame, column + suffix ...): quantiles of magnitudes from logarithmic bins, as the middle of the first bin that holds
    ``share`` of the samples: within 0.14 % of the value, from counts of bounded size.  Zero is a bin of its own."""
    # column and bin are one number: the counts before the exchange hold a row for every few samples
    bin_of = lambda v: F.coalesce(F.when(v > 0, F.least(F.floor(F.log2(v) * BINS), F.lit((1 << 19) - 1)) + (1 << 19)), F.lit(0))
    places = px.select("frame", F.explode(F.array(*[bin_of(F.abs(c)) + (k << 20) for k, c in enumerate(columns)])).alias("at"))
    bins = places.groupBy("frame", "at").agg(F.count("*").alias("n")).withColumn("c", F.shiftright("at", 20))
    w = W.partitionBy("frame", "c")
    # a few thousand bins a frame and column, zero first
    ranked = bins.withColumns({"cum": F.sum("n").over(w.orderBy("at")), "total": F.sum("n").over(w), "bin": F.col("at") % (1 << 20)})
    return _middles(ranked.groupBy("frame", "c").agg(F.min(F.when(F.col("cum") >= share * F.col("total"), F.col("bin"))).alias("bin")), columns, suffix)


def _middles(found: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    """One row a frame with the middles of the bins of (frame, c, bin)."""
    middle = F.when(F.col("bin") > 0, F.pow(F.lit(2.0), (F.col("bin") - (1 << 19) + 0.5) / BINS)).when(F.col("bin") == 0, 0.0)
    return found.groupBy("frame").agg(*[F.max(F.when(F.col("c") == k, middle)).alias(c + suffix) for k, c in enumerate(columns)])


def _bins(v: np.ndarray) -> np.ndarray:
    """The bins of ``quantiles`` for magnitudes in arrays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.minimum(np.floor(np.log2(v) * BINS), (1 << 19) - 1) + (1 << 19)
    return np.where(v > 0, at, np.where(np.isnan(v), 1 << 19, 0)).astype(np.int64)  # a comparison of Spark's takes NaN as large


def _sums(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    return [k[first] for k in keys], np.add.reduceat(n, first)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (frame, at, n) to pieces (frame, c, at, n), arrays of a frame's and column's bins and counts.  Tiles of a frame follow
    each other in a task, so few pieces are made of a frame; what is held is bounded in any order."""

    def pieces(frame: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        c = at >> 20
        first = np.flatnonzero(np.r_[True, (frame[1:] != frame[:-1]) | (c[1:] != c[:-1])])
        parts = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True)]
        packed = at.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(frame[first]), pa.array(c[first]), *[pa.array([a[p].tobytes() for p in parts], pa.binary()) for a in (packed, n)]], names=["frame", "c", "at", "n"])

    def merge(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        frame, at, n = (np.concatenate(a) for a in zip(*held, strict=True))
        keys, n = _sums([frame, at], n)
        return (*keys, n)

    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch[k].to_numpy(zero_copy_only=False) for k in ("frame", "at", "n")))
            size += batch.num_rows
        if size >= HELD:
            held = [merge(held)]
            size = len(held[0][0])
            if size >= HELD // 2:
                yield pieces(*held[0])
                held, size = [], 0
    if size:
        yield pieces(*merge(held))


def tile_quantiles(tiles: DataFrame, kernel: Callable[..., dict[str, np.ndarray]], columns: list[str], share: float, suffix: str, size: int, halo: int) -> DataFrame:
    """``quantiles`` of what ``kernel`` makes of one plane's pieces.  Magnitudes are counted where the tile is: a small tile
    has about as many bins as samples, so that a hash aggregate over the tiles of a task would hold nearly all their samples."""

    def counted(frame: int, _y: np.ndarray, _x: np.ndarray, made: dict[str, np.ndarray]) -> pa.Table:
        at, n = np.unique(np.concatenate([_bins(np.abs(made[c])) + (k << 20) for k, c in enumerate(columns)]), return_counts=True)
        return pa.table({"frame": pa.array(np.full(len(at), frame, np.int64)), "at": pa.array(at), "n": pa.array(n.astype(np.int64))})

    def found(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, n = (np.concatenate([np.frombuffer(b.as_buffer(), t) for b in table[c]]) for c, t in (("at", np.int32), ("n", np.int64)))
        (at,), n = _sums([at], n)
        cum = np.cumsum(n)
        return pa.table({"frame": [key[0]], "c": [key[1]], "bin": pa.array(at[[np.argmax(cum >= share * cum[-1])]] % (1 << 20), pa.int64())})

    counts = on_tiles(tiles, 1, kernel, size, halo, counted, "frame long, at long, n long")
    pieces = counts.mapInArrow(_merged, "frame long, c long, at binary, n binary")
    return _middles(pieces.groupBy("frame", "c").applyInArrow(found, "frame long, c long, bin long"), columns, suffix)


def _clip(c: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(c, low), high)


def retinex(px: DataFrame, value: str, out: str, sigmas: list[float], gain: float = 1.0, size: int = 256) -> DataFrame:
    """Mean over scales of log(value) - log(blur), stretched by the frame's means and deviations around its mean, between 0
    and its largest value."""

    def ratio(a: np.ndarray) -> dict[str, np.ndarray]:
        a = np.maximum(a, 1e-3)
        return {"_a": a, "_r": np.mean([np.log(a) - np.log(np.maximum(gaussian(a, s), 1e-3)) for s in sigmas], axis=0)}

    rows = apply_kernel(px, [value], ratio, ["_a", "_r"], size, ceil(3 * max(sigmas)))
    whole = rows.groupBy("frame").agg(F.avg("_a").alias("_ma"), F.stddev_pop("_a").alias("_sa"), F.max("_a").alias("_top"), F.avg("_r").alias("_mr"), F.stddev_pop("_r").alias("_sr"))
    stretched = F.col("_ma") + gain * F.col("_sa") * (F.col("_r") - F.col("_mr")) / F.when(F.col("_sr") > 0, F.col("_sr")).otherwise(1.0)
    return rows.join(whole, "frame").select("frame", "y", "x", _clip(stretched, F.lit(0.0), F.col("_top")).alias(out))


def _details(px: DataFrame, value: str, levels: int, size: int) -> tuple[DataFrame, list[str]]:
    """Wavelet details ``_d0`` ... and residual ``_rest``, with the deviation of each level's noise in the frame, ``_d0_n`` ..."""
    names = [f"_d{k}" for k in range(levels)]

    def split(a: np.ndarray) -> dict[str, np.ndarray]:
        details, rest = a_trous(a, levels)
        return dict(zip(names, details, strict=True)) | {"_rest": rest}

    halo = 2 * (2**levels - 1)
    tiles = tile_pieces(px, [value], size, halo)
    rows = pixels(tiles, 1, split, [*names, "_rest"], size, halo)
    noise = tile_quantiles(tiles, split, names, 0.5, "_n", size, halo)
    # by estimates from before the kernels the pixels look smaller than one row a frame: they are neither sent to all nor sorted
    return rows.join(noise.hint("shuffle_hash"), "frame").withColumns({f"{n}_n": F.col(f"{n}_n") / 0.6745 for n in names}), names


def wavelet_equalize(px: DataFrame, value: str, out: str, gains: list[float], thresholds: list[float] | None = None, size: int = 256) -> DataFrame:
    """Details scaled by level; those under a level's threshold times the deviation of its noise (median magnitude in the
    frame) shrink first."""
    rows, names = _details(px, value, len(gains), size)
    new = F.col("_rest")
    for n, g, t in zip(names, gains, thresholds or [0.0] * len(gains), strict=True):
        d, limit = F.col(n), t * F.col(f"{n}_n")
        kept = d * d / (d * d + limit * limit + 1e-30) * d
        new = new + g * (F.when(limit > 0, kept).otherwise(d) if t else d)
    return rows.select("frame", "y", "x", new.alias(out))


def shrink_coefficients(px: DataFrame, value: str, out: str, levels: int, strength: float, size: int = 256) -> DataFrame:
    """Wavelet denoising: each level's coefficients by c^2 / (c^2 + noise^2 exp(-c^2 / 9 noise^2)), a fixed formula; the factors
    are smoothed so that edges don't ring.  Noise is the median magnitude of the level in the frame."""
    rows, names = _details(px, value, levels, size)

    def shrunk(rest: np.ndarray, *planes: np.ndarray) -> dict[str, np.ndarray]:
        for k, (d, n) in enumerate(zip(planes[:levels], planes[levels:], strict=True)):
            noise = strength * n
            factor = d * d / (d * d + noise * noise * np.exp(-d * d / (9 * noise * noise + 1e-30)) + 1e-30)
            rest = rest + gaussian(factor, 1.0 + k / 2) * d
        return {out: rest}

    return apply_kernel(rows, ["_rest", *names, *[f"{n}_n" for n in names]], shrunk, [out], size, ceil(3 * (1.0 + (levels - 1) / 2)))


def defringe(px: DataFrame, a: str, b: str, radius: float, threshold: float, size: int = 256) -> DataFrame:
    """(frame, y, x, a, b): chroma whose distance to its blur exceeds ``threshold`` times the frame's mean is replaced by a
    mean of neighbours, weighted by how ordinary they are."""

    def distance(a_: np.ndarray, b_: np.ndarray) -> dict[str, np.ndarray]:
        return {a: a_, b: b_, "_c": (a_ - gaussian(a_, radius)) ** 2 + (b_ - gaussian(b_, radius)) ** 2}

    r = max(1, int(2 * radius))

    def replaced(a_: np.ndarray, b_: np.ndarray, chroma: np.ndarray, limit: np.ndarray) -> dict[str, np.ndarray]:
        weight = 1 / (chroma + limit / 33 + 1e-12)
        padded = [np.pad(p, r, mode="edge") for p in (weight, weight * a_, weight * b_)]
        sums = [sum(p[dy : dy + a_.shape[0], dx : dx + a_.shape[1]] for dy in range(2 * r + 1) for dx in range(2 * r + 1)) for p in padded]
        hit = chroma > limit
        return {a: np.where(hit, sums[1] / sums[0], a_), b: np.where(hit, sums[2] / sums[0], b_)}

    rows = apply_kernel(px, [a, b], distance, [a, b, "_c"], size, ceil(3 * radius))
    limit = rows.groupBy("frame").agg((threshold * F.avg("_c")).alias("_limit"))
    return apply_kernel(rows.join(limit, "frame"), [a, b, "_c", "_limit"], replaced, [a, b], size, r)


def line_denoise(px: DataFrame, value: str, out: str, noise: float) -> DataFrame:
    """Offsets of whole rows, then of whole columns: the part of their means that stands out from a smooth course (a Gaussian
    of three lines, edges repeated), limited by ``noise``.  Means are one row a line."""
    weights = {k: float(np.exp(-k * k / 18)) for k in range(-9, 10)}
    rows = px.withColumn(out, F.col(value))
    for across in ("y", "x"):
        mean = rows.groupBy("frame", across).agg(F.avg(out).alias("_m"))
        w = W.partitionBy("frame").orderBy(across)
        ends = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        near = lambda k: F.coalesce(F.lag("_m", -k).over(w), F.first("_m").over(ends)) if k < 0 else F.coalesce(F.lead("_m", k).over(w), F.last("_m").over(ends))  # noqa: E731, B023
        smooth = sum((v * near(k) for k, v in weights.items()), F.lit(0.0)) / sum(weights.values())
        offset = mean.select("frame", across, _clip(F.col("_m") - smooth, F.lit(-noise), F.lit(noise)).alias("_offset"))
        rows = rows.join(offset, ["frame", across]).withColumn(out, F.col(out) - F.col("_offset")).drop("_offset")
    return rows.select("frame", "y", "x", out)


def _system(logs: np.ndarray, scale: float, stopping: float):
    """Product with, and diagonal of, the identity plus gradients weighted down at edges."""
    wx, wy = scale / (np.abs(np.diff(logs, axis=1)) ** stopping + 1e-4), scale / (np.abs(np.diff(logs, axis=0)) ** stopping + 1e-4)

    def product(u: np.ndarray) -> np.ndarray:
        made = u.copy()
        dx, dy = wx * np.diff(u, axis=1), wy * np.diff(u, axis=0)
        made[:, :-1] -= dx
        made[:, 1:] += dx
        made[:-1] -= dy
        made[1:] += dy
        return made

    diagonal = np.ones_like(logs)
    diagonal[:, :-1] += wx
    diagonal[:, 1:] += wx
    diagonal[:-1] += wy
    diagonal[1:] += wy
    return product, diagonal


def edge_preserving(px: DataFrame, value: str, out: str, scale: float, stopping: float, size: int = 256, halo: int = 32, rounds: int = 4) -> DataFrame:
    """(frame, y, x, value, out): smoothing that minimises the distance to the input plus gradients weighted down at edges.

    Overlapping tiles are solved in ``rounds``; a tile's open sides hold the last round's values, so that the fixed point is
    the frame's own solution, and each round's error shrinks with the halo.  A frame of one tile is solved in the first.
    """

    def solve(a: np.ndarray, last: np.ndarray, at: Place) -> dict[str, np.ndarray]:
        held = np.zeros(a.shape, bool)
        held[0], held[-1] = held[0] | at.top, held[-1] | at.bottom
        held[:, 0], held[:, -1] = held[:, 0] | at.left, held[:, -1] | at.right
        product, diagonal = _system(a, scale, stopping)
        fixed = np.where(held, last, 0.0)
        rhs = np.where(held, 0.0, a - product(fixed))
        free = conjugate_gradient(lambda u: np.where(held, u, product(np.where(held, 0.0, u))), rhs, np.where(held, 1.0, diagonal), 500, 1e-12)
        return {value: a, out: np.where(held, last, free)}

    rows = px.select("frame", "y", "x", F.col(value).cast("double").alias(value), F.col(value).cast("double").alias(out))
    for _ in range(rounds):
        rows = apply_kernel(rows, [value, out], solve, [value, out], size, halo, placed=True)
    return rows


def compress_range(px: DataFrame, value: str, out: str, scale: float, stopping: float, exponent: float, detail: float, size: int = 256, halo: int = 32, rounds: int = 4) -> DataFrame:
    """Base layer raised to an exponent around the frame's brightest base, details by their own factor, in the logarithm."""
    logs = px.select("frame", "y", "x", F.log(F.greatest(F.col(value).cast("double"), F.lit(1e-4))).alias("_l"))
    rows = edge_preserving(logs, "_l", "_base", scale, stopping, size, halo, rounds)
    top = rows.groupBy("frame").agg(F.max("_base").alias("_top"))
    new = F.exp(exponent * F.col("_base") + detail * (F.col("_l") - F.col("_base")) + (1 - exponent) * F.col("_top"))
    return rows.join(top, "frame").select("frame", "y", "x", new.alias(out))


def _cosine(a: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Orthonormal cosine transform of the second kind along the last axis, by a Fourier transform of the mirrored line."""
    n = a.shape[-1]
    k = np.arange(n)
    norm = np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    if not inverse:
        return (np.fft.fft(np.concatenate([a, a[..., ::-1]], -1))[..., :n] * np.exp(-0.5j * np.pi * k / n)).real / 2 * norm
    half = a * norm * np.exp(0.5j * np.pi * k / n)
    return (np.fft.ifft(np.concatenate([half, np.zeros_like(half)], -1)).real * 2 * n)[..., :n]


def _along(px: DataFrame, along: str, columns: list[str], f, out: list[str], lines: int = 16) -> DataFrame:
    """``f`` of arrays (line, place) of ``columns``, for a few whole dense lines at a time."""
    across = "y" if along == "x" else "x"

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        line, place = table[across].to_numpy(), table[along].to_numpy()
        first = line.min()
        shape = (line.max() - first + 1, place.max() + 1)
        planes = []
        for c in columns:
            p = np.zeros(shape)
            p[line - first, place] = table[c].to_numpy()
            planes.append(p)
        made = f(*planes)
        return pa.table({"frame": table["frame"], "y": table["y"], "x": table["x"], **{o: pa.array(made[o][line - first, place]) for o in out}})

    rows = px.select(*[F.col(c).cast("long").alias(c) for c in ("frame", "y", "x")], *[F.col(c).cast("double").alias(c) for c in columns])
    keyed = rows.groupBy("frame", F.floor(F.col(across) / lines).alias("_block"))
    return keyed.applyInArrow(run, "frame long, y long, x long, " + ", ".join(f"{o} double" for o in out))


def poisson(px: DataFrame, rhs: str, out: str) -> DataFrame:
    """Solves laplace(out) = rhs with zero normal derivatives over each dense frame; the mean is zero.  Cosine transforms along
    rows and columns: three exchanges, and a task holds lines."""

    def eigenvalues(n: int) -> np.ndarray:
        return 2 * np.cos(np.pi * np.arange(n) / n) - 2

    def rows(a: np.ndarray) -> dict[str, np.ndarray]:
        return {"_f": _cosine(a), "_e": np.broadcast_to(eigenvalues(a.shape[1]), a.shape)}

    def columns(f: np.ndarray, e: np.ndarray) -> dict[str, np.ndarray]:
        both = e + eigenvalues(f.shape[1])
        return {"_f": _cosine(np.where(both == 0, 0.0, _cosine(f) / np.where(both == 0, 1.0, both)), True)}

    first = _along(px, "x", [rhs], rows, ["_f", "_e"])
    second = _along(first, "y", ["_f", "_e"], columns, ["_f"])
    return _along(second, "x", ["_f"], lambda f: {out: _cosine(f, True)}, [out])


def gradient_domain_map(px: DataFrame, value: str, out: str, alpha: float = 0.1, beta: float = 0.8) -> DataFrame:
    """Tone mapping that attenuates gradients of log luminance against the frame's mean gradient and integrates them again,
    scaled between the 0.1 and 99.9 % quantiles of the frame."""
    along = {"x": _line(None, "x"), "y": _line(None, "y")}
    logs = px.select("frame", "y", "x", F.log(F.greatest(F.col(value).cast("double"), F.lit(1e-4))).alias("_h"))
    steps = logs.withColumns({f"_g{c}": F.coalesce(F.lead("_h").over(w) - F.col("_h"), F.lit(0.0)) for c, w in along.items()})
    steps = steps.withColumn("_size", F.hypot("_gx", "_gy") + 1e-4)
    mean = steps.groupBy("frame").agg(F.avg("_size").alias("_mean"))
    phi = F.pow(F.col("_size") / (alpha * F.col("_mean") + 1e-9), beta - 1)
    eased = steps.join(mean, "frame").select("frame", "y", "x", *[(F.col(f"_g{c}") * phi).alias(f"_g{c}") for c in along])
    back = {f"_b{c}": F.coalesce(F.lag(f"_g{c}").over(w), F.lit(0.0)) for c, w in along.items()}
    div = eased.withColumns(back).select("frame", "y", "x", (F.col("_gx") - F.col("_bx") + F.col("_gy") - F.col("_by")).alias("_div"))
    rows = poisson(div, "_div", "_u").withColumn("_u", F.exp("_u"))
    ends = quantiles(rows, ["_u"], 0.001, "_lo").join(quantiles(rows, ["_u"], 0.999, "_hi"), "frame")
    scaled = (F.col("_u") - F.col("_u_lo")) / F.greatest(F.col("_u_hi") - F.col("_u_lo"), F.lit(1e-9))
    return rows.join(ends, "frame").select("frame", "y", "x", _clip(scaled, F.lit(0.0), F.lit(1.0)).alias(out))


def fringe_shift(px: DataFrame, reference: str, channel: str, block: int = 32) -> DataFrame:
    """(frame, h, w, cy, cx): shift of a channel against a reference, as linear functions (constant, along y, along x) of the
    distance from the centre, fitted to block-wise least squares.  Blocks are sums of the pixels' products; those with a
    shift of 4 and more don't count; with fewer than three there is no shift."""
    c = F.col(channel)

    def gradient(along: str) -> Column:
        before, after = F.lag(channel).over(_line(None, along)), F.lead(channel).over(_line(None, along))
        return (F.coalesce(after, c) - F.coalesce(before, c)) / F.greatest(before.isNotNull().cast("int") + after.isNotNull().cast("int"), F.lit(1))

    rows = px.withColumns({"_gy": gradient("y"), "_gx": gradient("x"), "_e": F.col(reference) - c, "_by": F.floor(F.col("y") / block), "_bx": F.floor(F.col("x") / block)})
    centred = lambda p, q: (F.sum(F.col(p) * F.col(q)) - F.sum(p) * F.sum(q) / F.count("*"))
    pairs = {"_yy": ("_gy", "_gy"), "_yx": ("_gy", "_gx"), "_xx": ("_gx", "_gx"), "_ye": ("_gy", "_e"), "_xe": ("_gx", "_e")}
    blocks = rows.groupBy("frame", "_by", "_bx").agg(*[centred(*p).alias(n) for n, p in pairs.items()])
    shape = px.groupBy("frame").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    blocks = blocks.withColumns({"_yy": F.col("_yy") + 1e-6, "_xx": F.col("_xx") + 1e-6})
    det = F.col("_yy") * F.col("_xx") - F.col("_yx") * F.col("_yx")
    blocks = blocks.withColumns({"_sy": (F.col("_ye") * F.col("_xx") - F.col("_xe") * F.col("_yx")) / det, "_sx": (F.col("_xe") * F.col("_yy") - F.col("_ye") * F.col("_yx")) / det})
    placed = blocks.join(shape, "frame").where((F.col("_by") * block < F.col("h") - block // 2) & (F.col("_bx") * block < F.col("w") - block // 2) & (F.greatest(F.abs("_sy"), F.abs("_sx")) < 4))
    placed = placed.withColumns({"_k0": F.lit(1.0), "_k1": (F.col("_by") + 0.5) * block / F.col("h") - 0.5, "_k2": (F.col("_bx") + 0.5) * block / F.col("w") - 0.5, "_wt": F.col("_yy") + F.col("_xx")})
    weighed = lambda p, q: F.sum(F.col("_wt") * F.col(p) * F.col(q))
    sums = placed.groupBy("frame").agg(
        F.count("*").alias("n"),
        F.array(*[weighed(f"_k{i}", f"_k{j}") for i in range(3) for j in range(3)]).alias("m"),
        *[F.array(*[weighed(f"_k{i}", s) for i in range(3)]).alias(s) for s in ("_sy", "_sx")],
    )

    def solve(batches):
        for b in batches:
            fits: dict[str, list] = {"cy": [], "cx": []}
            for r in b.to_pylist():
                for o, s in (("cy", "_sy"), ("cx", "_sx")):
                    known = r["n"] is not None and r["n"] >= 3
                    fits[o].append(np.linalg.lstsq(np.reshape(r["m"], (3, 3)), r[s], rcond=1e-10)[0].tolist() if known else [0.0] * 3)
            yield pa.RecordBatch.from_arrays([b["frame"], b["h"], b["w"], *[pa.array(v, pa.list_(pa.float64())) for v in fits.values()]], names=["frame", "h", "w", "cy", "cx"])

    # one row a frame
    return shape.join(sums, "frame", "left").select("frame", F.col("h").cast("long"), F.col("w").cast("long"), "n", "m", "_sy", "_sx").mapInArrow(solve, "frame long, h long, w long, cy array<double>, cx array<double>")


def correct_fringe(px: DataFrame, reference: str, channel: str, out: str, block: int = 32, steps: int = 2, limit: int = 8, size: int = 256) -> DataFrame:
    """The channel moved onto the reference, in a few steps of the linearised fit over the frame.  A step moves a sample by at
    most ``limit`` rows and columns."""

    def moved(r: np.ndarray, c: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> dict[str, np.ndarray]:
        h, w = c.shape
        return {reference: r, out: resample(c, lambda y, x: (np.clip(y + dy, 0, h - 1), np.clip(x + dx, 0, w - 1)))}

    rows = px.select(*[F.col(k).cast("long").alias(k) for k in ("frame", "y", "x")], F.col(reference).cast("double").alias(reference), F.col(channel).cast("double").alias(out))
    for _ in range(steps):
        fit = fringe_shift(rows, reference, out, block)
        u, v = F.col("y") / F.col("h") - 0.5, F.col("x") / F.col("w") - 0.5
        shift = {f"_d{a}": _clip(F.get(f"c{a}", 0) + F.get(f"c{a}", 1) * u + F.get(f"c{a}", 2) * v, F.lit(-float(limit)), F.lit(float(limit))) for a in "yx"}
        rows = apply_kernel(rows.join(fit, "frame").withColumns(shift), [reference, out, "_dy", "_dx"], moved, [reference, out], size, limit + 3)
    return rows.select("frame", "y", "x", out)
