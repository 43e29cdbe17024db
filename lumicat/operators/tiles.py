"""Tile kernels: operators whose recursion, iteration or solver has no column form.

A frame is cut into tiles with a halo (``halo_tiles``); every pixel is sent to the tiles whose halo holds it, each tile is
one array in one task, and a kernel returns the tile's core.  Pixels travel as pieces, the samples of one tile that lay in one
batch, since a row a pixel and tile takes several times their bytes in exchanges and sorts.  Tiles bound the memory of a task
however large a frame is; kernels with unbounded reach (recursive filters, solvers) state their halo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Place(NamedTuple):
    """Where a tile's array lies: its first row and column in the frame, and the sides on which the frame goes on."""

    y0: int
    x0: int
    top: bool
    left: bool
    bottom: bool
    right: bool


def halo_tiles(px: DataFrame, columns: list[str], size: int, halo: int) -> DataFrame:
    """(frame, ty, tx, at, samples): pieces of the tiles whose halo holds the pixels of ``px`` (frame, y, x, *columns).  ``at``:
    32-bit places in the tile's square with its halo, row by row; ``samples``: doubles, a column after the other.

    A batch is dealt as it comes: where pixels of a frame lie together a piece is a large part of a tile, else a few samples.
    """
    side = size + 2 * halo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame, y, x = (batch[c].to_numpy(zero_copy_only=False) for c in ("frame", "y", "x"))
            values = [batch[c].to_numpy(zero_copy_only=False) for c in columns]
            first = [np.maximum((c - halo) // size, 0) for c in (y, x)]
            more = [np.maximum((c + halo) // size, 0) - f for c, f in zip((y, x), first, strict=True)]
            for dy in range(int(more[0].max(initial=-1)) + 1):
                for dx in range(int(more[1].max(initial=-1)) + 1):
                    i = np.flatnonzero((more[0] >= dy) & (more[1] >= dx))
                    ty, tx = first[0][i] + dy, first[1][i] + dx
                    order = np.lexsort((tx, ty, frame[i]))
                    i, ty, tx = i[order], ty[order], tx[order]
                    f = frame[i]
                    new = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])][: len(i)])
                    at = ((y[i] - np.maximum(ty * size - halo, 0)) * side + x[i] - np.maximum(tx * size - halo, 0)).astype(np.int32)
                    samples = np.array([v[i] for v in values], np.float64)
                    parts = [slice(a, b) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(i)])]
                    yield pa.RecordBatch.from_arrays([pa.array(f[new]), pa.array(ty[new]), pa.array(tx[new]), pa.array([at[p].tobytes() for p in parts], pa.binary()), pa.array([samples[:, p].tobytes() for p in parts], pa.binary())], names=["frame", "ty", "tx", "at", "samples"])

    return px.select("frame", "y", "x", *columns).mapInArrow(run, "frame long, ty long, tx long, at binary, samples binary")


def tile_pieces(px: DataFrame, columns: list[str], size: int, halo: int) -> DataFrame:
    """``halo_tiles`` of columns of any numeric type."""
    rows = px.select(*[F.col(c).cast("long").alias(c) for c in ("frame", "y", "x")], *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)])
    return halo_tiles(rows, columns, size, halo)


def on_tiles(pieces: DataFrame, planes: int, kernel: Callable[..., dict[str, np.ndarray]], size: int, halo: int, gather: Callable[..., pa.Table], schema: str, placed: bool = False) -> DataFrame:
    """Rows of ``schema`` that ``gather`` makes of each tile's frame, the places (y, x) of its core and the core's part of what
    ``kernel`` returns.  ``pieces``: of ``tile_pieces``; where several are made of the same, its exchange is read again."""
    side = size + 2 * halo

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        frame, ty, tx = (k.as_py() for k in key)
        y0, x0 = max(0, ty * size - halo), max(0, tx * size - halo)
        at = [np.frombuffer(b.as_buffer(), np.int32) for b in table["at"]]
        samples = [np.frombuffer(b.as_buffer(), np.float64).reshape(planes, len(a)) for a, b in zip(at, table["samples"], strict=True)]
        y, x = np.divmod(np.concatenate(at).astype(np.int64), side)
        shape = (int(y.max()) + 1, int(x.max()) + 1)
        arrays = np.full((planes, *shape), np.nan)
        arrays[:, y, x] = np.concatenate(samples, 1)
        bottom, right = y0 + shape[0] == (ty + 1) * size + halo, x0 + shape[1] == (tx + 1) * size + halo
        place = Place(y0, x0, y0 > 0, x0 > 0, bottom, right)
        made = kernel(*arrays, at=place) if placed else kernel(*arrays)
        core = ((y + y0) // size == ty) & ((x + x0) // size == tx)
        y, x = y[core], x[core]
        return gather(frame, y + y0, x + x0, {o: np.asarray(m, np.float64)[y, x] for o, m in made.items()})

    return pieces.groupBy("frame", "ty", "tx").applyInArrow(run, schema)


def pixels(pieces: DataFrame, planes: int, kernel: Callable[..., dict[str, np.ndarray]], out: list[str], size: int, halo: int, placed: bool = False) -> DataFrame:
    """(frame, y, x, *out) of the tiles' cores."""

    def gather(frame: int, y: np.ndarray, x: np.ndarray, made: dict[str, np.ndarray]) -> pa.Table:
        return pa.table({"frame": pa.array(np.full(len(y), frame, np.int64)), "y": pa.array(y), "x": pa.array(x), **{o: pa.array(made[o]) for o in out}})

    return on_tiles(pieces, planes, kernel, size, halo, gather, "frame long, y long, x long, " + ", ".join(f"{o} double" for o in out), placed)


def apply_kernel(px: DataFrame, columns: list[str], kernel: Callable[..., dict[str, np.ndarray]], out: list[str], size: int = 256, halo: int = 16, period: int = 1, placed: bool = False) -> DataFrame:
    """(frame, y, x, *out): ``kernel`` gets one array a column (tile with halo; NaN where there is no pixel) and returns
    arrays of the same shape; the core is kept.  ``period``: arrays begin at multiples of it, as kernels of mosaics need
    (the halo is widened to one; the size must be one).  ``placed``: the kernel gets the tile's ``Place`` as ``at``."""
    if size % period:
        raise ValueError("size must be a multiple of the period")
    halo = -(-halo // period) * period
    return pixels(tile_pieces(px, columns, size, halo), len(columns), kernel, out, size, halo, placed)


# ---- kernels over arrays


def _edge(a: np.ndarray, r: int) -> np.ndarray:
    return np.pad(a, r, mode="edge")


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable, edges repeated, three sigma wide."""
    if sigma <= 0:
        return a
    r = max(1, int(np.ceil(3 * sigma)))
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    w /= w.sum()
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        a = sum(w[k] * np.take(p, range(k, k + a.shape[axis]), axis) for k in range(2 * r + 1))
    return a


def recursive_gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Recursive approximation of third order, forward and backward along both axes: cost doesn't grow with sigma.
    Reaches about five sigma."""
    # fixed values: the published coefficients
    q = 0.98711 * sigma - 0.96330 if sigma >= 2.5 else 3.97156 - 4.14554 * np.sqrt(1 - 0.26891 * sigma)
    b0 = 1.57825 + 2.44413 * q + 1.4281 * q * q + 0.422205 * q**3
    b1, b2, b3 = (2.44413 * q + 2.85619 * q * q + 1.26661 * q**3) / b0, -(1.4281 * q * q + 1.26661 * q**3) / b0, 0.422205 * q**3 / b0
    gain = 1 - (b1 + b2 + b3)

    def along(m: np.ndarray) -> np.ndarray:
        out = np.empty_like(m)
        w1 = w2 = w3 = m[0]
        for i, row in enumerate(m):
            w1, w2, w3 = gain * row + b1 * w1 + b2 * w2 + b3 * w3, w1, w2
            out[i] = w1
        w1 = w2 = w3 = out[-1]
        for i in range(len(out) - 1, -1, -1):
            w1, w2, w3 = gain * out[i] + b1 * w1 + b2 * w2 + b3 * w3, w1, w2
            out[i] = w1
        return out

    return along(along(a).T).T


def bilateral(a: np.ndarray, sigma_space: float, sigma_value: float) -> np.ndarray:
    """Means weighted by distance and by difference of value."""
    r = max(1, int(np.ceil(2 * sigma_space)))
    p = _edge(a, r)
    top, below = np.zeros_like(a), np.zeros_like(a)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            q = p[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]]
            w = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - (q - a) ** 2 / (2 * sigma_value**2))
            top += w * q
            below += w
    return top / below


def richardson_lucy(a: np.ndarray, sigma: float, iterations: int, damping: float = 0.0) -> np.ndarray:
    """Deconvolution by a Gaussian; damping pulls the correction towards one where it is small."""
    a = np.maximum(a, 1e-6)
    x = a.copy()
    for _ in range(iterations):
        ratio = a / np.maximum(gaussian(x, sigma), 1e-6)
        if damping:
            u = np.minimum(1.0, np.abs(ratio - 1) / damping)
            ratio = 1 + (ratio - 1) * u * u
        x *= gaussian(ratio, sigma)
    return x


def a_trous(a: np.ndarray, levels: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Undecimated wavelet details of each level and the residual; they sum to the input."""
    taps = np.array([1, 4, 6, 4, 1]) / 16
    details = []
    for k in range(levels):
        step = 1 << k
        smooth = a
        for axis in (0, 1):
            p = np.pad(smooth, [(2 * step, 2 * step) if i == axis else (0, 0) for i in (0, 1)], mode="reflect" if min(a.shape) > 2 * step else "edge")
            smooth = sum(taps[j] * np.take(p, range(j * step, j * step + a.shape[axis]), axis) for j in range(5))
        details.append(a - smooth)
        a = smooth
    return details, a


def conjugate_gradient(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, precondition: np.ndarray, iterations: int = 60, tolerance: float = 1e-8) -> np.ndarray:
    """Solves a symmetric positive system given by its product, with a diagonal preconditioner."""
    x = np.zeros_like(b)
    r = b - apply(x)
    z = r / precondition
    p, rz = z.copy(), float((r * z).sum())
    for _ in range(iterations):
        if rz <= tolerance:
            break
        ap = apply(p)
        alpha = rz / float((p * ap).sum())
        x += alpha * p
        r -= alpha * ap
        z = r / precondition
        rz, old = float((r * z).sum()), rz
        p = z + rz / old * p
    return x


def false_color(r: np.ndarray, g: np.ndarray, b: np.ndarray, steps: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median of both chroma planes, luminance kept."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    i, q = r - y, b - y
    for _ in range(steps):
        i, q = median3(i), median3(q)
    return y + i, y - (0.299 * i + 0.114 * q) / 0.587, y + q


def median3(a: np.ndarray) -> np.ndarray:
    p = _edge(a, 1)
    return np.median([p[dy : dy + a.shape[0], dx : dx + a.shape[1]] for dy in range(3) for dx in range(3)], axis=0)


def grain(shape: tuple[int, int], y0: int, x0: int, strength: float, scale: float, seed: int = 0) -> np.ndarray:
    """Smooth noise as a function of position and seed alone, so that tiles join."""
    def lattice(iy: np.ndarray, ix: np.ndarray) -> np.ndarray:
        h = (iy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (ix.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(seed)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h.astype(np.float64) / 2**63 - 1

    y, x = np.meshgrid((np.arange(shape[0]) + y0) / scale, (np.arange(shape[1]) + x0) / scale, indexing="ij")
    iy, ix = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    ty, tx = y - iy, x - ix
    ty, tx = ty * ty * (3 - 2 * ty), tx * tx * (3 - 2 * tx)
    top = lattice(iy, ix) * (1 - tx) + lattice(iy, ix + 1) * tx
    low = lattice(iy + 1, ix) * (1 - tx) + lattice(iy + 1, ix + 1) * tx
    return strength * (top * (1 - ty) + low * ty)


def inpaint(v: np.ndarray, clipped: np.ndarray) -> np.ndarray:
    """Clipped samples filled from their surroundings, nearest first, until no hole is left; without any other sample they
    stay.  The reach is unbounded: the halo must be the steps from the deepest clipped sample to the edge of its hole."""
    out = np.where(clipped, np.nan, v)
    while (hole := np.isnan(out)).any() and not hole.all():
        p = np.pad(out, 1, constant_values=np.nan)
        near = np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        count = (~np.isnan(near)).sum(0)
        mean = np.where(count > 0, np.nansum(near, axis=0) / np.maximum(count, 1), np.nan)
        out = np.where(hole & (count > 0), mean, out)
    return np.where(np.isnan(out), v, out)
