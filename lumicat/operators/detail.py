"""Array kernels for detail, noise and geometry, to be run on halo tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def directional_smooth(a: np.ndarray, step: int, spread: float) -> np.ndarray:
    """Means of the 5 x 5 samples at distances of ``step``, weighted down by difference of value."""
    r = 2 * step
    p = np.pad(a, r, mode="edge")
    top, below = np.zeros_like(a), np.zeros_like(a)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            q = p[r + dy * step : r + dy * step + a.shape[0], r + dx * step : r + dx * step + a.shape[1]]
            w = 1000.0 / (np.abs(q - a) / max(spread, 1e-9) + 1000.0)
            top += w * q
            below += w
    return top / below


def pyramid_equalizer(a: np.ndarray, gains: list[float], threshold: float = 0.0, spread: float = 1.0) -> np.ndarray:
    """Bands of a directional pyramid scaled by their gains; details under the threshold keep their size."""
    coarse, bands = a, []
    for k in range(len(gains)):
        smooth = directional_smooth(coarse, 1 << k, spread)
        bands.append(coarse - smooth)
        coarse = smooth
    out = coarse
    for band, g in zip(bands, gains, strict=True):
        ease = np.clip(np.abs(band) / threshold, 0, 1) if threshold else 1.0
        out = out + band * (1 + (g - 1) * ease)
    return out


def edge_sharpen(a: np.ndarray, amount: float, passes: int = 1) -> np.ndarray:
    """Values pushed away from their neighbours across the local gradient, by a share of the second difference along it."""
    for _ in range(passes):
        p = np.pad(a, 1, mode="edge")
        gy, gx = (p[2:, 1:-1] - p[:-2, 1:-1]) / 2, (p[1:-1, 2:] - p[1:-1, :-2]) / 2
        yy, xx = p[2:, 1:-1] - 2 * a + p[:-2, 1:-1], p[1:-1, 2:] - 2 * a + p[1:-1, :-2]
        size = gy * gy + gx * gx
        share = np.where(size > 0, (gy * gy * yy + gx * gx * xx) / np.maximum(size, 1e-12), 0.0)
        a = a - amount * share
    return a


def micro_contrast(a: np.ndarray, amount: float, uniformity: float) -> np.ndarray:
    """Differences to the four neighbours amplified, less where the eight around them are uneven."""
    p = np.pad(a, 1, mode="edge")
    near = [p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    spread = np.std(near, axis=0)
    d = a - np.mean([near[1], near[3], near[4], near[6]], axis=0)
    return a + amount * d / (1 + uniformity * spread / (np.abs(a) + 1))


def resample(a: np.ndarray, where: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``a`` read at the source coordinates that ``where`` gives for each place, by bicubic interpolation; 0 outside."""
    y, x = np.indices(a.shape, dtype=float)
    sy, sx = where(y, x)
    iy, ix = np.floor(sy).astype(int), np.floor(sx).astype(int)
    ty, tx = sy - iy, sx - ix

    def weights(t: np.ndarray) -> list[np.ndarray]:
        return [((-0.5 * t + 1.0) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1, ((-1.5 * t + 2.0) * t + 0.5) * t, (0.5 * t - 0.5) * t * t]

    wy, wx = weights(ty), weights(tx)
    out = np.zeros_like(a)
    for j in range(4):
        for i in range(4):
            yy, xx = np.clip(iy + j - 1, 0, a.shape[0] - 1), np.clip(ix + i - 1, 0, a.shape[1] - 1)
            out += wy[j] * wx[i] * a[yy, xx]
    inside = (sy >= 0) & (sy <= a.shape[0] - 1) & (sx >= 0) & (sx <= a.shape[1] - 1)
    return np.where(inside, out, 0.0)


def radial_shift(k: float, cy: float, cx: float, size: float) -> Callable:
    """Source coordinates of a radial magnification that grows with the square of the distance: distortion, or a colour
    fringe when only one channel is moved."""

    def where(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r2 = ((y - cy) ** 2 + (x - cx) ** 2) / size**2
        return cy + (y - cy) * (1 + k * r2), cx + (x - cx) * (1 + k * r2)

    return where


def flood_mask(mask: np.ndarray) -> np.ndarray:
    """A mask with its holes filled: what the border can't reach outside it."""
    free = np.pad(~mask, 1, constant_values=True)
    reach = np.zeros_like(free)
    reach[0, :] = reach[-1, :] = reach[:, 0] = reach[:, -1] = True
    while True:
        grown = reach.copy()
        grown[1:] |= reach[:-1]
        grown[:-1] |= reach[1:]
        grown[:, 1:] |= reach[:, :-1]
        grown[:, :-1] |= reach[:, 1:]
        grown &= free
        if (grown == reach).all():
            return ~reach[1:-1, 1:-1]
        reach = grown
