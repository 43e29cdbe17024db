"""Adaptive interpolation of RGGB mosaics as array kernels for tiles, after the published methods.

All take the mosaic and give r, g, b.  They share the last step: red and blue are green plus an interpolated colour
difference.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_NEAR = tuple((a, b, 1.0 if a == b == 0 else 0.5 if a == 0 or b == 0 else 0.25) for a in (-1, 0, 1) for b in (-1, 0, 1))


def _shifter(v: np.ndarray, reach: int) -> Callable[[int, int], np.ndarray]:
    """Samples at an offset; the mosaic is mirrored at its edges, which keeps the colours of places."""
    p = np.pad(np.nan_to_num(v), reach, mode="reflect" if min(v.shape) > reach else "edge")
    h, w = v.shape
    return lambda dy, dx: p[reach + dy : reach + dy + h, reach + dx : reach + dx + w]


def _places(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x = np.indices(shape)
    red = (y % 2 == 0) & (x % 2 == 0)
    blue = (y % 2 == 1) & (x % 2 == 1)
    return red, ~(red | blue), blue


def from_differences(v: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Red and blue as green plus the weighted mean of the known differences around."""
    red, _, blue = _places(v.shape)
    out = []
    for mine in (red, blue):
        d, m = _shifter(np.where(mine, v - g, 0.0), 1), _shifter(mine.astype(float), 1)
        top = sum(w * d(a, b) for a, b, w in _NEAR)
        below = sum(w * m(a, b) for a, b, w in _NEAR)
        out.append(np.where(mine, v, g + top / np.maximum(below, 1e-9)))
    return out[0], g, out[1]


def _directional(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Green estimated along rows and along columns, corrected by the second difference of the sample's own colour."""
    at, (_, green, _) = _shifter(v, 2), _places(v.shape)
    rows = (at(0, -1) + at(0, 1)) / 2 + (2 * v - at(0, -2) - at(0, 2)) / 4
    columns = (at(-1, 0) + at(1, 0)) / 2 + (2 * v - at(-2, 0) - at(2, 0)) / 4
    return np.where(green, v, rows), np.where(green, v, columns)


def gradient_corrected(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Green along the smoother direction, both where they tie."""
    at = _shifter(v, 2)
    rows, columns = _directional(v)
    dx = np.abs(at(0, -1) - at(0, 1)) + np.abs(2 * v - at(0, -2) - at(0, 2))
    dy = np.abs(at(-1, 0) - at(1, 0)) + np.abs(2 * v - at(-2, 0) - at(2, 0))
    g = np.where(dx < dy, rows, np.where(dy < dx, columns, (rows + columns) / 2))
    return from_differences(v, np.where(_places(v.shape)[1], v, g))


adaptive_demosaic = gradient_corrected


def homogeneity_directed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both directions are rendered; each pixel takes the one with more neighbours alike in lightness and chroma."""
    made = [from_differences(v, g) for g in _directional(v)]
    counts = []
    planes = []
    for r, g, b in made:
        light = 0.2126729 * r + 0.7151521 * g + 0.0721750 * b
        root = [np.cbrt(np.maximum(c, 0)) for c in (r, light, b)]
        planes.append((116 * root[1], 500 * (root[0] - root[1]), 200 * (root[1] - root[2])))
    near = ((0, -1), (0, 1), (-1, 0), (1, 0))
    gaps = []
    for light, a, b in planes:
        sl, sa, sb = (_shifter(c, 1) for c in (light, a, b))
        gaps.append(([np.abs(light - sl(*o)) for o in near], [(a - sa(*o)) ** 2 + (b - sb(*o)) ** 2 for o in near]))
    # alike: within the smaller of the two directions' larger gaps along themselves
    limit_l = np.minimum(np.maximum(gaps[0][0][0], gaps[0][0][1]), np.maximum(gaps[1][0][2], gaps[1][0][3]))
    limit_c = np.minimum(np.maximum(gaps[0][1][0], gaps[0][1][1]), np.maximum(gaps[1][1][2], gaps[1][1][3]))
    for lights, chromas in gaps:
        alike = sum(((dl <= limit_l) & (dc <= limit_c)).astype(float) for dl, dc in zip(lights, chromas, strict=True))
        s = _shifter(alike, 1)
        counts.append(sum(s(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    first = np.where(counts[0] > counts[1], 1.0, np.where(counts[0] < counts[1], 0.0, 0.5))
    return tuple(first * a + (1 - first) * b for a, b in zip(*made, strict=True))


def error_minimising(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Colour differences along rows and columns, smoothed, and fused by the variance of what smoothing removed."""
    taps = np.exp(-np.arange(-4, 5) ** 2 / 8.0)
    taps /= taps.sum()
    _, green, _ = _places(v.shape)
    estimates = []
    for axis, g in zip((1, 0), _directional(v), strict=True):
        # at a green place the other colour is interpolated along the line, at the others green is
        at = _shifter(v, 2)
        side = (at(0, -1) + at(0, 1)) / 2 if axis == 1 else (at(-1, 0) + at(1, 0)) / 2
        own = (2 * v - at(0, -2) - at(0, 2)) / 4 if axis == 1 else (2 * v - at(-2, 0) - at(2, 0)) / 4
        d = np.where(green, v - (side + own), g - v)
        s = _shifter(d, 4)
        along = [s(0, k) if axis == 1 else s(k, 0) for k in range(-4, 5)]
        smooth = sum(t * a for t, a in zip(taps, along, strict=True))
        f = _shifter(smooth, 4)
        line = [f(0, k) if axis == 1 else f(k, 0) for k in range(-4, 5)]
        mean = sum(line) / 9
        signal = sum((a - mean) ** 2 for a in line) / 9 + 1e-9
        noise = sum((a - b) ** 2 for a, b in zip(along, line, strict=True)) / 9 + 1e-9
        value = mean + signal / (signal + noise) * (d - mean)
        estimates.append((value, signal * noise / (signal + noise) + 1e-9))
    (a, va), (b, vb) = estimates
    fused = (a * vb + b * va) / (va + vb)
    return from_differences(v, np.where(green, v, v + fused))


def variable_gradients(v: np.ndarray, k1: float = 1.5, k2: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each colour is the sample plus the mean difference of the bilinear colours in those of eight directions whose
    gradient is under a threshold from the smallest and the largest."""
    at = _shifter(v, 2)
    red, green, blue = _places(v.shape)
    base = []
    for mine in (red, green, blue):
        m, c = _shifter(mine.astype(float), 1), _shifter(np.where(mine, v, 0.0), 1)
        top, below = sum(w * c(a, b) for a, b, w in _NEAR), sum(w * m(a, b) for a, b, w in _NEAR)
        base.append(np.where(mine, v, top / np.maximum(below, 1e-9)))
    directions = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    gradients = np.stack([np.abs(at(2 * dy, 2 * dx) - v) + np.abs(at(dy, dx) - at(-dy, -dx)) for dy, dx in directions])
    low, high = gradients.min(0), gradients.max(0)
    use = gradients <= k1 * low + k2 * (high - low)
    sums = [np.zeros_like(v) for _ in range(3)]
    for d, (dy, dx) in enumerate(directions):
        for c in range(3):
            s = _shifter(base[c], 1)
            sums[c] += use[d] * (s(dy, dx) + base[c]) / 2
    n = np.maximum(use.sum(0), 1)
    mean = [s / n for s in sums]
    own = np.where(red, mean[0], np.where(green, mean[1], mean[2]))
    return tuple(np.where(mine, v, v + mean[c] - own) for c, mine in enumerate((red, green, blue)))


def ratio_corrected(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Green by ratios of low-passed samples, mixed by how much smoother one direction is in a neighbourhood."""
    at = _shifter(v, 4)
    low = sum(w * at(a, b) for a, b, w in _NEAR) / 4
    lp = _shifter(low, 2)
    rough = []
    for step in ((0, 1), (1, 0)):
        e = at(-3 * step[0], -3 * step[1]) - 3 * at(-step[0], -step[1]) + 3 * at(step[0], step[1]) - at(3 * step[0], 3 * step[1])
        s = _shifter(e * e, 1)
        rough.append(sum(s(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)) + 1e-9)
    eps = 1e-5
    sides = []
    for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0)):
        estimate = at(dy, dx) * (1 + (low - lp(2 * dy, 2 * dx)) / (eps + low + lp(2 * dy, 2 * dx)))
        gradient = eps + np.abs(at(dy, dx) - at(-dy, -dx)) + np.abs(v - at(2 * dy, 2 * dx)) + np.abs(at(dy, dx) - at(3 * dy, 3 * dx))
        sides.append((estimate, gradient))
    (we, wg), (ee, eg), (ne, ng), (se, sg) = sides
    rows, columns = (we * eg + ee * wg) / (wg + eg), (ne * sg + se * ng) / (ng + sg)
    share = rough[1] / (rough[0] + rough[1])
    _, green, _ = _places(v.shape)
    return from_differences(v, np.where(green, v, share * rows + (1 - share) * columns))


METHODS = {"adaptive": gradient_corrected, "homogeneity": homogeneity_directed, "lmmse": error_minimising, "vng": variable_gradients, "ratio": ratio_corrected}
