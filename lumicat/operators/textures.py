"""Interpolation of mosaics whose samples leave directions open: six-by-six mosaics, and textures near the sampling limit of
two-by-two ones.  Array kernels for tiles.

Missing samples come from planes fitted through the known ones around, so ramps are exact whatever the mosaic; the fit's
weights depend only on the place in the period and are made once.  Beyond a frame's edge a mosaic goes on in straight lines
through samples of the same place in the period.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .mosaics import error_minimising, gradient_corrected

#: A six-by-six mosaic as sensors have it, by rows; 0 red, 1 green, 2 blue (fixed values).
XTRANS = ((1, 2, 1, 1, 0, 1), (0, 1, 0, 2, 1, 2), (1, 2, 1, 1, 0, 1), (1, 0, 1, 1, 2, 1), (2, 1, 2, 0, 1, 0), (1, 0, 1, 1, 2, 1))
Pattern = tuple[tuple[int, ...], ...]
#: Directions as steps of rows and columns.
LINES = ((0, 1), (1, 0), (1, 1), (1, -1))
#: How far samples count along a direction and across it.
ALONG, ACROSS = 1.6, 0.55


def extended(v: np.ndarray, reach: int, period: int) -> np.ndarray:
    """``v`` with ``reach`` more samples on each side, on the line through the two samples one and two periods further in (the
    nearest one period in, where there is only one); places keep their colours."""
    for axis in (0, 1):
        v = np.moveaxis(v, axis, 0)
        n = len(v)
        out = np.concatenate((np.zeros((reach, *v.shape[1:])), v, np.zeros((reach, *v.shape[1:]))))
        for k in range(1, reach + 1):
            for at, step in ((reach - k, period), (reach + n - 1 + k, -period)):
                near, far = at + step, at + 2 * step
                if not 0 <= near - reach < n:  # further out than a period: what was made before
                    out[at] = out[near] if n >= period else out[min(max(at, reach), reach + n - 1)]
                    if n >= 2 * period:
                        out[at] = 2 * out[near] - out[far]
                else:
                    out[at] = 2 * out[near] - out[far] if 0 <= far - reach < n else out[near]
        v = np.moveaxis(out, 0, axis)
    return v


@lru_cache(maxsize=256)
def fit(pattern: Pattern, color: int, line: tuple[int, int] | None, reach: int, own: bool) -> tuple[tuple[tuple[int, int, float], ...], ...]:
    """For each place of the period (by rows): (dy, dx, weight) of the samples of ``color`` whose weighted sum is, at the place, a
    plane fitted through them.  ``line``: samples along it count more.  ``own``: the place's own sample is one of them."""
    p = np.array(pattern)
    h, w = p.shape
    out = []
    for y in range(h):
        for x in range(w):
            near = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if p[(y + dy) % h, (x + dx) % w] == color and (own or (dy, dx) != (0, 0))]
            if own and (0, 0) in near:
                out.append(((0, 0, 1.0),))
                continue
            at = np.array(near, float)
            if line is None:
                far = (at**2).sum(1) / ALONG**2
            else:
                unit = np.array(line) / np.hypot(*line)
                s = at @ unit
                far = s**2 / ALONG**2 + ((at**2).sum(1) - s**2) / ACROSS**2
            weight = np.exp(-far / 2) + 1e-9
            a = np.column_stack((np.ones(len(at)), at)) * np.sqrt(weight)[:, None]
            row = (np.linalg.pinv(a) * np.sqrt(weight))[0]
            out.append(tuple((dy, dx, float(c)) for (dy, dx), c in zip(near, row, strict=True) if abs(c) > 1e-13))
    return tuple(out)


def fitted(v: np.ndarray, pattern: Pattern, color: int, line: tuple[int, int] | None = None, reach: int = 2, own: bool = True) -> np.ndarray:
    """The samples of ``color`` at all places (``fit``)."""
    h, w = len(pattern), len(pattern[0])
    period = max(h, w)
    p = extended(v, reach, period)
    out = np.zeros_like(v)
    for k, taps in enumerate(fit(pattern, color, line, reach, own)):
        y, x = divmod(k, w)
        place = out[y::h, x::w]
        for dy, dx, c in taps:
            place += c * p[reach + dy + y : reach + dy + v.shape[0] : h, reach + dx + x : reach + dx + v.shape[1] : w]
    return out


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares, edges repeated."""
    for axis in (0, 1):
        p = np.pad(a, [(r + 1, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        s = np.cumsum(p, axis=axis)
        n = a.shape[axis]
        a = np.take(s, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(s, range(n), axis)
    return a


def _second(a: np.ndarray, line: tuple[int, int]) -> np.ndarray:
    p = np.pad(a, 1, mode="edge")
    at = lambda s: p[1 + s * line[0] : 1 + s * line[0] + a.shape[0], 1 + s * line[1] : 1 + s * line[1] + a.shape[1]]
    return 2 * a - at(1) - at(-1)


def _masks(shape: tuple[int, int], pattern: Pattern) -> np.ndarray:
    p = np.array(pattern)
    return np.tile(p, (-(-shape[0] // p.shape[0]), -(-shape[1] // p.shape[1])))[: shape[0], : shape[1]]


def _colored(v: np.ndarray, g: np.ndarray, pattern: Pattern, line: tuple[int, int] | None) -> np.ndarray:
    """(3, rows, columns): red and blue are green plus their fitted difference from it."""
    c = _masks(v.shape, pattern)
    planes = [fitted(np.where(c == k, v - g, 0.0), pattern, k, line) + g for k in (0, 2)]
    return np.stack((planes[0], g, planes[1]))


def _choose(made: list[np.ndarray]) -> np.ndarray:
    """Of renderings along directions the mean of those that are about as homogeneous as the best: the fewest changes of slope
    along their own direction, counted around each pixel."""
    rough = []
    for rgb, line in zip(made, LINES, strict=True):
        light = 0.2627 * rgb[0] + 0.6780 * rgb[1] + 0.0593 * rgb[2]
        rough.append(_second(light, line) ** 2 + _second(0.56433 * (rgb[2] - light), line) ** 2 + _second(0.67815 * (rgb[0] - light), line) ** 2)
    limit = 8 * np.min(rough, axis=0) + 1e-9
    calm = np.stack([_box(_box((r <= limit).astype(float), 1), 2) for r in rough])
    use = calm >= calm.max(0) * 0.875
    return (np.stack(made, axis=1) * use).sum(1) / use.sum(0)


def six_by_six(v: np.ndarray, passes: int = 3, pattern: Pattern = XTRANS, carry: float = 0.5, step: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Red, green and blue of a six-by-six mosaic.

    Green is fitted along eight directions (four lines, both ways) and gains ``carry`` of what the sample's own colour has over
    its fit; each rendering gets its red and blue, and the homogeneous ones are averaged.  Each further pass takes green
    ``step`` of the way to what the differences of the rendering before say.
    """
    v = np.nan_to_num(v)
    c = _masks(v.shape, pattern)
    detail = {line: sum(np.where(c == k, v - fitted(np.where(c == k, v, 0.0), pattern, k, line, 4, own=False), 0.0) for k in (0, 2)) for line in LINES}
    known = np.where(c == 1, v, 0.0)
    greens = [np.where(c == 1, v, fitted(known, pattern, 1, line) + carry * detail[line]) for line in LINES]
    out = _choose([_colored(v, g, pattern, line) for g, line in zip(greens, LINES, strict=True)])
    for _ in range(passes - 1):
        # at a green place both differences are known from the rendering
        again = []
        for line in LINES:
            d = [fitted(np.where(c == 1, v - out[k], 0.0), pattern, 1, line) for k in (0, 2)]
            again.append(np.where(c == 1, v, out[1] + step * (v + np.where(c == 0, *d) - out[1])))
        out = _choose([_colored(v, g, pattern, line) for g, line in zip(again, LINES, strict=True)])
    return tuple(np.where(c == k, v, out[k]) for k in range(3))


BAYER: Pattern = ((0, 1), (1, 2))


def texture_aware(v: np.ndarray, switch: float = 1.2, noise: float = 30.0, reach: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Red, green and blue of a two-by-two mosaic (red first), with another estimator where the texture is near the sampling limit.

    Elsewhere the difference of green and a place's colour follows the smoother direction.  Near the limit neither direction is
    smooth and the choice flips from sample to sample, which shows as false colour: there the differences along the chosen
    directions vary by more than ``switch`` times what differences fused by their variances do (over squares of ``reach``,
    beyond ``noise``), and the mean of the fused ones over the area is taken, in which the texture cancels.  Red at blue
    places and blue at red ones lie on diagonals, of which the calmer counts more.
    """
    v = np.nan_to_num(v)
    c = _masks(v.shape, BAYER)
    chosen, fused = (np.where(c == 1, 0.0, method(v)[1] - v) for method in (gradient_corrected, error_minimising))
    d = chosen
    for k in (0, 2):  # each colour has its own difference from green
        mine = (c == k).astype(float)
        n = np.maximum(_box(mine, reach), 1)
        mean = lambda x: _box(mine * x, reach) / n  # noqa: E731,B023
        varies = lambda x: np.maximum(mean(x * x) - mean(x) ** 2, 0) + noise**2  # noqa: E731,B023
        share = np.clip((varies(chosen) / varies(fused) - switch) / switch, 0, 1)
        d = np.where(c == k, chosen + share * (mean(fused) - chosen), d)
    return _finish(v, c, d)


def _finish(v: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All colours from the differences ``d`` of green and the colour of each red and blue place."""
    h, w = v.shape
    g = np.where(c == 1, v, v + d)
    planes = {}
    for k in (0, 2):
        own = np.where(c == k, d, 0.0)
        q = extended(own, 3, 2)
        at = lambda dy, dx, q=q: q[3 + dy : 3 + dy + h, 3 + dx : 3 + dx + w]
        pairs = []
        for dy, dx in ((1, 1), (1, -1)):
            mean = (at(dy, dx) + at(-dy, -dx)) / 2
            rough = (at(dy, dx) - at(-dy, -dx)) ** 2 + (at(3 * dy, 3 * dx) - at(dy, dx)) ** 2 + (at(-dy, -dx) - at(-3 * dy, -3 * dx)) ** 2 + 1e-3
            pairs.append((mean, 1 / rough))
        diagonal = sum(m * a for m, a in pairs) / sum(a for _, a in pairs)
        at_other = np.where(c == k, d, np.where(c == 2 - k, diagonal, 0.0))
        e = extended(at_other, 1, 2)
        near = [e[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))]
        planes[k] = np.where(c == k, v, g - np.where(c == 1, sum(near) / 4, diagonal))
    return planes[0], g, planes[2]
