"""Colour temperature: spectra of illuminants, their chromaticity, and channel multipliers.

Scalars for the driver: a picture has one temperature.  The observer is the published analytic fit of the CIE 1931
functions (sums of skewed bells), so that no table is needed.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp

from .formulas import SRGB_FROM_XYZ

WAVELENGTHS = tuple(range(380, 785, 5))


def _bell(x: float, mean: float, below: float, above: float) -> float:
    s = below if x < mean else above
    return exp(-0.5 * ((x - mean) * s) ** 2)


def observer(nm: float) -> tuple[float, float, float]:
    """The multi-lobe fit of the 1931 standard observer."""
    x = 0.362 * _bell(nm, 442.0, 0.0624, 0.0374) + 1.056 * _bell(nm, 599.8, 0.0264, 0.0323) - 0.065 * _bell(nm, 501.1, 0.0490, 0.0382)
    y = 0.821 * _bell(nm, 568.8, 0.0213, 0.0247) + 0.286 * _bell(nm, 530.9, 0.0613, 0.0322)
    z = 1.217 * _bell(nm, 437.0, 0.0845, 0.0278) + 0.681 * _bell(nm, 459.0, 0.0385, 0.0725)
    return x, y, z


def blackbody(nm: float, temperature: float) -> float:
    m = nm * 1e-9
    return 3.7417715247e-16 * m**-5 / (exp(1.438786e-2 / (m * temperature)) - 1)


def daylight_xy(temperature: float) -> tuple[float, float]:
    """The CIE daylight locus from 4000 to 25000 K."""
    t = temperature
    x = -4.6070e9 / t**3 + 2.9678e6 / t**2 + 99.11 / t + 0.244063 if t <= 7000 else -2.0064e9 / t**3 + 1.9018e6 / t**2 + 247.48 / t + 0.237040
    return x, -3.0 * x * x + 2.87 * x - 0.275


@lru_cache(maxsize=4096)
def white(temperature: float) -> tuple[float, float, float]:
    """XYZ of an illuminant with Y = 1: a black body up to 4000 K, daylight from there on."""
    if temperature < 4000:
        xyz = [0.0, 0.0, 0.0]
        for nm in WAVELENGTHS:
            p = blackbody(nm, temperature)
            for i, v in enumerate(observer(nm)):
                xyz[i] += p * v
        return xyz[0] / xyz[1], 1.0, xyz[2] / xyz[1]
    x, y = daylight_xy(temperature)
    return x / y, 1.0, (1 - x - y) / y


def multipliers(temperature: float, green: float = 1.0, equal: float = 1.0, matrix=SRGB_FROM_XYZ) -> tuple[float, float, float]:
    """(red, green, blue) that make the illuminant grey, the largest being 1; ``equal`` scales the red-to-blue ratio."""
    w = white(float(temperature))
    rgb = [max(1e-6, sum(m * v for m, v in zip(row, w, strict=True))) for row in matrix]
    mul = [1 / rgb[0] / equal**0.5, green / rgb[1], 1 / rgb[2] * equal**0.5]
    top = max(mul)
    return tuple(m / top for m in mul)


def temperature_of(red: float, green: float, blue: float, equal: float = 1.0, low: float = 1500.0, high: float = 60000.0) -> tuple[float, float]:
    """The inverse: bisection on the red-to-blue ratio, then the tint."""
    want = red / blue
    while high - low > 0.5:
        mid = (low + high) / 2
        m = multipliers(mid, 1.0, equal)
        low, high = (mid, high) if m[0] / m[2] < want else (low, mid)
    t = (low + high) / 2
    m = multipliers(t, 1.0, equal)
    return t, (green / red) / (m[1] / m[0])
