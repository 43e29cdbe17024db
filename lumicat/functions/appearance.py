"""Staged colour models: a list of stages, each a set of named SQL expressions over the columns before it.

Stages keep long models readable and let every intermediate be computed once; ``staged`` applies them to a DataFrame,
``staged_sql`` nests them as text.
"""

from __future__ import annotations

from math import exp, pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formulas import Matrix, inverse3, num, product3, row3

Stages = list[dict[str, str]]

#: The CAT02 and Hunt-Pointer-Estevez cone matrices.
CAT02: Matrix = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834))
HPE: Matrix = ((0.38971, 0.68898, -0.07868), (-0.22981, 1.18340, 0.04641), (0.0, 0.0, 1.0))
#: Surround -> (F, c, Nc).
SURROUNDS = {"average": (1.0, 0.69, 1.0), "dim": (0.9, 0.59, 0.9), "dark": (0.8, 0.525, 0.8)}


def staged(df: DataFrame, stages: Stages) -> DataFrame:
    for stage in stages:
        df = df.withColumns({k: F.expr(e) for k, e in stage.items()})
    return df


def staged_sql(source: str, stages: Stages) -> str:
    known: set[str] = set()
    for stage in stages:
        again = ", ".join(k for k in stage if k in known)
        star = f"* exclude ({again})" if again else "*"
        source = f"(select {star}, {', '.join(f'{e} as {k}' for k, e in stage.items())} from {source})"
        known |= set(stage)
    return source


def _apply(m: Matrix, v: tuple[float, float, float]) -> list[float]:
    return [sum(a * b for a, b in zip(row, v, strict=True)) for row in m]


def cat02(white: tuple[float, float, float], target: tuple[float, float, float] = (95.047, 100.0, 108.883), degree: float = 1.0) -> Matrix:
    """The matrix that adapts XYZ from one white to another, fully or by a degree."""
    a, b = _apply(CAT02, white), _apply(CAT02, target)
    scale = [degree * y / x + 1 - degree for x, y in zip(a, b, strict=True)]
    diagonal = tuple(tuple(scale[i] if i == j else 0.0 for j in range(3)) for i in range(3))
    return product3(inverse3(CAT02), product3(diagonal, CAT02))


class Viewing:
    """Viewing conditions of CIECAM02: white on the 0..100 scale, adapting luminance, background, surround."""

    def __init__(self, white: tuple[float, float, float] = (95.05, 100.0, 108.88), adapting: float = 318.31, background: float = 20.0, surround: str = "average"):
        f, self.c, self.nc = SURROUNDS[surround]
        k = 1 / (5 * adapting + 1)
        self.fl = 0.2 * k**4 * 5 * adapting + 0.1 * (1 - k**4) ** 2 * (5 * adapting) ** (1 / 3)
        self.n = background / white[1]
        self.nbb = 0.725 * (1 / self.n) ** 0.2
        self.z = 1.48 + sqrt(self.n)
        d = max(0.0, min(1.0, f * (1 - exp((-adapting - 42) / 92) / 3.6)))
        rgb = _apply(CAT02, white)
        self.gain = [d * white[1] / v + 1 - d for v in rgb]
        self.to_cones = product3(HPE, inverse3(CAT02))
        w = [self._squash(v) for v in _apply(self.to_cones, tuple(g * v for g, v in zip(self.gain, rgb, strict=True)))]
        self.aw = (2 * w[0] + w[1] + w[2] / 20 - 0.305) * self.nbb

    def _squash(self, v: float) -> float:
        t = (self.fl * abs(v) / 100) ** 0.42
        return (400 * t / (t + 27.13)) * (1 if v >= 0 else -1) + 0.1


def ciecam02(v: Viewing, x: str, y: str, z: str) -> Stages:
    """J, C, h (degrees), Q, M, s from XYZ on the 0..100 scale; intermediates begin with ``k_``."""
    squash = lambda c: f"(sign({c}) * 400 * power({num(v.fl / 100)} * abs({c}), 0.42e0) / (power({num(v.fl / 100)} * abs({c}), 0.42e0) + 27.13e0) + 0.1e0)"
    return [
        {f"k_{c}": f"({num(g)} * {row3(row, x, y, z)})" for c, g, row in zip("rgb", v.gain, CAT02, strict=True)},
        {f"k_{c}c": row3(row, "k_r", "k_g", "k_b") for c, row in zip("rgb", v.to_cones, strict=True)},
        {f"k_{c}a": squash(f"k_{c}c") for c in "rgb"},
        {"k_a": "(k_ra - 12 * k_ga / 11 + k_ba / 11)", "k_bb": "((k_ra + k_ga - 2 * k_ba) / 9)", "k_light": f"((2 * k_ra + k_ga + k_ba / 20 - 0.305e0) * {num(v.nbb)})"},
        {"k_h": "atan2(k_bb, k_a)", "J": f"(100 * power(greatest(k_light, 0) / {num(v.aw)}, {num(v.c * v.z)}))"},
        {"h": f"(case when k_h < 0 then k_h + {num(2 * pi)} else k_h end * {num(180 / pi)})", "Q": f"({num(4 / v.c)} * sqrt(J / 100) * {num((v.aw + 4) * v.fl**0.25)})", "k_t": f"({num(50000 / 13 * v.nc * v.nbb)} * 0.25e0 * (cos(k_h + 2) + 3.8e0) * sqrt(k_a * k_a + k_bb * k_bb) / (k_ra + k_ga + 1.05e0 * k_ba))"},
        {"C": f"(power(k_t, 0.9e0) * sqrt(J / 100) * {num((1.64 - 0.29**v.n) ** 0.73)})"},
        {"M": f"(C * {num(v.fl**0.25)})"},
        {"s": "(case when Q > 0 then 100 * sqrt(M / Q) else 0e0 end)"},
    ]


def xyz_from_ciecam02(v: Viewing, j: str, c: str, h: str) -> Stages:
    """out_x, out_y, out_z (XYZ) of J, C and h in degrees."""
    unsquash = lambda t: f"(sign({t} - 0.1e0) * {num(100 / v.fl)} * power(27.13e0 * abs({t} - 0.1e0) / (400 - abs({t} - 0.1e0)), {num(1 / 0.42)}))"
    back = inverse3(v.to_cones)
    xyz = inverse3(CAT02)
    return [
        {"k_hr": f"({h} * {num(pi / 180)})", "k_t": f"(case when {j} > 0 then power({c} / (sqrt({j} / 100) * {num((1.64 - 0.29**v.n) ** 0.73)}), {num(1 / 0.9)}) else 0e0 end)", "k_light": f"({num(v.aw)} * power({j} / 100, {num(1 / (v.c * v.z))}))"},
        {"k_p2": f"(k_light / {num(v.nbb)} + 0.305e0)", "k_e": f"({num(50000 / 13 * v.nc * v.nbb)} * 0.25e0 * (cos(k_hr + 2) + 3.8e0))", "k_sin": "sin(k_hr)", "k_cos": "cos(k_hr)"},
        # t (ra + ga + 1.05 ba) = e sqrt(a^2 + b^2) with ra, ga, ba linear in p2, a and b
        {"k_m": f"(k_p2 * {num(460 / 1403 * (1 + 1 + 1.05))} * k_t / (k_e - k_t * (k_cos * {num((451 - 891 - 1.05 * 220) / 1403)} + k_sin * {num((288 - 261 - 1.05 * 6300) / 1403)})))"},
        {"k_a": "(k_m * k_cos)", "k_bb": "(k_m * k_sin)"},
        {"k_ra": "((460 * k_p2 + 451 * k_a + 288 * k_bb) / 1403e0)", "k_ga": "((460 * k_p2 - 891 * k_a - 261 * k_bb) / 1403e0)", "k_ba": "((460 * k_p2 - 220 * k_a - 6300 * k_bb) / 1403e0)"},
        {f"k_{c_}c": unsquash(f"k_{c_}a") for c_ in "rgb"},
        {f"k_{c_}": f"({row3(row, 'k_rc', 'k_gc', 'k_bc')} / {num(g)})" for c_, row, g in zip("rgb", back, v.gain, strict=True)},
        {f"out_{c_}": row3(row, "k_r", "k_g", "k_b") for c_, row in zip("xyz", xyz, strict=True)},
    ]


def bw_mixer(red: float, green: float, blue: float, filter_color: str = "none", normalise: bool = True) -> tuple[float, float, float]:
    """Channel weights of a black-and-white mix: percentages, scaled by a colour filter and normalised to a sum of one."""
    filters = {"none": (1, 1, 1), "red": (1, 0.05, 0), "orange": (1, 0.6, 0), "yellow": (1, 1, 0.05), "green": (0.6, 1, 0.3), "cyan": (0.05, 1, 1), "blue": (0, 0.05, 1), "purple": (1, 0.05, 1)}
    w = [c / 100 * f for c, f in zip((red, green, blue), filters[filter_color], strict=True)]
    total = sum(w)
    return tuple(x / total for x in w) if normalise and abs(total) > 1e-6 else tuple(w)


def gamma_parameters(power: float, slope: float) -> dict[str, float]:
    """Where a power curve meets its linear toe: threshold, offset and scale, by bisection on continuity and slope."""
    g = 1 / power
    low, high = 1e-9, 1.0

    def gap(t: float) -> float:
        # offset from equal slopes at t, then the difference of the values
        offset = slope * t ** (1 - g) / g - 1
        return (1 + offset) * t**g - offset - slope * t

    if g >= 1 or slope <= 1:
        return {"threshold": 0.0, "offset": 0.0, "slope": slope}
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gap(mid) > 0 else (low, mid)
    t = (low + high) / 2
    return {"threshold": t, "offset": slope * t ** (1 - g) / g - 1, "slope": slope}


def skin_weight(l: str, h: str, c: str) -> str:
    """How much a colour is skin: inside ranges of lightness, hue (radians) and chroma, with soft ends in hue."""
    return f"(case when {l} between 10 and 95 and {c} between 6 and 65 then case when {h} between 0.3e0 and 1.3e0 then 1e0 when {h} between 0e0 and 0.3e0 then {h} / 0.3e0 when {h} between 1.3e0 and 1.7e0 then (1.7e0 - {h}) / 0.4e0 else 0e0 end else 0e0 end)"


def reduce_chroma(l: str, a: str, b: str, steps: int = 12) -> Stages:
    """a and b shrunk towards grey until the colour lies inside sRGB: bisection on the share of chroma, ``steps`` halvings."""
    from .formulas import SRGB_FROM_XYZ, matrix3, xyz_from_lab

    def inside(share: str) -> str:
        rgb = matrix3(SRGB_FROM_XYZ, *xyz_from_lab(l, f"({a} * {share})", f"({b} * {share})"))
        return " and ".join(f"{c} between -1e-6 and 65535.000001e0" for c in rgb)

    stages: Stages = [{"k_lo": f"(case when {inside('1e0')} then 1e0 else 0e0 end)"}, {"k_w": "(case when k_lo = 1 then 0e0 else 5e-1 end)"}]
    for _ in range(steps):
        stages += [{"k_try": "(k_lo + k_w)"}, {"k_lo": f"(case when k_w > 0 and {inside('k_try')} then k_try else k_lo end)", "k_w": "(k_w / 2)"}]
    return [*stages, {"share": "k_lo"}]
