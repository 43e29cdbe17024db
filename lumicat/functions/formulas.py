"""Colour and photographic formulas as SQL expression text.

Every function takes SQL operands and gives SQL text of built-in scalar functions only, so that an expression stays in
whole-stage code generation.  ``lumicat.functions.color`` and ``lumicat.functions.photo`` wrap them as Columns.
Channels are on the 0..65535 scale unless a docstring says otherwise; Lab is scaled by 327.68.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log, sqrt

Matrix = Sequence[Sequence[float]]

#: Weights of linear luminance, the D50 white, and the constants of CIE Lab.
LUMINANCE = (0.2126729, 0.7151521, 0.0721750)
D50 = (0.9642, 1.0, 0.8249)
LAB_EPSILON, LAB_KAPPA = 216.0 / 24389.0, 24389.0 / 27.0
SCALE = 327.68
#: Linear sRGB and XYZ at D50.
XYZ_FROM_SRGB = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))
SRGB_FROM_XYZ = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
#: Bradford adaptation between D50 and D65.
D65_FROM_D50 = ((0.9555766, -0.0230393, 0.0631636), (-0.0282895, 1.0099416, 0.0210077), (0.0122982, -0.0204830, 1.3299098))
D50_FROM_D65 = ((1.0478112, 0.0228866, -0.0501270), (0.0295424, 0.9904844, -0.0170491), (-0.0092345, 0.0150436, 0.7521316))
#: OkLab's two matrices.
OK_LMS = ((0.8189330101, 0.3618667424, -0.1288597137), (0.0329845436, 0.9293118715, 0.0361456387), (0.0482003018, 0.2643662691, 0.6338517070))
OK_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
#: Transfer curves with a linear toe, as (power, toe end, slope, offset, toe end of the inverse).
GAMMAS = {
    "srgb": (2.4, 0.003040, 12.92310, 0.055, 0.039286),
    "g55_10": (5.5, 0.013189, 10.0, 0.593503, 0.131889),
    "g4_5": (4.1, 0.03089, 5.0, 0.478793, 0.154449),
    "bt709": (2.2, 0.0176, 4.5, 0.0954, 0.0795),
    "g24_17": (2.4, 0.001867, 17.0, 0.044445, 0.031746),
    "g26_11": (2.6, 0.004921, 11.0, 0.086603, 0.054127),
    "g13_2": (1.3, 0.016613, 2.0, 0.009968, 0.033226),
    "g115_2": (1.15, 0.001692, 2.0, 0.000508, 0.003384),
    "g145_3": (1.45, 0.009115, 3.0, 0.012305, 0.027345),
}


def num(x: float) -> str:
    """A double literal in any SQL dialect."""
    text = repr(float(x))
    return f"({text})" if "e" in text else f"({text}e0)"


def _case(*branches: tuple[str, str], other: str) -> str:
    return "(case " + " ".join(f"when {c} then {v}" for c, v in branches) + f" else {other} end)"


def clamp(x: str, low: str, high: str) -> str:
    return f"least(greatest({x}, {low}), {high})"


def mix(weight: str, a: str, b: str) -> str:
    """a where the weight is 1, b where it is 0."""
    return f"({weight} * ({a} - {b}) + {b})"


def row3(row: Sequence[float], x: str, y: str, z: str) -> str:
    return f"({num(row[0])} * {x} + {num(row[1])} * {y} + {num(row[2])} * {z})"


def matrix3(m: Matrix, x: str, y: str, z: str) -> tuple[str, str, str]:
    return tuple(row3(r, x, y, z) for r in m)


def luminance(r: str, g: str, b: str) -> str:
    return row3(LUMINANCE, r, g, b)


def _hue(r: str, g: str, b: str, top: str, span: str) -> str:
    """Hue in turns of a colour whose span isn't zero."""
    raw = _case((f"{r} = {top}", f"(({g} - {b}) / {span})"), (f"{g} = {top}", f"(2 + ({b} - {r}) / {span})"), other=f"(4 + ({r} - {g}) / {span})")
    return _case((f"{raw} < 0", f"({raw} / 6 + 1)"), (f"{raw} > 6", f"({raw} / 6 - 1)"), other=f"({raw} / 6)")


def hsv(r: str, g: str, b: str, unit: bool = False) -> tuple[str, str, str]:
    """Hue, saturation and value in 0..1; chroma under 1e-5 is grey with hue 0.  ``unit``: channels in 0..1."""
    one = "1" if unit else num(65535)
    r, g, b = (f"({c} / {one})" for c in (r, g, b))
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    span = f"({top} - {low})"
    grey = f"abs({span}) < {num(1e-5)}"
    h = _case((grey, num(0)), other=_hue(r, g, b, top, span))
    s = _case((grey, num(0)), other=f"({span} / {_case((f'{top} = 0', num(1)), other=top)})")
    return h, s, top


def saturation(r: str, g: str, b: str) -> str:
    return hsv(r, g, b)[1]


def rgb_from_hsv(h: str, s: str, v: str, scale: float = 65535.0) -> tuple[str, str, str]:
    sector = f"floor({h} * 6)"
    f = f"({h} * 6 - {sector})"
    p, q, t = f"({v} * (1 - {s}))", f"({v} * (1 - {s} * {f}))", f"({v} * (1 - {s} * (1 - {f})))"
    table = {1: (q, v, p), 2: (p, v, t), 3: (p, q, v), 4: (t, p, v), 5: (v, p, q)}
    return tuple(f"({num(scale)} * {_case(*[(f'{sector} = {i}', row[c]) for i, row in table.items()], other=(v, t, p)[c])})" for c in range(3))


def hsl(r: str, g: str, b: str) -> tuple[str, str, str]:
    r, g, b = (f"({c} / {num(65535)})" for c in (r, g, b))
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    span, both = f"({top} - {low})", f"({top} + {low})"
    grey = f"abs({span}) < {num(1e-5)}"
    s = _case((grey, num(0)), (f"{both} <= 1", f"({span} / {both})"), other=f"({span} / (2 - {both}))")
    return _case((grey, num(0)), other=_hue(r, g, b, top, span)), s, f"({both} / 2)"


def rgb_from_hsl(h: str, s: str, l: str) -> tuple[str, str, str]:
    high = _case((f"{l} <= {num(0.5)}", f"({l} * (1 + {s}))"), other=f"({l} + {s} - {l} * {s})")
    low = f"(2 * {l} - {high})"

    def channel(t: str) -> str:
        t = _case((f"{t} < 0", f"({t} + 6)"), (f"{t} > 6", f"({t} - 6)"), other=t)
        rise = f"({low} + ({high} - {low}) * {t})"
        fall = f"({low} + ({high} - {low}) * (4 - {t}))"
        value = _case((f"{t} < 1", rise), (f"{t} < 3", high), (f"{t} < 4", fall), other=low)
        return f"({num(65535)} * {_case((f'{s} = 0', l), other=value)})"

    return channel(f"({h} * 6 + 2)"), channel(f"({h} * 6)"), channel(f"({h} * 6 - 2)")


def _lab_f(t: str) -> str:
    return _case((f"{t} > {num(LAB_EPSILON)}", f"cbrt({t})"), other=f"(({num(LAB_KAPPA)} * {t} + 16) / 116)")


def lab_from_xyz(x: str, y: str, z: str) -> tuple[str, str, str]:
    """Lab x 327.68 of XYZ on the 0..65535 scale."""
    x, y, z = f"({x} / {num(65535 * D50[0])})", f"({y} / {num(65535)})", f"({z} / {num(65535 * D50[2])})"
    lightness = _case((f"{y} > {num(LAB_EPSILON)}", f"(116 * cbrt({y}) - 16)"), other=f"({num(LAB_KAPPA)} * {y})")
    return f"({num(SCALE)} * {lightness})", f"({num(500 * SCALE)} * ({_lab_f(x)} - {_lab_f(y)}))", f"({num(200 * SCALE)} * ({_lab_f(y)} - {_lab_f(z)}))"


def _lab_inverse(t: str) -> str:
    return _case((f"{t} > {num(24 / 116)}", f"({t} * {t} * {t})"), other=f"(({t} - {num(16 / 116)}) * {num(108 / 841)})")


def xyz_from_lab(l: str, a: str, b: str) -> tuple[str, str, str]:
    l, a, b = (f"({c} / {num(SCALE)})" for c in (l, a, b))
    fy = f"(({l} + 16) / 116)"
    y = _case((f"{l} > {num(LAB_KAPPA * LAB_EPSILON)}", f"({fy} * {fy} * {fy})"), other=f"({l} / {num(LAB_KAPPA)})")
    return f"({num(65535 * D50[0])} * {_lab_inverse(f'({fy} + {a} / 500)')})", f"({num(65535)} * {y})", f"({num(65535 * D50[2])} * {_lab_inverse(f'({fy} - {b} / 200)')})"


def lch_from_lab(a: str, b: str) -> tuple[str, str]:
    """Chroma (unscaled) and hue in radians."""
    return f"(sqrt({a} * {a} + {b} * {b}) / {num(SCALE)})", f"atan2({b}, {a})"


def lab_from_lch(c: str, h: str) -> tuple[str, str]:
    return f"({num(SCALE)} * {c} * cos({h}))", f"({num(SCALE)} * {c} * sin({h}))"


def lch_from_luv(u: str, v: str) -> tuple[str, str]:
    """Chroma and hue; a negative angle in radians has 1 added, as in the model this follows."""
    h = f"atan2({v}, {u})"
    return f"sqrt({u} * {u} + {v} * {v})", _case((f"{h} < 0", f"({h} + 1)"), other=h)


def yuv_from_lab(l: str, a: str, b: str) -> tuple[str, str, str]:
    """Y (0..65535) and CIE u', v' relative to the D50 white."""
    x, y, z = xyz_from_lab(l, a, b)
    white = D50[0] + 15 * D50[1] + 3 * D50[2]
    below = f"nullif({x} + 15 * {y} + 3 * {z}, 0)"
    return y, f"(4 * {x} / {below} - {num(4 * D50[0] / white)})", f"(9 * {y} / {below} - {num(9 * D50[1] / white)})"


def oklab_from_xyz(x: str, y: str, z: str) -> tuple[str, str, str]:
    """OkLab of XYZ at D50 in 0..1."""
    lms = matrix3(OK_LMS, *matrix3(D65_FROM_D50, x, y, z))
    return matrix3(OK_LAB, *(f"cbrt({c})" for c in lms))


def xyz_from_oklab(l: str, a: str, b: str) -> tuple[str, str, str]:
    lms = matrix3(inverse3(OK_LAB), l, a, b)
    return matrix3(D50_FROM_D65, *matrix3(inverse3(OK_LMS), *(f"({c} * {c} * {c})" for c in lms)))


def inverse3(m: Matrix) -> Matrix:
    """The inverse by cofactors; singular matrices (determinant under 1e-10) raise."""
    minor = [[m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    det = sum(m[0][j] * minor[0][j] for j in range(3))
    if abs(det) < 1e-10:
        raise ValueError("singular matrix")
    return tuple(tuple(minor[j][i] / det for j in range(3)) for i in range(3))


def product3(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(x * b[k][j] for k, x in enumerate(row)) for j in range(len(b[0]))) for row in a)


def gamma(x: str, kind: str = "srgb") -> str:
    """A transfer curve on 0..1."""
    power, toe, slope, offset, _ = GAMMAS[kind]
    return _case((f"{x} <= {num(toe)}", f"({num(slope)} * {x})"), other=f"({num(1 + offset)} * exp(ln(greatest({x}, {num(1e-300)})) / {num(power)}) - {num(offset)})")


def gamma_inverse(x: str, kind: str = "srgb") -> str:
    power, _, slope, offset, toe = GAMMAS[kind]
    return _case((f"{x} <= {num(toe)}", f"({x} / {num(slope)})"), other=f"exp(ln(greatest(({x} + {num(offset)}) / {num(1 + offset)}, {num(1e-300)})) * {num(power)})")


#: The perceptual quantizer.
PQ = (2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32)


def pq(x: str) -> str:
    """The perceptual quantizer; 1 stands for 100 nits."""
    m1, m2, c1, c2, c3 = PQ
    p = f"power(greatest({x}, 0) / 100, {num(m1)})"
    return _case((f"{x} = 0", num(0)), other=f"power(({num(c1)} + {num(c2)} * {p}) / (1 + {num(c3)} * {p}), {num(m2)})")


def pq_inverse(x: str) -> str:
    m1, m2, c1, c2, c3 = PQ
    p = f"power(greatest({x}, 0), {num(1 / m2)})"
    return _case((f"{x} = 0", num(0)), other=f"(100 * power(greatest({p} - {num(c1)}, 0) / ({num(c2)} - {num(c3)} * {p}), {num(1 / m1)}))")


#: Hybrid log-gamma.
HLG = (0.17883277, 0.28466892, 0.55991072953)


def hlg(x: str) -> str:
    """Hybrid log-gamma; 1 stands for 100 nits of 1000."""
    a, b, c = HLG
    e = clamp(f"({x} / 10)", num(0), num(1))
    return _case((f"{x} = 0", num(0)), (f"{e} <= {num(1 / 12)}", f"sqrt(3 * {e})"), other=f"({num(a)} * ln(greatest(12 * {e} - {num(b)}, {num(1e-300)})) + {num(c)})")


def hlg_inverse(x: str) -> str:
    a, b, c = HLG
    return _case((f"{x} = 0", num(0)), (f"{x} <= {num(0.5)}", f"(10 * {x} * {x} / 3)"), other=f"(10 * (exp(({x} - {num(c)}) / {num(a)}) + {num(b)}) / 12)")


def acescct(x: str) -> str:
    return _case((f"{x} <= {num(0.078125)}", f"({num(10.5402377416545)} * {x} + {num(0.0729055341958355)})"), other=f"((ln({x}) / {num(log(2))} + {num(9.72)}) / {num(17.52)})")


def acescct_inverse(x: str) -> str:
    return _case((f"{x} <= {num(0.155251141552511)}", f"(({x} - {num(0.0729055341958355)}) / {num(10.5402377416545)})"), other=f"power({num(2)}, {x} * {num(17.52)} - {num(9.72)})")


def lin2log(x: str, base: float) -> str:
    return f"(ln({x} * {num(base - 1)} + 1) / {num(log(base))})"


def log2lin(x: str, base: float) -> str:
    return f"((power({num(base)}, {x}) - 1) / {num(base - 1)})"


def hue_between(h1: str, h2: str, balance: str) -> str:
    """Hue in turns between two hues along the shorter arc; balance 0 gives the first."""
    d = f"({h2} - {h1})"
    turn = _case((f"{d} > {num(0.5)}", f"({d} - 1)"), (f"{d} < {num(-0.5)}", f"({d} + 1)"), other=d)
    out = f"({h1} + {balance} * {turn})"
    return f"({out} - floor({out}))"


def most_saturated(r: str, g: str, b: str) -> tuple[str, str, str]:
    """The hue at full saturation: the largest channel 65535, the smallest as 65535, the middle in proportion of its
    distance to the smallest.  Greys become white."""
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    one = num(65535)
    return tuple(_case((f"{top} = 0", num(0)), (f"{c} = {top}", one), (f"{c} = {low}", one), other=f"({one} / {top} * ({c} - {low}))") for c in (r, g, b))


def highlight_luminance(r: str, g: str, b: str, top: str) -> tuple[str, str, str]:
    """Clipped colours keep the lightness of the unclipped ones and their hue, with chroma scaled to the clipped ones'."""
    lo = [f"least({c}, {top})" for c in (r, g, b)]
    light = f"(({r} + {g} + {b}) / 3)"
    c1, c2 = f"({num(sqrt(3))} * ({r} - {g}))", f"(2 * {b} - {r} - {g})"
    k1, k2 = f"({num(sqrt(3))} * ({lo[0]} - {lo[1]}))", f"(2 * {lo[2]} - {lo[0]} - {lo[1]})"
    ratio = _case((f"{r} <> {g} and {g} <> {b}", f"sqrt(({k1} * {k1} + {k2} * {k2}) / ({c1} * {c1} + {c2} * {c2}))"), other=num(1))
    a, h = f"({ratio} * {c1})", f"({ratio} * {c2})"
    out = (f"({light} - {h} / 6 + {a} / {num(sqrt(12))})", f"({light} - {h} / 6 - {a} / {num(sqrt(12))})", f"({light} + {h} / 3)")
    hit = f"({r} > {top} or {g} > {top} or {b} > {top})"
    return tuple(_case((hit, o), other=c) for o, c in zip(out, (r, g, b), strict=True))


def highlight_lab(r: str, g: str, b: str, top: str, to_xyz: Matrix = XYZ_FROM_SRGB, from_xyz: Matrix = SRGB_FROM_XYZ) -> list[dict[str, str]]:
    """Stages of columns to out_r, out_g, out_b: clipped colours keep the lightness of the unclipped ones and take the hue and
    chroma (a and b of Lab) of the clipped ones.  Intermediates begin with ``k_``."""
    cut = [f"least({c}, {top})" for c in (r, g, b)]
    hit = f"({r} > {top} or {g} > {top} or {b} > {top})"
    back = lambda t: f"(65535 * {_lab_inverse(t)})"
    return [
        {"k_y": row3(to_xyz[1], r, g, b), **{f"k_c{n}": row3(row, *cut) for n, row in zip("xyz", to_xyz, strict=True)}},
        {"k_f": _lab_f("(k_y / 65535)"), **{f"k_f{n}": _lab_f(f"(k_c{n} / 65535)") for n in "xyz"}},
        {"k_x": back("(k_f + k_fx - k_fy)"), "k_z": back("(k_f - k_fy + k_fz)")},
        {f"out_{n}": _case((hit, row3(row, "k_x", "k_y", "k_z")), other=c) for n, c, row in zip("rgb", (r, g, b), from_xyz, strict=True)},
    ]


def lab_grid(l: str, a: str, b: str, a_low: float, a_high: float, b_low: float, b_high: float) -> tuple[str, str]:
    """Toning: a and b move linearly with lightness between a shadow and a highlight offset."""
    share = f"({l} / {num(32768)})"
    return f"({a} + {share} * {num(a_high - a_low)} + {num(a_low)})", f"({b} + {share} * {num(b_high - b_low)} + {num(b_low)})"


def trapezoid(x: str, low: float, low_full: float, high_full: float, high: float) -> str:
    """Membership: 0 outside, 1 on the plateau, linear between."""
    return _case((f"{x} <= {num(low)} or {x} >= {num(high)}", num(0)), (f"{x} < {num(low_full)}", f"(({x} - {num(low)}) / {num(max(low_full - low, 1e-30))})"), (f"{x} > {num(high_full)}", f"(({num(high)} - {x}) / {num(max(high - high_full, 1e-30))})"), other=num(1))


def soft_light(x: str, strength: float) -> str:
    """A value in 0..1 blended with its own soft light, which is taken on the sRGB curve; values outside pass through."""
    v = gamma(x)
    return _case((f"{x} < 0 or {x} > 1", x), other=mix(num(strength), gamma_inverse(f"({v} * {v} * (3 - 2 * {v}))"), x))


def planck(wavelength_nm: str, temperature: str) -> str:
    """Spectral radiance of a black body."""
    metres = f"({wavelength_nm} * {num(1e-9)})"
    return f"({num(3.7417715247e-16)} * power({metres}, -5) / (exp({num(1.438786e-2)} / ({metres} * {temperature})) - 1))"


def film_negative(v: str, median: str, exponent: float, target: float = 65535 / 24) -> str:
    """A power law normalised so that the channel's median lands on ``target``."""
    return f"({num(target)} * power(greatest({v}, 1) / greatest({median}, 1), {num(-exponent)}))"


def rgb_scaled_by(r: str, g: str, b: str, old: str, new: str) -> tuple[str, str, str]:
    """Channels scaled by a change of luminance; black stays black."""
    return tuple(_case((f"{old} <= {num(0.00001)}", c), other=f"({c} * {new} / {old})") for c in (r, g, b))


def blend_factor(contrast: str, threshold: str) -> str:
    """A sigmoid of local contrast with one half at the threshold."""
    x = f"(-16 + 16 / {threshold} * {contrast})"
    return f"({num(0.5)} * (1 + {x} / sqrt(1 + {x} * {x})))"


def jzazbz(x: str, y: str, z: str) -> tuple[str, str, str]:
    """Jz, az, bz of absolute XYZ at D65 (fixed values: the published matrices and constants)."""
    b, g, d, d0 = 1.15, 0.66, -0.56, 1.6295499532821566e-11
    c1, c2, c3, n, p = 3424 / 4096, 2413 / 128, 2392 / 128, 2610 / 16384, 1.7 * 2523 / 32
    xp, yp = f"({num(b)} * {x} - {num(b - 1)} * {z})", f"({num(g)} * {y} - {num(g - 1)} * {x})"
    lms = matrix3(((0.41478972, 0.579999, 0.0146480), (-0.2015100, 1.120649, 0.0531008), (-0.0166008, 0.264800, 0.6684799)), xp, yp, z)

    def quantised(v: str) -> str:
        t = f"power(greatest({v}, 0) / 10000, {num(n)})"
        return f"power(({num(c1)} + {num(c2)} * {t}) / (1 + {num(c3)} * {t}), {num(p)})"

    i, a, bz = matrix3(((0.5, 0.5, 0.0), (3.524000, -4.066708, 0.542708), (0.199076, 1.096799, -1.295875)), *map(quantised, lms))
    return f"({num(1 + d)} * {i} / (1 + {num(d)} * {i}) - {num(d0)})", a, bz
