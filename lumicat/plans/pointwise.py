"""Queries of colour formulas over every pixel.

The formulas are SQL text (``lumicat.functions.formulas``): one projection, fused by code generation.  ``BY_HAND`` is SQL
typed out apart from them; for the others the SQL checks that both engines agree on every pixel, and unit tests hold some
values against independent ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as S
from . import tables as T
from .registry import query, rounded, sql_rounded

PX = T.sql(T.PIXELS)
_U = {c: f"({c} / 65535e0)" for c in "rgb"}
_XYZ = S.matrix3(S.XYZ_FROM_SRGB, "r", "g", "b")
_LAB = ("(r / 2)", "(g - 32768)", "(b - 32768)")
_HSV = (_U["r"], _U["g"], _U["b"])
_GAMMAS = {k: S.gamma(_U["r"], k) for k in S.GAMMAS}
_INVERSE = {k: S.gamma_inverse(_U["g"], k) for k in S.GAMMAS}


def _names(names: str, values: tuple) -> dict[str, str]:
    return dict(zip(names.split(), values, strict=True))


FORMULAS: dict[str, tuple[int, dict[str, str]]] = {
    "lum": (4, {"l": S.luminance("r", "g", "b")}),
    "rgb_to_hsv": (6, _names("h s v", S.hsv("r", "g", "b"))),
    "hsv_to_rgb": (4, _names("r g b", S.rgb_from_hsv(*_HSV))),
    "rgb_to_hsl": (6, _names("h s l", S.hsl("r", "g", "b"))),
    "hsl_to_rgb": (4, _names("r g b", S.rgb_from_hsl(*_HSV))),
    "rgb_to_hsv_unit": (6, _names("h s v", S.hsv(*_U.values(), unit=True))),
    "matrix3": (4, _names("x y z", _XYZ)),
    "matrix3_inverse": (4, _names("r g b", S.matrix3(S.inverse3(S.XYZ_FROM_SRGB), *_XYZ))),
    "xyz_to_lab": (4, _names("l a b", S.lab_from_xyz(*_XYZ))),
    "lab_to_xyz": (4, _names("x y z", S.xyz_from_lab(*_LAB))),
    "lab_to_lch": (6, _names("c h", S.lch_from_lab(*_LAB[1:]))),
    "lch_to_lab": (3, _names("a b", S.lab_from_lch("(r / 500)", "(g / 10000)"))),
    "luv_to_lch": (6, _names("c h", S.lch_from_luv("(r - 32768)", "(g - 32768)"))),
    "lab_to_yuv": (5, _names("y u v", S.yuv_from_lab("(r / 2 + 1)", "(g / 8 - 4096)", "(b / 8 - 4096)"))),
    "xyz_to_oklab": (6, _names("l a b", S.oklab_from_xyz(*_U.values()))),
    "oklab_to_xyz": (6, _names("x y z", S.xyz_from_oklab(_U["r"], f"({_U['g']} - 5e-1)", f"({_U['b']} - 5e-1)"))),
    "gamma_curves": (6, _GAMMAS),
    "gamma_inverse_curves": (6, _INVERSE),
    "gamma_srgb": (6, {"y": S.gamma(_U["b"])}),
    "pq_curve": (6, {"forward": S.pq("(r / 1000)"), "inverse": S.pq_inverse(_U["g"])}),
    "hlg_curve": (6, {"forward": S.hlg("(r / 6000)"), "inverse": S.hlg_inverse(_U["g"])}),
    "acescct_curve": (6, {"forward": S.acescct(f"({_U['r']} + 1e-3)"), "inverse": S.acescct_inverse(_U["g"])}),
    "log_curves": (6, {"log": S.lin2log(_U["r"], 10.0), "lin": S.log2lin(_U["g"], 10.0)}),
    "hue_between": (6, {"h": S.hue_between(_U["r"], _U["g"], _U["b"])}),
    "most_saturated": (4, _names("r g b", S.most_saturated("r", "g", "b"))),
    "highlight_luminance": (4, _names("r g b", S.highlight_luminance("r", "g", "b", S.num(50000)))),
    "lab_grid": (4, _names("a b", S.lab_grid(*_LAB, -900.0, 1200.0, 300.0, -700.0))),
    "threshold_weight": (6, {"w": S.trapezoid("r", 5000.0, 20000.0, 40000.0, 60000.0)}),
    "channel_mix": (4, _names("r g b", S.matrix3(((0.7, 0.2, 0.1), (-0.1, 1.2, -0.1), (0.05, 0.15, 0.8)), "r", "g", "b"))),
    "soft_light": (6, {"v": S.soft_light(_U["r"], 0.6)}),
    "film_negative": (3, {"v": S.film_negative("r", S.num(20000), 1.36)}),
    "clamp_mix": (4, {"clamped": S.clamp("r", S.num(1000), S.num(60000)), "mixed": S.mix(_U["r"], "g", "b")}),
    "blend_factor": (6, {"w": S.blend_factor(_U["r"], S.num(0.2))}),
    "luminance_curve": (4, _names("r g b", S.rgb_scaled_by("r", "g", "b", S.luminance("r", "g", "b"), f"(65535 * {S.soft_light(f'({S.luminance("r", "g", "b")} / 65535e0)', 0.5)})"))),
    "jzazbz": (8, _names("j a b", S.jzazbz("(r / 100)", "(g / 100)", "(b / 100)"))),
}


_GAMMA = "(case when {0} <= 0.00304e0 then 12.9231e0 * {0} else 1.055e0 * power({0}, 1 / 2.4e0) - 0.055e0 end)"
_INVERSE_GAMMA = "(case when {0} <= 0.039286e0 then {0} / 12.9231e0 else power(({0} + 0.055e0) / 1.055e0, 2.4e0) end)"
_LIGHT = "(case when {0} <= 216 / 24389e0 then (24389 / 27e0 * {0} + 16) / 116 else power({0}, 1 / 3e0) end)"
_TO_XYZ = "select frame, y, x, 0.4360747e0 * r + 0.3850649e0 * g + 0.1430804e0 * b as cx, 0.2225045e0 * r + 0.7168786e0 * g + 0.0606169e0 * b as cy, 0.0139322e0 * r + 0.0971045e0 * g + 0.7141733e0 * b as cz from {px}"

#: Query -> (FROM clause, columns): constants and steps typed out, nothing from the formulas.
BY_HAND: dict[str, tuple[str, dict[str, str]]] = {
    "lum": ("{px}", {"l": "0.2126729e0 * r + 0.7151521e0 * g + 0.072175e0 * b"}),
    "gamma_srgb": ("(select frame, y, x, b / 65535e0 as u from {px})", {"y": _GAMMA.format("u")}),
    "matrix3": (f"({_TO_XYZ})", {"x": "cx", "y": "cy", "z": "cz"}),
    "xyz_to_lab": (
        f"(select frame, y, x, {_LIGHT.format('(cx / (65535 * 0.9642e0))')} as fx, {_LIGHT.format('(cy / 65535e0)')} as fy, {_LIGHT.format('(cz / (65535 * 0.8249e0))')} as fz from ({_TO_XYZ}))",
        {"l": "327.68e0 * (116 * fy - 16)", "a": "327.68e0 * 500 * (fx - fy)", "b": "327.68e0 * 200 * (fy - fz)"},
    ),
    "lab_to_lch": ("(select frame, y, x, g - 32768 as p, b - 32768 as q from {px})", {"c": "sqrt(p ** 2 + q ** 2) / 327.68e0", "h": "atan2(q, p)"}),
    "rgb_to_hsv": (
        "(select *, top - low as d from (select frame, y, x, r / 65535e0 as r, g / 65535e0 as g, b / 65535e0 as b, greatest(r, g, b) / 65535e0 as top, least(r, g, b) / 65535e0 as low from {px}))",
        {
            "h": "case when d < 1e-5 then 0 when r = top and g < b then 1 + (g - b) / (6 * d) when r = top then (g - b) / (6 * d) when g = top then 1 / 3e0 + (b - r) / (6 * d) else 2 / 3e0 + (r - g) / (6 * d) end",
            "s": "case when d < 1e-5 then 0 else d / top end",
            "v": "top",
        },
    ),
    "soft_light": (
        f"(select *, {_GAMMA.format('u')} as v from (select frame, y, x, r / 65535e0 as u from {{px}}))",
        {"v": f"0.6e0 * {_INVERSE_GAMMA.format('(3 * v ** 2 - 2 * v ** 3)')} + 0.4e0 * u"},
    ),
    "luminance_curve": (
        f"(select *, case when l <= 0.00001e0 then 1 else (0.5e0 * {_INVERSE_GAMMA.format('(3 * q ** 2 - 2 * q ** 3)')} + 0.5e0 * l / 65535) * 65535 / l end as k from (select *, {_GAMMA.format('(l / 65535)')} as q from (select *, 0.2126729e0 * r + 0.7151521e0 * g + 0.072175e0 * b as l from {{px}})))",
        {"r": "r * k", "g": "g * k", "b": "b * k"},
    ),
    "channel_mix": ("{px}", {"r": "0.7e0 * r + 0.2e0 * g + 0.1e0 * b", "g": "1.2e0 * g - 0.1e0 * r - 0.1e0 * b", "b": "0.05e0 * r + 0.15e0 * g + 0.8e0 * b"}),
    "threshold_weight": ("{px}", {"w": "greatest(0, least(1, (r - 5000) / 15000e0, (60000 - r) / 20000e0))"}),
    "clamp_mix": ("{px}", {"clamped": "case when r < 1000 then 1000 when r > 60000 then 60000 else r end", "mixed": "r / 65535e0 * g + (1 - r / 65535e0) * b"}),
    "film_negative": ("{px}", {"v": "65535 / 24e0 * power(20000 / greatest(r, 1), 1.36e0)"}),
    "log_curves": ("(select frame, y, x, r / 65535e0 as u, g / 65535e0 as w from {px})", {"log": "log10(9 * u + 1)", "lin": "(10e0 ** w - 1) / 9"}),
    "lch_to_lab": ("{px}", {"a": "327.68e0 * r / 500 * cos(g / 10000)", "b": "327.68e0 * r / 500 * sin(g / 10000)"}),
    "blend_factor": ("(select frame, y, x, 16 * (r / 65535e0 / 0.2e0 - 1) as t from {px})", {"w": "0.5e0 + 0.5e0 * t / sqrt(1 + t ** 2)"}),
}


def _register(name: str, digits: int, columns: dict[str, str]) -> None:
    def run(spark, sf_dir):
        return T.table(spark, sf_dir, T.PIXELS).select("frame", "y", "x", *[rounded(F.expr(e), digits).alias(f"o_{c}") for c, e in columns.items()])

    source, said = BY_HAND.get(name, ("{px}", columns))
    body = ", ".join(f"{sql_rounded(e, digits)} as o_{c}" for c, e in said.items())
    query(f"select frame, y, x, {body} from {source.replace('{px}', PX)}", name)(run)


for _name, (_digits, _columns) in FORMULAS.items():
    _register(_name, _digits, _columns)
