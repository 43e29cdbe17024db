"""Queries of whole developments: chains of stages, the appearance model's tone curve, clipped colours in Lab, curve kinds, and
camera raw files written and read back.  Their SQL is typed out by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import curves
from ..functions import formulas as S
from ..operators import chain as C
from ..sources import raw
from . import tables as T
from .registry import query, rounded, sql_rounded
from .scratch import scratch_root

PX = T.sql(T.PIXELS)


def px(spark, sf_dir):
    return T.table(spark, sf_dir, T.PIXELS)


def _read(f: str, u: str, n: int = 255) -> str:
    """A formula ``f`` of {t}, cut into a table of n + 1 entries and read at u with straight lines between them."""
    u = f"(greatest(0e0, least(1e0, {u})) * {n})"
    at = lambda k: f.format(t=f"({k} / {n}e0)")
    return f"({at(f'floor({u})')} + ({u} - floor({u})) * ({at(f'least({n}, floor({u}) + 1)')} - {at(f'floor({u})')}))"


_FRGB = "3.1338561e0 * x - 1.6168667e0 * y - 0.4906146e0 * z as r, -0.9787684e0 * x + 1.9161415e0 * y + 0.033454e0 * z as g, 0.0719453e0 * x - 0.2289914e0 * y + 1.4052427e0 * z as b"
_XYZ = "0.4360747e0 * r + 0.3850649e0 * g + 0.1430804e0 * b as x, 0.2225045e0 * r + 0.7168786e0 * g + 0.0606169e0 * b as y, 0.0139322e0 * r + 0.0971045e0 * g + 0.7141733e0 * b as z"
_F = "(case when {0} > 216 / 24389e0 then cbrt({0}) else (24389 / 27e0 * {0} + 16) / 116 end)"
_BACK = "(case when {0} > 24 / 116e0 then {0} * {0} * {0} else ({0} - 16 / 116e0) * 108 / 841e0 end)"
_LIGHT = "(case when {0} > 216 / 24389e0 then 116 * cbrt({0}) - 16 else 24389 / 27e0 * {0} end)"
_HUE = "(case when h >= 2 then 0.1489e0 * h - 0.04785e0 when h >= 1.4e0 then 0.2666e0 * h - 0.2833e0 when h >= 0.6e0 then 0.1125e0 * h - 0.0675e0 when h >= 0 then 0.11666e0 * h + 0.93e0 when h >= -0.1e0 then 0.1e0 * h + 0.93e0 when h >= -0.9e0 then 0.2125e0 * h + 0.94125e0 when h >= -2.3e0 then 0.12143e0 * h + 0.85928e0 when h >= -2.8e0 then 0.16e0 * h + 0.948e0 else 0.23419e0 * h + 1.1557e0 end)"

STAGES = [
    C.Mix(((0.8, 0.15, 0.05), (0.1, 0.85, 0.05), (0.0, 0.2, 0.8))),
    C.Exposure(0.5, 0.01),
    C.Tone(lambda t: t * (1.4 - 0.4 * t)),
    C.HueSaturationValue(saturation=20, sat=lambda h: 0.4 + 0.3 * h, value=lambda h: 0.55 - 0.2 * h),
    C.LabCurves(lightness=lambda t: t * t * (3 - 2 * t), lightness_by_hue=lambda h: 0.4 + 0.2 * h, chroma_by_hue=lambda h: 0.55 - 0.1 * h, hue_by_hue=lambda h: 0.45 + 0.1 * h, chroma=15, chroma_by_lightness=lambda t: t * (1.2 - 0.2 * t), chroma_by_chroma=lambda t: t * (1.5 - 0.5 * t), lightness_by_chroma=lambda t: t * (0.9 + 0.1 * t)),
    C.BlackWhite((0.3, 0.5, 0.2), where="frame % 2 = 1"),
]

_TONE = _read("({t} * (1.4e0 - 0.4e0 * {t}))", "{c} / 65535")
_SIX = (
    f"""with s1 as (select frame, y as py, x as px, 0.8e0 * r + 0.15e0 * g + 0.05e0 * b as r, 0.1e0 * r + 0.85e0 * g + 0.05e0 * b as g, 0.2e0 * g + 0.8e0 * b as b from {PX}),
s2 as (select frame, py, px, (r - 655.35e0) * sqrt(2e0) / 0.99e0 as r, (g - 655.35e0) * sqrt(2e0) / 0.99e0 as g, (b - 655.35e0) * sqrt(2e0) / 0.99e0 as b from s1),
s3 as (select frame, py, px, """
    + ", ".join(f"case when r between 0 and 65535 or g between 0 and 65535 or b between 0 and 65535 then 65535 * {_TONE.format(c=c)} else {c} end as {c}" for c in "rgb")
    + f""" from s2),
h0 as (select frame, py, px, r / 65535 as r, g / 65535 as g, b / 65535 as b, greatest(r, g, b) / 65535 as top, greatest(r, g, b) / 65535 - least(r, g, b) / 65535 as d from s3),
h1 as (select frame, py, px, top as v, case when abs(d) < 1e-5 then 0 else d / top end as s, case when abs(d) < 1e-5 then 0 else (case when r = top then (g - b) / d when g = top then 2 + (b - r) / d else 4 + (r - g) / d end) / 6 end as h from h0),
h2 as (select * replace (greatest(0, 0.2e0 * (1 - (1 - least(s, 1)) ** 4) + 0.8e0 * s) as s, case when h < 0 then h + 1 else h end as h) from h1),
h3 as (select *, 2 * ({_read('(0.4e0 + 0.3e0 * {t})', 'h')} - 0.5e0) as p from h2),
h4 as (select * replace (case when p > 1e-5 then greatest(0, (1 - p) * s + p * (1 - (1 - least(s, 1)) ** 2)) when p < -1e-5 then s * (1 + p) else s end as s) from h3),
h5 as (select * replace (({_read('(0.55e0 - 0.2e0 * {t})', 'h')} - 0.5e0) * (1 - (1 - least(s, 1)) ** 4) as p) from h4),
h6 as (select * replace (case when p > 1e-5 then greatest(0, (1 - p) * v + p * (1 - (1 - least(v, 1)) ** 2)) when p < -1e-5 then v * (1 + p) else v end as v) from h5),
h7 as (select frame, py, px, v, floor(h * 6) as k, v * (1 - s) as lo, v * (1 - s * (h * 6 - floor(h * 6))) as fall, v * (1 - s * (1 - (h * 6 - floor(h * 6)))) as rise from h6),
s4 as (select frame, py, px, 65535 * case k when 1 then fall when 2 then lo when 3 then lo when 4 then rise else v end as r, 65535 * case k when 1 then v when 2 then v when 3 then fall when 4 then lo when 5 then lo else rise end as g, 65535 * case k when 1 then lo when 2 then rise when 3 then v when 4 then v when 5 then fall else lo end as b from h7),
c1 as (select frame, py, px, {_XYZ} from s4),
c2 as (select frame, py, px, {_LIGHT.format('(y / 65535)')} as l0, 500 * ({_F.format('(x / (65535 * 0.9642e0))')} - {_F.format('(y / 65535)')}) as a, 200 * ({_F.format('(y / 65535)')} - {_F.format('(z / (65535 * 0.8249e0))')}) as c from c1),
c3 as (select *, 100 * {_read('({t} * {t} * (3 - 2 * {t}))', 'l0 / 100')} as l, sqrt(a * a + c * c) as c0, atan2(c, a) as h from c2),
c4 as (select *, {_HUE} - floor({_HUE}) as hp from c3),
c5 as (select *, {_read('(0.4e0 + 0.2e0 * {t})', 'hp')} - 0.5e0 as w0, 1 + 2 * ({_read('(0.55e0 - 0.1e0 * {t})', 'hp')} - 0.5e0) as f from c4),
c6 as (select *, case when w0 > 0 then w0 * c0 / 20 else w0 * c0 / 40 end as w from c5),
c7 as (select * replace (case when w > 0 then 100 * ((1 - w) * l / 100 + w * (1 - (1 - least(l / 100, 1)) ** 4)) else l * (1 + 1.9e0 * w) end as l, h + 1.7e0 * ({_read('(0.45e0 + 0.1e0 * {t})', 'hp')} - 0.5e0) as h, f * 1.15e0 * case when l0 > 0 then {_read('({t} * (1.2e0 - 0.2e0 * {t}))', 'l0 / 100')} * 100 / l0 else 1 end as f) from c6),
c8 as (select *, 2 * sqrt((f * c0 * 327.68e0) ** 2 + 0.001e0) as q from c7),
c9 as (select * replace (f * {_read('({t} * (1.5e0 - 0.5e0 * {t}))', 'q / 65535')} * 65535 / q as f) from c8),
c10 as (select * replace (2 * sqrt((f * c0 * 327.68e0) ** 2 + 0.001e0) as q) from c9),
c11 as (select * replace (l * (1 + 0.25e0 * least(c0 / 50, 1) ** 2 * ({_read('({t} * (0.9e0 + 0.1e0 * {t}))', 'q / 65535')} * 65535 / q - 1)) as l, f * c0 * cos(h) as a, f * c0 * sin(h) as c) from c10),
c12 as (select frame, py, px, l, (l + 16) / 116 as fy, a, c from c11),
c13 as (select frame, py, px, 65535 * 0.9642e0 * {_BACK.format('(fy + a / 500)')} as x, 65535 * case when l > 8 then fy * fy * fy else l * 27 / 24389e0 end as y, 65535 * 0.8249e0 * {_BACK.format('(fy - c / 200)')} as z from c12),
s5 as (select frame, py, px, {_FRGB} from c13),
s6 as (select frame, py as y, px as x, """
    + ", ".join(f"case when frame % 2 = 1 then 0.3e0 * r + 0.5e0 * g + 0.2e0 * b else {c} end as {c}" for c in "rgb")
    + " from s5) select frame, y, x, "
    + ", ".join(f"{sql_rounded(c, 3)} as o_{c}" for c in "rgb")
    + " from s6"
)


@query(_SIX)
def development_chain(spark, sf_dir):
    """Six stages over every pixel in one code generation span; the last one for every other frame."""
    return C.develop(px(spark, sf_dir), STAGES).select("frame", "y", "x", *[rounded(c, 3).alias(f"o_{c}") for c in "rgb"])


# ---- lightness in the appearance model.  Constants typed out: viewing conditions of an average surround at 318.31 cd/m2.

_K = 1 / (5 * 318.31 + 1)
_FL = 0.2 * _K**4 * 5 * 318.31 + 0.1 * (1 - _K**4) ** 2 * (5 * 318.31) ** (1 / 3)


def _model() -> dict[str, float]:
    """Numbers of the model for a D50 white, from its published equations."""
    from math import exp

    n = 0.2
    d = 1 - exp((-318.31 - 42) / 92) / 3.6
    white = (96.42, 100.0, 82.49)
    cat = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834))
    rgb = [sum(a * w for a, w in zip(row, white, strict=True)) for row in cat]
    gain = [d * 100 / v + 1 - d for v in rgb]
    return {"n": n, "nbb": 0.725 * (1 / n) ** 0.2, "z": 1.48 + n**0.5, "gain": gain, "cat": cat, "rgb": rgb}


def _appearance(x: str, y: str, z: str, source: str, p: str) -> str:
    """SELECT of ``source`` with the appearance correlates {p}j, {p}c and {p}h of XYZ (0..100), and all that ``source`` has."""
    m = _model()
    hpe, cat = ((0.38971, 0.68898, -0.07868), (-0.22981, 1.18340, 0.04641), (0.0, 0.0, 1.0)), m["cat"]
    inverse = S.inverse3(cat)
    to_cones = [[sum(hpe[i][k] * inverse[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    squash = lambda v: (400 * (_FL * abs(v) / 100) ** 0.42 / ((_FL * abs(v) / 100) ** 0.42 + 27.13)) + 0.1
    adapted = [g * v for g, v in zip(m["gain"], m["rgb"], strict=True)]
    cones = [squash(sum(a * v for a, v in zip(row, adapted, strict=True))) for row in to_cones]
    aw = (2 * cones[0] + cones[1] + cones[2] / 20 - 0.305) * m["nbb"]
    row = lambda r, a, b, c: f"({r[0]!r}e0 * {a} + ({r[1]!r}e0) * {b} + ({r[2]!r}e0) * {c})".replace("e-05e0", "e-05")
    sq = lambda v: f"(sign({v}) * 400 * (({_FL!r}e0 / 100) * abs({v})) ** 0.42e0 / ((({_FL!r}e0 / 100) * abs({v})) ** 0.42e0 + 27.13e0) + 0.1e0)"
    return f"""(select *, 100 * (greatest({p}l, 0) / {aw!r}e0) ** ({0.69 * m['z']!r}e0) as {p}j, ({50000 / 13 * m['nbb']!r}e0 * 0.25e0 * (cos({p}t + 2) + 3.8e0) * sqrt({p}a * {p}a + {p}b * {p}b) / ({p}ra + {p}ga + 1.05e0 * {p}ba)) ** 0.9e0 * sqrt((greatest({p}l, 0) / {aw!r}e0) ** ({0.69 * m['z']!r}e0)) * {(1.64 - 0.29**0.2) ** 0.73!r}e0 as {p}c, case when {p}t < 0 then {p}t + 2 * pi() else {p}t end * 180 / pi() as {p}h from
(select *, atan2({p}b, {p}a) as {p}t from (select *, {p}ra - 12 * {p}ga / 11 + {p}ba / 11 as {p}a, ({p}ra + {p}ga - 2 * {p}ba) / 9 as {p}b, (2 * {p}ra + {p}ga + {p}ba / 20 - 0.305e0) * {m['nbb']!r}e0 as {p}l from
(select *, {sq(f'{p}r3')} as {p}ra, {sq(f'{p}g3')} as {p}ga, {sq(f'{p}b3')} as {p}ba from (select *, {", ".join(f"{row(r, f'{p}r2', f'{p}g2', f'{p}b2')} as {p}{c}3" for c, r in zip('rgb', to_cones, strict=True))} from
(select *, {", ".join(f"{g!r}e0 * {row(r, x, y, z)} as {p}{c}2" for c, g, r in zip('rgb', m['gain'], cat, strict=True))} from {source}))))))"""


def _perceptual_sql() -> str:
    lift = _read("({t} * (1.3e0 - 0.3e0 * {t}))", "lum / 65535")
    base = f"(select *, case when lum <= 1e-5 then 1 else 65535 * {lift} / lum end as k from (select frame, y as py, x as px, r, g, b, 0.2126729e0 * r + 0.7151521e0 * g + 0.072175e0 * b as lum from {PX}))"
    xyz = [f"({a}e0 * r + {b}e0 * g + {c}e0 * b)" for a, b, c in ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))]
    old = _appearance(*[f"({v} / 655.35e0)" for v in xyz], base, "o")
    new = _appearance(*[f"({v} * k / 655.35e0)" for v in xyz], old, "n")
    # the colour of the model with the new lightness and the old chroma and hue has these correlates again
    values = {"j": "nj", "a": "oc * cos(oh * pi() / 180)", "b": "oc * sin(oh * pi() / 180)"}
    return "select frame, py as y, px as x, " + ", ".join(f"case when oj > 0 and nj > 0 then {sql_rounded(v, 4)} end as {k}" for k, v in values.items()) + f" from {new}"


@query(_perceptual_sql())
def perceptual_tone(spark, sf_dir):
    """The tone curve that keeps chroma and hue: the appearance of its result, which must have the curve's lightness and the
    old chroma and hue (as two coordinates)."""
    done = C.develop(px(spark, sf_dir), [C.Tone(lambda t: t * (1.3 - 0.3 * t), mode="perceptual")])
    at = C.Scratch("m_")
    stage = C.Tone(lambda t: t)
    model = at.renamed([dict(zip(("k_x", "k_y", "k_z"), (f"({e} / 655.35e0)" for e in S.matrix3(S.XYZ_FROM_SRGB, "r", "g", "b")), strict=True)), *C.appearance.ciecam02(stage.viewing, "k_x", "k_y", "k_z")])
    for step in model:
        done = done.withColumns(step)
    turn = F.radians(at("h"))
    shown = {"j": F.col(at("J")), "a": F.col(at("C")) * F.cos(turn), "b": F.col(at("C")) * F.sin(turn)}
    return done.select("frame", "y", "x", *[F.when(F.col(at("J")) > 0, rounded(c, 4)).alias(n) for n, c in shown.items()])


# ---- clipped colours in Lab


@query(
    f"""with a as (select frame, y as py, x as px, r, g, b, least(r, 45000) as cr, least(g, 45000) as cg, least(b, 45000) as cb from {PX}),
f as (select *, (0.2225045e0 * r + 0.7168786e0 * g + 0.0606169e0 * b) / 65535 as yy, (0.4360747e0 * cr + 0.3850649e0 * cg + 0.1430804e0 * cb) / 65535 as x, (0.2225045e0 * cr + 0.7168786e0 * cg + 0.0606169e0 * cb) / 65535 as y, (0.0139322e0 * cr + 0.0971045e0 * cg + 0.7141733e0 * cb) / 65535 as z from a),
t as (select *, {_F.format('yy')} as fyy, {_F.format('x')} as fx, {_F.format('y')} as fy, {_F.format('z')} as fz from f),
v as (select frame, py, px, r, g, b, 65535 * {_BACK.format('(fyy + fx - fy)')} as x, 65535 * yy as y, 65535 * {_BACK.format('(fyy - fy + fz)')} as z from t),
o as (select frame, py, px, r as r0, g as g0, b as b0, {_FRGB} from v)
select frame, py as y, px as x, """
    + ", ".join(f"{sql_rounded(f'case when r0 > 45000 or g0 > 45000 or b0 > 45000 then {c} else {c}0 end', 1)} as {c}" for c in "rgb")
    + " from o"
)
def highlight_lab(spark, sf_dir):
    """Highlights recovered with the lightness of the unclipped and the chroma of the clipped colour."""
    rows = px(spark, sf_dir)
    for step in S.highlight_lab("r", "g", "b", S.num(45000)):
        rows = rows.withColumns({n: F.expr(e) for n, e in step.items()})
    return rows.select("frame", "y", "x", *[rounded(f"out_{c}", 1).alias(c) for c in "rgb"])


# ---- curve kinds

_HANG, _RISE = "(power({0}, 3) * (2 - {0}))", "(1 - power(1 - {0}, 3) * (1 + {0}))"


def _bent(x: str, low: float, high: float) -> str:
    """The parametric curve's shape, typed out: {low} and {high} weigh hanging and rising halves."""
    two, rest = f"(2 * {x})", f"(2 * {x} - 1)"
    s01 = f"(case when {x} <= 0.5e0 then {_HANG.format(two)} / 2 else 0.5e0 + {_RISE.format(rest)} / 2 end)"
    s10 = f"(case when {x} <= 0.5e0 then {_RISE.format(two)} / 2 else 0.5e0 + {_HANG.format(rest)} / 2 end)"
    return f"({(1 - low) * (1 - high)}e0 * {_HANG.format(x)} + {low * high}e0 * {_RISE.format(x)} + {(1 - low) * high}e0 * {s01} + {low * (1 - high)}e0 * {s10})"


def _parametric_sql() -> str:
    # splits of 1/4, 1/2, 3/4: every power is one; darks -40, lights 30, shadows 50, highlights -60
    whole, centre = _bent("{t}", 0.3, 0.65), _bent("0.5e0", 0.3, 0.65)
    below = f"{centre} * {_bent(f'({whole} / {centre})', 0.75, 0.5)}"
    part = f"(({whole} - {centre}) / (1 - {centre}))"
    above = f"case when {part} < 1e-6 then {whole} else {centre} + (1 - {centre}) * {_bent(part, 0.5, 0.2)} end"
    return f"(case when {{t}} <= 1e-14 then 0e0 when {{t}} < 0.5e0 then {below} else {above} end)"


@query(
    f"select frame, y, x, {sql_rounded(_read('(1.6e0 * {t} * (1 - {t}) + {t} * {t})', 'r / 65535', 63), 6)} as spline, {sql_rounded(_read(_parametric_sql(), 'g / 65535', 63), 6)} as sliders from {PX}"
)
def curve_kinds(spark, sf_dir):
    """A B-spline of three controls and the parametric curve, each as a table of 64 entries."""
    spline = curves.sampled(curves.b_spline([(0, 0), (0.5, 0.8), (1, 1)]), 64)
    sliders = curves.sampled(curves.parametric(highlights=-60, lights=30, darks=-40, shadows=50), 64)
    return px(spark, sf_dir).select("frame", "y", "x", rounded(C.through(spline, F.col("r") / 65535), 6).alias("spline"), rounded(C.through(sliders, F.col("g") / 65535), 6).alias("sliders"))


# ---- camera raw files


@query(f"select frame, y, x, c, cast(floor(v) as bigint) % 16384 as v, 0e0 + 0 as black, 0e0 + 16383 as white from {PX}")
def raw_read(spark, sf_dir):
    """Every frame as a DNG file, lossless JPEG tiles in even and packed samples in odd ones, read back as pixels."""
    path = f"{scratch_root(spark)}/raw-{uuid.uuid4().hex}"
    rows = px(spark, sf_dir).select("frame", "y", "x", (F.floor("v") % 16384).alias("v"))
    for k, lossless in enumerate((True, False)):
        raw.write_raw(rows.where(F.col("frame") % 2 == k), f"{path}/{k}", lossless, tile=(32, 32)).agg(F.sum("bytes")).collect()
    back = raw.read_raw(spark, path)
    return back.select(F.regexp_extract("path", r"(\d+)\.dng$", 1).cast("long").alias("frame"), "y", "x", "c", F.col("v").cast("long").alias("v"), "black", "white")
