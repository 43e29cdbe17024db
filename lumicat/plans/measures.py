"""Queries of scopes, matched curves, position-dependent gains and table lookups."""

from __future__ import annotations

from math import cos, hypot, radians, sin

from pyspark.sql import functions as F

from ..functions import curves
from ..functions import formulas as S
from ..operators import geometry as G
from ..operators import histogram as H
from . import tables as T
from .raster import _HIST8, HEIGHT, PX, WIDTH, _hist8, px
from .registry import query, rounded, sql_rounded

_LAB = S.lab_from_xyz(*S.matrix3(S.XYZ_FROM_SRGB, "r", "g", "b"))


@query(f"select frame, channel, bin >> 3 as bin, cast(count(*) * 4 as bigint) as n from (select frame, unnest(['r', 'g', 'b']) as channel, cast(least(greatest(trunc(unnest([r * 1.2e0, g, b * 1.4e0])), 0), 65535) as bigint) as bin from {PX}) group by 1, 2, 3")
def auto_exposure_histogram(spark, sf_dir):
    gains = {"r": 1.2, "g": 1.0, "b": 1.4}
    h = H.histogram(px(spark, sf_dir), {c: F.col(c) * g for c, g in gains.items()}, weight=4)
    return H.rebin(h, 3)


@query(f"""with l as (select frame, {_LAB[0]} as l, sqrt({_LAB[1]} * {_LAB[1]} + {_LAB[2]} * {_LAB[2]}) as c, r, g, b from {PX} where x between 5 and 44 and y between 5 and 54)
select frame, channel, bin, count(*) as n from (select frame, unnest(['chroma', 'l', 'r', 'g', 'b']) as channel, cast(least(greatest(trunc(unnest([c / 188, l / 128, r / 256, g / 256, b / 256])), 0), 255) as bigint) as bin from l) group by 1, 2, 3""")
def lrgb_histograms(spark, sf_dir):
    rows = px(spark, sf_dir).where("x between 5 and 44 and y between 5 and 54")
    rows = rows.select("frame", "r", "g", "b", *[F.expr(e).alias(n) for n, e in zip(("lab_l", "lab_a", "lab_b"), _LAB, strict=True)])
    chroma = F.sqrt(F.col("lab_a") * F.col("lab_a") + F.col("lab_b") * F.col("lab_b"))
    return H.histogram(rows, {"chroma": chroma / 188, "l": F.col("lab_l") / 128, **{c: F.col(c) / 256 for c in "rgb"}}, 1, 0, 255)


_H, _S, _ = S.hsv("r", "g", "b")


@query(f"""with p as (select frame, 64 + 63.5e0 * s * cos({S.num(2 * 3.141592653589793)} * h) as cx, 64 + 63.5e0 * s * sin({S.num(2 * 3.141592653589793)} * h) as cy from (select frame, {_H} as h, {_S} as s from {PX}))
select frame, cast(floor(cy) as bigint) as row, cast(floor(cx) as bigint) as col, count(*) as n from p group by 1, 2, 3""")
def vectorscope_polar(spark, sf_dir):
    rows = px(spark, sf_dir).select("frame", F.expr(_H).alias("h"), F.expr(_S).alias("s"))
    angle = 2 * 3.141592653589793 * F.col("h")
    return H.histogram2d(rows, 64 + 63.5 * F.col("s") * F.sin(angle), 64 + 63.5 * F.col("s") * F.cos(angle), 128)


_U, _V = cos(radians(30)), sin(radians(30))
_BAND = 0.25 * hypot(WIDTH, HEIGHT)


@query(f"""with t as (select frame, y, x, v, least(greatest(((x - {S.num(WIDTH * 0.5)}) * {S.num(-_V)} + (y - {S.num(HEIGHT * 0.5)}) * {S.num(_U)}) / {S.num(_BAND)} + 0.5e0, 0), 1) as t from {PX})
select frame, y, x, {sql_rounded('v * power(2e0, -1.5e0 * t * t * (3 - 2 * t))', 3)} as v from t""")
def gradient_gain(spark, sf_dir):
    gain = G.gradient_gain(F.col("x"), F.col("y"), WIDTH, HEIGHT, 30.0, 25.0, 1.5)
    return px(spark, sf_dir).select("frame", "y", "x", rounded(F.col("v") * gain, 3).alias("v"))


@query(f"""with d as (select frame, y, x, v, power(power(abs(2 * x / {S.num(WIDTH)} - 1), 7e0) + power(abs(2 * y / {S.num(HEIGHT)} - 1), 7e0), {S.num(1 / 7)}) as d from {PX}), t as (select *, least(greatest((d - 0.6e0) / 0.4e0, 0), 1) as t from d)
select frame, y, x, {sql_rounded('v * power(2e0, -0.8e0 * t * t * (3 - 2 * t))', 3)} as v from t""")
def post_crop_vignette(spark, sf_dir):
    gain = G.vignette_gain(F.col("x"), F.col("y"), WIDTH, HEIGHT, 0.8, 0.4, 0.5)
    return px(spark, sf_dir).select("frame", "y", "x", rounded(F.col("v") * gain, 3).alias("v"))


@query(f"""with n as (select frame, y, x, (x - {S.num(WIDTH / 2)}) / 60e0 as u, (y - {S.num(HEIGHT / 2)}) / 60e0 as w from {PX}), r as (select *, u * u + w * w as r2 from n),
k as (select *, 1 + r2 * (0.1e0 + r2 * (-0.05e0 + r2 * 0.02e0)) as radial, 2 * (0.002e0 * u + 0.001e0 * w) as common from r)
select frame, y, x, {sql_rounded(f'(u * (radial + common) + 0.002e0 * r2) * 60 + {S.num(WIDTH / 2)}', 6)} as source_x, {sql_rounded(f'(w * (radial + common) + 0.001e0 * r2) * 60 + {S.num(HEIGHT / 2)}', 6)} as source_y from k""")
def lens_distortion(spark, sf_dir):
    sx, sy = G.distort(F.col("x"), F.col("y"), WIDTH, HEIGHT, (0.1, -0.05, 0.02), (0.001, 0.002))
    return px(spark, sf_dir).select("frame", "y", "x", rounded(sx, 6).alias("source_x"), rounded(sy, 6).alias("source_y"))


_CUBE = [((r / 2) ** 0.9, (g / 2) ** 1.1, (b + r) / 4) for b in range(3) for g in range(3) for r in range(3)]
_PLANES = ["[" + ", ".join(S.num(row[c]) for row in _CUBE) + "]" for c in range(3)]


def _corner(plane: str) -> str:
    parts = []
    for k in range(8):
        bits = [(k >> i) & 1 for i in range(3)]
        w = " * ".join(f"t{i}" if bit else f"(1 - t{i})" for i, bit in enumerate(bits))
        parts.append(f"{w} * ({plane})[1 + (k0 + {bits[0]}) + (k1 + {bits[1]}) * 3 + (k2 + {bits[2]}) * 9]")
    return " + ".join(parts)


@query(f"""with a as (select frame, y, x, r / 65535e0 * 2 as p0, g / 65535e0 * 2 as p1, b / 65535e0 * 2 as p2 from {PX}), k as (select *, {', '.join(f'cast(least(floor(p{i}), 1) as bigint) as k{i}' for i in range(3))} from a), t as (select *, {', '.join(f'p{i} - k{i} as t{i}' for i in range(3))} from k)
select frame, y, x, {', '.join(sql_rounded(_corner(p), 6) + f' as {c}' for c, p in zip('rgb', _PLANES, strict=True))} from t""")
def cube_lookup(spark, sf_dir):
    rows = px(spark, sf_dir).select("frame", "y", "x", *[(F.col(c) / 65535).alias(c) for c in "rgb"])
    out = curves.cube_lookup(F.col("r"), F.col("g"), F.col("b"), _CUBE, 3)
    return rows.select("frame", "y", "x", *[rounded(o, 6).alias(c) for o, c in zip(out, "rgb", strict=True)])


@query(f"select frame, {', '.join(f'quantile_cont({c}, 0.5) as {c}' for c in 'rgb')} from {PX} where x between 5 and 44 and y between 6 and 53 group by frame")
def channel_medians(spark, sf_dir):
    return H.channel_medians(px(spark, sf_dir), 0.1, WIDTH, HEIGHT)


@query(f"""with m as (select frame, channel, {sql_rounded('sqrt(avg(power(bin - 128, 2) * n))', 6)} as mad from {_HIST8} group by 1, 2) select frame, {sql_rounded('sum(mad * mad)', 3)} as total, {sql_rounded('max(mad * mad)', 3)} as most from m group by frame""")
def noise_residual(spark, sf_dir):
    m = _hist8(spark, sf_dir).groupBy("frame", "channel").agg(rounded(F.sqrt(F.avg(F.pow(F.col("bin") - 128, 2) * F.col("n"))), 6).alias("mad"))
    return H.noise_residual(m, "frame").select("frame", rounded("total", 3).alias("total"), rounded("most", 3).alias("most"))


# places of the seven inner points: the nearest of 256 bins to each eighth
@query(
    f"""with c as (select frame, channel, bin, sum(n) over (partition by frame, channel order by bin) as cum from {_HIST8}),
m as (select s.frame, s.bin, arg_min(t.bin, (abs(s.cum - t.cum), -t.cum, t.bin)) as matched from c s join c t on t.frame = s.frame and s.channel = 'r' and t.channel = 'l' group by 1, 2),
p as (select frame, k, i from (select distinct frame from m where matched > 0) cross join (select unnest([1, 2, 3, 4, 5, 6, 7]) as k, unnest([32, 64, 96, 128, 159, 191, 223]) as i)),
v as (select p.frame, p.k, any_value(p.i) as i, coalesce(arg_max(matched, bin) filter (matched > 0 and bin <= p.i), 0) as v from p join m on m.frame = p.frame group by 1, 2),
o as (select frame, k, i / 255e0 as x, least(max(v) over (partition by frame order by k) / 255e0, 1) as y from v
union all select frame, 0, 0e0, 0e0 from (select distinct frame from m) union all select frame, case when frame in (select frame from p) then 8 else 1 end, 1e0, 1e0 from (select distinct frame from m))
select frame, cast(k as int) as k, {sql_rounded('x', 6)} as x, {sql_rounded('y', 6)} as y from o"""
)
def matched_tone_curve(spark, sf_dir):
    """Control points of each frame's curve, a row each."""
    c = H.cumulative(_hist8(spark, sf_dir))
    rows = H.matched_tone_curve(c.where("channel = 'r'"), c.where("channel = 'l'"))
    rows = rows.select("frame", F.posexplode("curve").alias("k", "p"))
    return rows.select("frame", "k", rounded(F.get("p", 0), 6).alias("x"), rounded(F.get("p", 1), 6).alias("y"))


@query(f"select shot_id, {sql_rounded('log2(iso / 100e0)', 6)} as stops, iso between 200 and 1600 and upper(make) = 'BRAND' as listed from {T.sql(T.SHOTS)}")
def sensitivity_stops(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS)
    return s.select("shot_id", rounded(F.log2(F.col("iso") / 100.0), 6).alias("stops"), (F.col("iso").between(200, 1600) & (F.upper("make") == "BRAND")).alias("listed"))
