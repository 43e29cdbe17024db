"""Queries of tone, repair and tile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves
from ..functions import formulas as S
from ..operators import demosaic as D
from ..operators import detail as K2
from ..operators import exposure as E
from ..operators import frames as FR
from ..operators import geometry as G
from ..operators import histogram as H
from ..operators import mosaics as R
from ..operators import tiles as K
from ..operators import tone as O
from ..operators import window as N
from . import tables as T
from . import tile_sql as Q
from .raster import _HIST, HEIGHT, PX, WIDTH, _box_sql, _hist, _near_sql, px
from .registry import query, rounded, sql_rounded

_DIFF = ", ".join(f"lead({c}, {k}) over (partition by frame, {a} order by {o}) - lag({c}, {k}) over (partition by frame, {a} order by {o}) as {n}{k}" for n, c, a, o in (("dx", "r", "y", "x"), ("dy", "r", "x", "y")) for k in (1, 2))
_CONTRAST = f"(select *, sqrt(dx1 * dx1 + dx2 * dx2 + dy1 * dy1 + dy2 * dy2) * (0.0625e0 / 327.68e0) as k from (select *, {_DIFF} from {PX}))"


@query(f"select frame, y, x, {sql_rounded('coalesce(' + S.blend_factor('k', S.num(8.0)) + ', 0)', 6)} as w from {_CONTRAST}")
def blend_mask(spark, sf_dir):
    return O.blend_mask(px(spark, sf_dir), "r", "w", 8.0).select("frame", "y", "x", rounded("w", 6).alias("w"))


@query(f"""with k as (select frame, cast(floor(y / 10) as bigint) as ty, cast(floor(x / 10) as bigint) as tx, k / 40 as k from {_CONTRAST} where k is not null and x % 10 between 2 and 7 and y % 10 between 2 and 7),
s as (select frame, ty, tx, c, sum({S.blend_factor('k', '(c / 100e0)')}) as s from k, range(1, 100) t(c) group by 1, 2, 3, 4)
select frame, ty, tx, {sql_rounded('(coalesce(min(c) filter (s <= 0.36e0), 100) + 1) / 100e0', 4)} as threshold from s group by 1, 2, 3""")
def contrast_threshold(spark, sf_dir):
    rows = px(spark, sf_dir).withColumn("r", F.col("r") / 40)
    return O.contrast_threshold(rows, "r", 10).withColumn("threshold", rounded("threshold"))


@query(f"select frame, y, x, {', '.join(sql_rounded(e, 3) + f' as o_{c}' for c, e in zip('rgb', S.highlight_luminance('r', 'g', 'b', S.num(60000)), strict=True))} from {PX}")
def blend_highlights(spark, sf_dir):
    return px(spark, sf_dir).select("frame", "y", "x", *[rounded(F.expr(e), 3).alias(f"o_{c}") for c, e in zip("rgb", S.highlight_luminance("r", "g", "b", S.num(60000)), strict=True)])


@query(Q.BLEND_HIGHLIGHTS)
def blend_highlight_columns(spark, sf_dir):
    made = O.blend_highlights(F.col("r"), F.col("g"), F.col("b"), 60000.0)
    return px(spark, sf_dir).select("frame", "y", "x", *[rounded(e, 3).alias(f"o_{c}") for c, e in zip("rgb", made, strict=True)])


@query(Q.GREEN_LOCAL)
def green_equilibrate_local(spark, sf_dir):
    return N.green_equilibrate_local(px(spark, sf_dir), "v", "o", 0.6).select("frame", "y", "x", rounded("o", 6).alias("v"))


@query(Q.XTRANS_FAST)
def xtrans_fast(spark, sf_dir):
    return D.xtrans_fast(px(spark, sf_dir), "v").select("frame", "y", "x", *[rounded(c, 6).alias(c) for c in "rgb"])


@query(Q.MONO)
def mono_demosaic(spark, sf_dir):
    return D.demosaic(px(spark, sf_dir), "v", "mono").select("frame", "y", "x", "r", "g", "b")


@query(f"""with s as (select frame, y, sum(v) as s from {PX} group by 1, 2), n as (select *, lag(s) over w as a, lead(s) over w as b from s window w as (partition by frame order by y))
select frame, y from n where y in (3, 9, 15, 21, 27, 33) and s > 1.01e0 * greatest(a, b)""")
def line_artefacts(spark, sf_dir):
    return O.line_artefacts(px(spark, sf_dir), "v", [3, 9, 15, 21, 27, 33], 1.01)


@query(f"""with g as (select frame, v, lead(v) over (partition by frame, y order by x) as n from {PX} where c = 1)
select frame, {sql_rounded('sqrt(1 / ln(max(greatest(v, n) / least(v, n)) filter (least(v, n) > 20000 and greatest(v, n) < 400000)))', 6)} as radius from g group by frame""")
def capture_radius(spark, sf_dir):
    return O.capture_radius(px(spark, sf_dir), "v", 20000.0, 400000.0).withColumn("radius", rounded("radius", 6))


@query(f"""select cast(floor(frame / 4) as bigint) as scene, y, x, {', '.join(sql_rounded(f'avg(v) filter (c = {i})') + f' as {k}' for i, k in enumerate('rgb'))}, max(v) filter (c = 1) - min(v) filter (c = 1) > 0.5e0 * avg(v) filter (c = 1) as moved from {PX} group by 1, 2, 3""")
def merge_shifted(spark, sf_dir):
    rows = px(spark, sf_dir).withColumn("scene", F.floor(F.col("frame") / 4))
    out = O.merge_shifted(rows, "v", "scene", 0.5)
    return out.select("scene", "y", "x", *[rounded(c).alias(c) for c in "rgb"], "moved")


_SPOT = {"source": (20, 15), "target": (28, 20), "radius": 6, "feather": 0.5, "opacity": 0.9}
_D = "sqrt(power(x - 28, 2) + power(y - 20, 2))"


@query(f"""with s as (select frame, y + 5 as y, x + 8 as x, v as sv from {PX} where x between 14 and 26 and y between 9 and 21), p as (select p.*, sv, case when {_D} > 6 then 0 when {_D} <= 3 then 0.9e0 else 0.9e0 * (6 - {_D}) / 3 end as w from {PX} p left join s using (frame, y, x))
select frame, y, x, {sql_rounded('case when sv is null then v else w * sv + (1 - w) * v end')} as v from p""")
def remove_spots(spark, sf_dir):
    return O.remove_spots(px(spark, sf_dir), [_SPOT], ["v"]).select("frame", "y", "x", rounded("v").alias("v"))


@query(f"select frame, y, x, {' or '.join(f'{e} < -0.5e0 or {e} > 65535.5e0' for e in S.matrix3(((1.3, -0.2, -0.1), (-0.1, 1.2, -0.1), (0.0, -0.2, 1.2)), 'r', 'g', 'b'))} as warn from {PX}")
def gamut_warning(spark, sf_dir):
    return O.out_of_gamut(px(spark, sf_dir), ((1.3, -0.2, -0.1), (-0.1, 1.2, -0.1), (0.0, -0.2, 1.2))).select("frame", "y", "x", "warn")


@query(f"select frame, {sql_rounded('avg(o)')} as mean, {sql_rounded('min(o)')} as low, {sql_rounded('max(o)')} as high from {_box_sql({'o': 'g'}, 3)} group by frame")
def luminance_map_stats(spark, sf_dir):
    rows = O.detail_ratio(px(spark, sf_dir), "g", 3)
    return rows.select("frame", *[rounded(c).alias(c) for c in ("mean", "low", "high")])


@query(f"""with d as (select frame, y, x, (r + g + b) / 3 as l, r - lag(r) over w as a, b - lag(b) over w as bb from {PX} window w as (partition by frame, y order by x))
select frame, cast(floor(y / 12) as bigint) as ty, cast(floor(x / 12) as bigint) as tx, {sql_rounded('(stddev_pop(a) + stddev_pop(bb)) / 2')} as chroma_noise, {sql_rounded('avg(l)')} as lightness from d group by 1, 2, 3""")
def tile_noise(spark, sf_dir):
    rows = px(spark, sf_dir).withColumn("l", (F.col("r") + F.col("g") + F.col("b")) / 3)
    out = O.noise_levels(rows, "r", "b", 12)
    return out.select("frame", "ty", "tx", rounded("chroma_noise").alias("chroma_noise"), rounded("lightness").alias("lightness"))


_CURVE = curves.sampled(curves.spline([(0, 0), (0.3, 0.4), (1, 1)]), 33)
_LIST = "[" + ", ".join(S.num(v) for v in _CURVE) + "]"


@query(f"""with k as (select frame, y, x, r / 65535e0 * 32 as place from {PX}), i as (select *, cast(least(floor(place), 31) as bigint) as j from k)
select frame, y, x, {sql_rounded(f'({_LIST})[j + 1] + (place - j) * (({_LIST})[j + 2] - ({_LIST})[j + 1])', 6)} as v from i""")
def lut_lerp(spark, sf_dir):
    return px(spark, sf_dir).select("frame", "y", "x", rounded(curves.lookup(_CURVE, F.col("r") / 65535 * 32), 6).alias("v"))


# each level starts where the one before it ended
_LEVELS = ",\n".join(
    f"""n{i} as (select v.frame, min(bin) as bin, min(cum) as cum from v{i} v join c on c.frame = v.frame and c.cum > v.m + v.total / {16 if i == 7 else 8}.0 and not v.open group by 1),
v{i + 1} as (select v.frame, v.total, {"".join(f"v.o{j}, " for j in range(i))}case when v.open then 0 when n.bin is null then v.total - v.m else log2(1 + n.bin) end as o{i}, v.open or n.bin is null as open, coalesce(n.cum, v.m) as m from v{i} v left join n{i} n using (frame))"""
    for i in range(8)
)
# constants and steps typed out: nothing here comes from the operator
_AUTO = f"""with h as (select frame, bin >> 3 as bin, cast(sum(n) as bigint) as n from {_HIST} where channel = 'l' group by 1, 2),
c as (select *, sum(n) over (partition by frame order by bin) as cum, sum(n) over (partition by frame) as total from h),
k as (select frame, max(total) as total, sum(bin * n)::double / sum(n) as mean, min(bin) as lowest, greatest(max(bin), 1) as highest, min(bin) filter (2 * cum >= total) as median,
  min(bin) filter (cum > floor(total * 0.02e0 / 100)) as dark, greatest(max(bin) filter (total - cum + n > floor(total * 0.02e0 / 100)), 1) as white from c group by frame),
v0 as (select frame, total, 0 as m, false as open from k),
{_LEVELS},
w8 as (select k.*, o0, o1, o2, o3, o4, o5, o6 as a6, o7 as a7 from k join v8 using (frame)),
u as (select *, case when a6 > ln(8193e0) then 1.5e0 * o5 - 0.5e0 * o4 else a6 end as o6 from w8),
o as (select *, case when a7 > ln(8193e0) then 1.5e0 * o6 - 0.5e0 * o5 else a7 end as o7 from u),
s as (select *, ((o2 - o1) / greatest(0.5e0, o3 - o1) + (o3 - o2) / greatest(0.5e0, o3 - o2) + (o4 - o3) / greatest(0.5e0, o4 - o3) + (o5 - o4) / greatest(0.5e0, o5 - o3) + (o6 - o5) / greatest(0.5e0, o6 - o3)) / 5 as spread,
  8 * least(dark, greatest(white - 1, 0)) as d, 8 * white as w, 8e0 * mean as m, 8 * median as md, 8 * highest as top from o),
e as (select *, log2(0.1842e0 * 65536 / (m - d + 0.1842e0 * d)) as e1, 0.5e0 * (12.5e0 - (2 * o7 - o6) + log2(65536e0 / top)) as e2 from s),
g as (select *, case when abs(e1) - abs(e2) > 1 then (e1 * abs(e2) + e2 * abs(e1)) / (abs(e1) + abs(e2)) else (e1 + e2) / 2 end as ev from e),
f as (select *, sqrt(power(2e0, ev) * 65536 / top) as scale, power(2e0, ev) as gain, power(2e0, ev) * sqrt(md * m) / 65536 as mid from g),
t as (select frame, sum(n * case when v <= 0.00304e0 then 12.9231e0 * v else 1.055e0 * power(v, 1 / 2.4e0) - 0.055e0 end) * 65535 / sum(n) as shown from (select h.frame, n, least(1, scale * bin * 8 / 65535) as v from h join f using (frame)) group by 1),
b as (select *, trunc(d * scale) as low, trunc((case when w * scale / 65536 <= 0.00304e0 then 12.9231e0 * w * scale / 65536 else 1.055e0 * power(w * scale / 65536, 1 / 2.4e0) - 0.055e0 end) * 65536) as high from f join t using (frame)),
r as (select *, (case when low < shown then greatest(high, trunc((shown - low) * 4 / 3 + low)) else high end) / 65535 as x,
  median > 0 and mean >= 1 and lowest < floor(mean) and spread > 0 as good from b)
select frame, {sql_rounded('case when good then least(greatest(ev, -5), 12) else 0 end', 6)} as expcomp,
  cast(case when good then trunc(0.25e0 * greatest(trunc((0.1842e0 - mid) * 15 / case when mid < 0.1e0 then mid else 0.10833e0 - 0.0833e0 * mid end), 0)) else 0 end as int) as bright,
  cast(case when good then least(greatest(trunc(50 * (1.1e0 - spread)), 0), 100) else 0 end as int) as contr,
  cast(case when good then trunc(low / (case when x <= 0.039286e0 then x / 12.9231e0 else power((x + 0.055e0) / 1.055e0, 2.4e0) end)) else 0 end as int) as black,
  cast(case when good then least(greatest(trunc(100 * 2.3e0 * (gain * w / 65536 - 1) / (greatest(ev, 0) + 1)), 0), 100) else 0 end as int) as hlcompr, 0 as hlcomprthresh from r"""


@query(_AUTO)
def auto_exposure(spark, sf_dir):
    """Per frame from its luminance histogram of 8192 bins."""
    h = H.rebin(_hist(spark, sf_dir).where("channel = 'l'"), 3)
    return E.auto_exposure(h.select("frame", "bin", "n"), 3, 0.02).withColumn("expcomp", rounded("expcomp", 6))


@query(f"select frame, count(*) filter (v is null and dy = 0 and dx = -1) as left_edge, count(*) filter (v is null and dy = -1 and dx = 0) as top_edge from {_near_sql('v', 1)} group by frame")
def edge_counts(spark, sf_dir):
    from ..operators.window import neighbourhood

    near = neighbourhood(px(spark, sf_dir), "v", 1)
    return near.groupBy("frame").agg(F.count_if(F.get("near", 3).isNull()).alias("left_edge"), F.count_if(F.get("near", 1).isNull()).alias("top_edge"))


# ---- whole frames and tiles through array kernels: rows only; tests hold the kernels against properties


def _kernel(name: str, columns: list[str], f, out: list[str], halo: int, size: int = 64, period: int = 1, placed: bool = False, sql: str | None = None, digits: int = 3):
    @query(sql, name=name)
    def run(spark, sf_dir):
        rows = K.apply_kernel(px(spark, sf_dir), columns, f, out, size=size, halo=halo, period=period, placed=placed)
        return rows.select("frame", "y", "x", *[rounded(c, digits).alias(c) for c in out])

    return run


_kernel("tile_gaussian_recursive", ["r"], lambda r: {"o": K.recursive_gaussian(r, 3.0)}, ["o"], 16, sql=Q.GAUSSIAN_RECURSIVE)
_kernel("tile_bilateral", ["r"], lambda r: {"o": K.bilateral(r, 1.5, 8000.0)}, ["o"], 4, 16, sql=Q.BILATERAL)
_kernel("tile_deconvolution", ["r"], lambda r: {"o": K.richardson_lucy(r, 0.8, 10, 0.2)}, ["o"], 16, sql=Q.DECONVOLUTION)
_kernel("tile_false_color", ["r", "g", "b"], lambda r, g, b: dict(zip(("r", "g", "b"), K.false_color(r, g, b, 2), strict=True)), ["r", "g", "b"], 4, 16, sql=Q.FALSE_COLOR)
# the deepest hole of a frame of 50 x 60 leaves one corner: 49 + 59 steps
_kernel("tile_inpaint", ["r"], lambda r: {"o": K.inpaint(r, r > 60000)}, ["o"], 108, sql=Q.INPAINT)
_kernel("tile_pyramid", ["r"], lambda r: {"o": K2.pyramid_equalizer(r, [1.3, 1.1, 1.0], 500.0)}, ["o"], 16, sql=Q.PYRAMID)
_kernel("tile_edge_sharpen", ["r"], lambda r: {"o": K2.micro_contrast(K2.edge_sharpen(r, 0.2, 2), 0.3, 1.0)}, ["o"], 4, 16, sql=Q.EDGE_SHARPEN)
_kernel("tile_grain", ["r"], lambda r, at: {"o": r + K.grain(r.shape, at.y0, at.x0, 900.0, 3.0)}, ["o"], 0, 16, placed=True, sql=Q.GRAIN)
_METHOD_SQL = {"adaptive": Q.ADAPTIVE_DEMOSAIC, "vng": Q.VNG_DEMOSAIC, "ratio": Q.RATIO_DEMOSAIC, "lmmse": Q.LMMSE_DEMOSAIC, "homogeneity": Q.HOMOGENEITY_DEMOSAIC}
for _method, _f in R.METHODS.items():
    _kernel(f"{_method}_demosaic", ["r" if _method in _METHOD_SQL else "v"], lambda v, f=_f: dict(zip("rgb", f(v), strict=True)), ["r", "g", "b"], 14, 16, 2, sql=_METHOD_SQL.get(_method), digits=3 if _method in ("ratio", "lmmse") else 6)


# ---- operators of whole frames, on several tiles a frame


def _frames(name: str, f, out: list[str], sql: str | None = None):
    @query(sql, name=name)
    def run(spark, sf_dir):
        return f(px(spark, sf_dir)).select("frame", "y", "x", *[rounded(c, 3).alias(c) for c in out])

    return run


_frames("tile_wavelet", lambda p: FR.wavelet_equalize(p, "r", "o", [1.4, 1.2, 1.0], [2.0, 1.0, 0.0], 16), ["o"], Q.WAVELET)
_frames("tile_retinex", lambda p: FR.retinex(p, "r", "o", [2.0, 6.0], size=16), ["o"], Q.RETINEX)
_frames("tile_edge_preserving", lambda p: FR.compress_range(p, "r", "o", 0.2, 1.0, 0.6, 1.1, 32, 16), ["o"])
_frames("tile_gradient_domain", lambda p: FR.gradient_domain_map(p, "r", "o"), ["o"])
_frames("tile_defringe", lambda p: FR.defringe(p.withColumns({"a": F.col("g") - 32768, "b": F.col("b") - 32768}), "a", "b", 2.0, 1.3, 16), ["a", "b"], Q.DEFRINGE)
_frames("tile_line_denoise", lambda p: FR.line_denoise(p, "v", "o", 2000.0), ["o"], Q.LINE_DENOISE)
_frames("tile_shrinkage", lambda p: FR.shrink_coefficients(p, "r", "o", 3, 1.0, 16), ["o"], Q.SHRINKAGE)
_frames("tile_fringe", lambda p: FR.correct_fringe(p, "g", "r", "o", 16, size=32), ["o"])


@query(Q.DEHAZE)
def dehaze(spark, sf_dir):
    rows = O.dehaze(px(spark, sf_dir), 5, 0.6, 4)
    return rows.select("frame", "y", "x", *[rounded(c, 3).alias(c) for c in "rgb"])


@query(Q.TONE_EQUALIZER)
def tone_equalizer(spark, sf_dir):
    rows = O.tone_equalizer(px(spark, sf_dir), {"o_r": "r", "o_g": "g", "o_b": "b"}, [20.0, 10.0, 0.0, -10.0, -20.0], 3)
    return rows.select("frame", "y", "x", *[rounded(f"o_{c}", 3).alias(c) for c in "rgb"])


@query(Q.SHADOWS_HIGHLIGHTS)
def shadows_highlights(spark, sf_dir):
    return O.shadows_highlights(px(spark, sf_dir), "r", "o", 4, 40.0, 30.0).select("frame", "y", "x", rounded("o", 3).alias("v"))


@query(Q.IMPULSE_DENOISE)
def impulse_denoise(spark, sf_dir):
    return O.impulse_denoise(px(spark, sf_dir), "r", "o", 1.5, 4.0).select("frame", "y", "x", rounded("o", 3).alias("v"))


@query(Q.RECOVER_OPPOSED)
def recover_opposed(spark, sf_dir):
    rows = O.recover_opposed(px(spark, sf_dir), 60000.0)
    return rows.select("frame", "y", "x", *[rounded(c, 3).alias(c) for c in "rgb"])


@query(f"""with g as (select p, gy, gx, 1 + 0.1e0 * p + 0.02e0 * gy + 0.03e0 * gx as gain from range(4) a(p), range(5) b(gy), range(4) c(gx)),
k as (select *, x * 3 / {WIDTH}e0 as fx, y * 4 / {HEIGHT}e0 as fy, (y % 2) * 2 + x % 2 as p from {PX})
select k.frame, k.y, k.x, {sql_rounded('(v - 200) * sum(gain * (case when gx = floor(fx) then 1 - (fx - floor(fx)) else fx - floor(fx) end) * (case when gy = floor(fy) then 1 - (fy - floor(fy)) else fy - floor(fy) end)) + 200', 6)} as v
from k join g on g.p = k.p and g.gx between floor(fx) and floor(fx) + 1 and g.gy between floor(fy) and floor(fy) + 1 group by k.frame, k.y, k.x, v""")
def gain_map(spark, sf_dir):
    grid = spark.range(80).select((F.col("id") % 4).alias("parity"), (F.floor(F.col("id") / 4) % 5).alias("gy"), F.floor(F.col("id") / 20).alias("gx"))
    grid = grid.withColumn("gain", 1 + 0.1 * F.col("parity") + 0.02 * F.col("gy") + 0.03 * F.col("gx"))
    return G.gain_map(px(spark, sf_dir), grid, WIDTH, HEIGHT, 4, 5, "v", "o", 200.0).select("frame", "y", "x", rounded("o", 6).alias("v"))
