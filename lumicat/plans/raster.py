"""Queries over rasters: histograms, statistics, windows, geometry, interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as S
from ..operators import demosaic as D
from ..operators import geometry as G
from ..operators import histogram as H
from ..operators import window as N
from . import tables as T
from .registry import query, rounded, sql_rounded

PX = T.sql(T.PIXELS)
WIDTH, HEIGHT = T.WIDTH, T.HEIGHT
LUM = S.luminance("r", "g", "b")


def px(spark, sf_dir):
    return T.table(spark, sf_dir, T.PIXELS)


def _near_sql(value: str, radius: int, step: int = 1, source: str = PX) -> str:
    """(frame, y, x, dy, dx, v) of every place and offset; v is null outside."""
    offsets = ", ".join(f"({dy}, {dx})" for dy in range(-radius * step, radius * step + 1, step) for dx in range(-radius * step, radius * step + 1, step))
    return f"(select p.frame, p.y, p.x, o.dy, o.dx, q.{value} as v from {source} p cross join (values {offsets}) o(dy, dx) left join {source} q on q.frame = p.frame and q.y = p.y + o.dy and q.x = p.x + o.dx)"


def _box_sql(columns: dict[str, str], radius: int, source: str = PX, f: str = "avg") -> str:
    """``source`` with box filters added: out -> in."""
    first = ", ".join(f"{f}({i}) over (partition by frame, y order by x rows between {radius} preceding and {radius} following) as h_{o}" for o, i in columns.items())
    second = ", ".join(f"{f}(h_{o}) over (partition by frame, x order by y rows between {radius} preceding and {radius} following) as {o}" for o in columns)
    return f"(select *, {second} from (select *, {first} from {source}))"


# ---- histograms

_HIST = f"(select frame, channel, cast(least(greatest(trunc(v), 0), 65535) as bigint) as bin, count(*) as n from (select frame, unnest(['r', 'g', 'b', 'l']) as channel, unnest([r, g, b, {LUM}]) as v from {PX}) group by 1, 2, 3)"
_HIST8 = f"(select frame, channel, bin >> 8 as bin, cast(sum(n) as bigint) as n from {_HIST} group by 1, 2, 3)"


def _hist(spark, sf_dir):
    return H.histogram(px(spark, sf_dir), {"r": F.col("r"), "g": F.col("g"), "b": F.col("b"), "l": F.expr(LUM)})


def _hist8(spark, sf_dir):
    return H.rebin(_hist(spark, sf_dir), 8)


@query(f"select * from {_HIST8}")
def hist_channel(spark, sf_dir):
    return _hist8(spark, sf_dir)


@query(f"select frame, channel, bin >> 11 as bin, cast(sum(n) as bigint) as n from {_HIST} group by 1, 2, 3")
def hist_rebin(spark, sf_dir):
    return H.rebin(_hist(spark, sf_dir), 11)


@query(f"select frame, channel, cast(sum(n) as bigint) as total, {sql_rounded('cast(sum(bin * n) as double) / sum(n)')} as average from {_HIST} group by 1, 2")
def hist_mean(spark, sf_dir):
    return H.sum_and_average(_hist(spark, sf_dir)).withColumn("average", rounded("average"))


@query(f"select frame, channel, bin, cast(sum(n) over (partition by frame, channel order by bin) as bigint) as cum, cast(sum(n) over (partition by frame, channel) as bigint) as total from {_HIST8}")
def hist_cdf(spark, sf_dir):
    return H.cumulative(_hist8(spark, sf_dir)).select("frame", "channel", "bin", "cum", "total")


_CDF = f"(select *, sum(n) over (partition by frame, channel order by bin) as cum, sum(n) over (partition by frame, channel) as total from {_HIST})"


@query(f"select frame, channel, min(bin) filter (cum * 2 >= total) as median from {_CDF} group by 1, 2")
def hist_median(spark, sf_dir):
    return H.median_bin(_hist(spark, sf_dir))


@query(f"""select frame, channel, least(coalesce(min(bin) filter (cum > floor(total * 2 / 100e0)), 0), 65535) as black, coalesce(max(bin) filter (total - cum + n > floor(total * 2 / 100e0)), 1) as white from {_CDF} group by 1, 2""")
def hist_clip_points(spark, sf_dir):
    return H.clip_points(_hist(spark, sf_dir), 2.0, 65535)


@query(f"""with e as (select frame, min(v) as lo, max(v) as hi, count(*) as total from {PX} group by frame),
s as (select p.frame, lo, hi, total, (least(total, 65536) - 1) / (hi - lo) as scale, v from {PX} p join e using (frame)),
h as (select frame, lo, hi, total, scale, floor(scale * (v - lo)) as bin, count(*) as n from s group by all),
c as (select *, sum(n) over (partition by frame order by bin) as cum from h)
select frame, {", ".join(sql_rounded(f"arg_min(least(greatest(((total * {q}e0 - (cum - n)) * (bin + 1) + (cum - total * {q}e0) * bin) / n / scale + lo, lo), hi), bin) filter (cum >= total * {q}e0)") + f" as {k}" for k, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95)))} from c group by frame""")
def hist_percentile_interp(spark, sf_dir):
    rows = H.percentile(px(spark, sf_dir), "v", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return rows.select("frame", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")])


@query(f"""with h as (select frame, cast(least(trunc(abs(r - 32768)), 65535) as bigint) as bin, count(*) as n from {PX} group by 1, 2),
c as (select *, sum(n) over (partition by frame order by bin) as cum, sum(n) over (partition by frame) as total from h),
m as (select frame, arg_min(bin, bin) filter (cum >= floor(total / 2)) as bin, arg_min(cum - n, bin) filter (cum >= floor(total / 2)) as before, arg_min(n, bin) filter (cum >= floor(total / 2)) as n, max(floor(total / 2)) as half from c group by frame)
select frame, {sql_rounded('(bin + (half - before) / n) / 0.6745e0')} as mad from m""")
def hist_mad(spark, sf_dir):
    return H.mad(px(spark, sf_dir), F.col("r") - 32768, 65536).withColumn("mad", rounded("mad"))


@query(f"""with c as (select frame, channel, bin, sum(n) over (partition by frame, channel order by bin) as cum from {_HIST8})
select s.frame, s.bin, arg_min(t.bin, (abs(s.cum - t.cum), -t.cum, t.bin)) as matched from c s join c t on t.frame = s.frame and s.channel = 'r' and t.channel = 'g' group by 1, 2""")
def hist_match(spark, sf_dir):
    c = H.cumulative(_hist8(spark, sf_dir))
    return H.cdf_match(c.where("channel = 'r'"), c.where("channel = 'g'"), "frame")


@query(f"select frame, x, channel, cast(least(greatest(trunc(v), 0), 255) as bigint) as bin, count(*) as n from (select frame, x, unnest(['r', 'l']) as channel, unnest([r * 256 / 65536e0, {LUM} * 256 / 65536e0]) as v from {PX}) group by 1, 2, 3, 4")
def waveform(spark, sf_dir):
    return H.waveform(px(spark, sf_dir), {"r": F.col("r"), "l": F.expr(LUM)})


@query(f"select frame, cast(floor(g / 512) as bigint) as row, cast(floor(b / 512) as bigint) as col, count(*) as n from {PX} where g / 512 < 100 and b / 512 < 100 group by 1, 2, 3")
def vectorscope2d(spark, sf_dir):
    return H.histogram2d(px(spark, sf_dir), F.col("g") / 512, F.col("b") / 512, 100)


@query(f"select frame, c, cast(case when v <= 1000 then 0 else greatest(trunc((v - 1000) / 256), 1) end as bigint) as bin, count(*) as n from {PX} group by 1, 2, 3")
def raw_hist_cfa(spark, sf_dir):
    bin_ = F.when(F.col("v") <= 1000, F.lit(0)).otherwise(F.greatest(((F.col("v") - 1000) / 256).cast("bigint"), F.lit(1)))
    return px(spark, sf_dir).groupBy("frame", "c", bin_.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


# ---- statistics


@query(f"""with m as (select frame, c, avg(v) as m from {PX} where x between 4 and 45 and y between 4 and 55 and v <= 300000 group by 1, 2)
select frame, {sql_rounded('max(m) filter (c = 1) / max(m) filter (c = 0)', 6)} as rm, 1.0e0 as gm, {sql_rounded('max(m) filter (c = 1) / max(m) filter (c = 2)', 6)} as bm from m group by frame""")
def grayworld_wb(spark, sf_dir):
    m = H.channel_means(px(spark, sf_dir), "v", "c", 300000.0, 4, WIDTH, HEIGHT)
    return H.grey_world(m).select("frame", rounded("rm", 6).alias("rm"), "gm", rounded("bm", 6).alias("bm"))


@query(f"""with m as (select frame, avg(v) filter (y % 2 = 0) as ma, avg(v) filter (y % 2 = 1) as mb from {PX} where c = 1 group by frame)
select frame, y, x, {sql_rounded('v * case when c <> 1 then 1 when y % 2 = 0 then (ma + mb) / 2 / ma else (ma + mb) / 2 / mb end')} as v from {PX} join m using (frame)""")
def green_equalize(spark, sf_dir):
    rows = H.equalize_groups(px(spark, sf_dir), "v", F.col("y") % 2 == 0, F.col("c") == 1)
    return rows.select("frame", "y", "x", rounded("v").alias("v"))


@query(f"select frame, cast(floor(y / 10) as bigint) as ty, cast(floor(x / 10) as bigint) as tx, {sql_rounded('avg(v)')} as mean, {sql_rounded('var_pop(v) / avg(v)')} as relative_variance from {PX} group by 1, 2, 3")
def tile_mean_var(spark, sf_dir):
    rows = H.tile_stats(px(spark, sf_dir), "v", 10)
    return rows.select("frame", "ty", "tx", rounded("mean").alias("mean"), rounded("relative_variance").alias("relative_variance"))


@query(f"select frame, c, min(v) as min from {PX} group by 1, 2")
def cfa_min_values(spark, sf_dir):
    return H.min_values(px(spark, sf_dir), "v", "c")


@query(f"select frame, c, {sql_rounded('(avg(r) - avg(g)) / sqrt(((count(*) - 1) * var_samp(r) + (count(*) - 1) * var_samp(g)) / (2 * count(*) - 2) * (2.0e0 / count(*)))', 6)} as t from {PX} group by 1, 2")
def student_t(spark, sf_dir):
    return H.student_t(px(spark, sf_dir), "r", "g", "frame", "c").withColumn("t", rounded("t", 6))


@query(f"""with d as (select frame, r - 32768 as d from {PX}) select frame, {", ".join(sql_rounded(f"coalesce({e}, 0)") + f" as {k}" for k, e in (("mean_plus", "avg(d) filter (d >= 327)"), ("mean_minus", "avg(d) filter (d < -327)"), ("sigma_plus", "stddev_pop(d) filter (d >= 327)"), ("sigma_minus", "stddev_pop(d) filter (d < -327)"), ("max", "max(d)"), ("min", "min(d)")))} from d group by frame""")
def coefficient_stats(spark, sf_dir):
    rows = H.signed_stats(px(spark, sf_dir).withColumn("d", F.col("r") - 32768), "d", 327.0, "frame")
    return rows.select("frame", *[rounded(c).alias(c) for c in rows.columns[1:]])


@query(f"""with m as (select frame, channel, min(bin) filter (cum * 2 >= total) as median from {_CDF} group by 1, 2)
select m.frame, m.channel, {sql_rounded('cast(k.median as double) / nullif(m.median, 0)', 6)} as factor from m join m k on k.channel = m.channel and k.frame = 0""")
def frame_brightness_factor(spark, sf_dir):
    return H.brightness_factors(H.median_bin(_hist(spark, sf_dir)), 0).withColumn("factor", rounded("factor", 6))


@query(f"select frame, cast(floor(y / 6) as bigint) as ty, cast(floor(x / 5) as bigint) as tx, {sql_rounded('1 - 0.8e0 * least(greatest(least(min(r) / 50000e0, min(g) / 52000e0, min(b) / 54000e0), 0), 1)', 6)} as t from {PX} group by 1, 2, 3")
def dark_channel(spark, sf_dir):
    rows = px(spark, sf_dir)
    patch = rows.groupBy("frame", F.floor(F.col("y") / 6).alias("ty"), F.floor(F.col("x") / 5).alias("tx"))
    low = F.least(F.min("r") / 50000.0, F.min("g") / 52000.0, F.min("b") / 54000.0)
    return patch.agg(rounded(1 - 0.8 * F.least(F.greatest(low, F.lit(0.0)), F.lit(1.0)), 6).alias("t"))


@query(f"select frame, {', '.join(sql_rounded(f'{f}({c})') + f' as {f}_{c}' for c in 'rgb' for f in ('avg', 'max'))} from {PX} where x between 17 and 23 and y between 7 and 13 group by frame")
def spot_average_max(spark, sf_dir):
    rows = H.spot_stats(px(spark, sf_dir), 20, 10, 7)
    return rows.select("frame", *[rounded(c).alias(c) for c in rows.columns[1:]])


@query(f"select frame, {sql_rounded('avg(s)', 6)} as mean, {sql_rounded('stddev_pop(s)', 6)} as deviation from (select frame, {S.saturation('r', 'g', 'b')} as s from {PX}) group by frame")
def saturation_stats(spark, sf_dir):
    rows = px(spark, sf_dir).select("frame", F.expr(S.saturation("r", "g", "b")).alias("s"))
    return rows.groupBy("frame").agg(rounded(F.avg("s"), 6).alias("mean"), rounded(F.stddev_pop("s"), 6).alias("deviation"))


@query(f"select frame, {sql_rounded('sum(r * g) / 1000000')} as product from {PX} group by frame")
def product_sum(spark, sf_dir):
    return px(spark, sf_dir).groupBy("frame").agg(rounded(F.sum(F.col("r") * F.col("g")) / 1000000).alias("product"))


_NM = "(select 380 + 5 * i as nm, exp(-power((380 + 5 * i - 600) / 80e0, 2)) as xbar, exp(-power((380 + 5 * i - 555) / 70e0, 2)) as ybar, exp(-power((380 + 5 * i - 445) / 40e0, 2)) as zbar from range(81) t(i))"


@query(f"""with o as {_NM}, s as (select p_size as name, o.nm, {S.planck('o.nm', '(2000 + 100 * p_size)')} as power from (select distinct p_size from part), o)
select name, {', '.join(sql_rounded(f'sum(power * {c}bar) / sum(power * ybar)', 6) + f' as {c.upper()}' for c in 'xyz')} from s join o using (nm) group by name""")
def spectrum_integral(spark, sf_dir):
    bell = lambda m, w: F.exp(-F.pow((F.col("nm") - m) / w, 2))
    observer = spark.range(81).select((380 + 5 * F.col("id")).alias("nm")).select("nm", bell(600, 80.0).alias("xbar"), bell(555, 70.0).alias("ybar"), bell(445, 40.0).alias("zbar"))
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("name")).distinct()
    wave = names.select("name", F.explode(F.sequence(F.lit(380), F.lit(780), F.lit(5))).alias("nm"))
    spectrum = wave.select("name", "nm", F.expr(S.planck("nm", "(2000 + 100 * name)")).alias("power"))
    rows = H.weighted_spectrum(spectrum, observer)
    return rows.select("name", *[rounded(c, 6).alias(c) for c in ("X", "Y", "Z")])


# ---- windows


@query(f"select frame, y, x, {sql_rounded('avg(v) over (partition by frame, y order by x rows between 3 preceding and 3 following)')} as v from {PX}")
def box_blur_h(spark, sf_dir):
    return N.box_blur_rows(px(spark, sf_dir), {"v": "v"}, 3).select("frame", "y", "x", rounded("v").alias("v"))


@query(f"select frame, y, x, {sql_rounded('o')} as v from {_box_sql({'o': 'v'}, 2)}")
def box_blur_2d(spark, sf_dir):
    return N.box_blur(px(spark, sf_dir), {"o": "v"}, 2).select("frame", "y", "x", rounded("o").alias("v"))


@query(f"select frame, y, x, {sql_rounded('o')} as v from {_box_sql({'o': 'd'}, 2, f'(select *, abs(r - 32768) as d from {PX})')}")
def box_blur_abs(spark, sf_dir):
    rows = px(spark, sf_dir).withColumn("d", F.col("r") - 32768)
    return N.box_blur_abs(rows, {"o": "d"}, 2).select("frame", "y", "x", rounded("o").alias("v"))


@query(f"select frame, y, x, low, high from {_box_sql({'high': 'v'}, 1, _box_sql({'low': 'v'}, 1, PX, 'min'), 'max')}")
def minmax3(spark, sf_dir):
    return N.extremes(px(spark, sf_dir), "v", 1).select("frame", "y", "x", "low", "high")


@query(f"select frame, y, x, {sql_rounded('case when abs(v - o) > 5000 then greatest(v + 0.7e0 * (v - o), 0) else v end')} as v from {_box_sql({'o': 'v'}, 2)}")
def unsharp_mask(spark, sf_dir):
    return N.unsharp(px(spark, sf_dir), "v", "o", 2, 0.7, 5000.0).select("frame", "y", "x", rounded("o").alias("v"))


@query(f"select frame, y, x, {sql_rounded('least(greatest(l + 0.3e0 * (l - o) * case when 0.3e0 * (l - o) > 0 then 1.2e0 else 0.8e0 end, 0.0001e0), 32767)')} as v from {_box_sql({'o': 'l'}, 3, f'(select *, r / 2 as l from {PX})')}")
def local_contrast(spark, sf_dir):
    rows = px(spark, sf_dir).withColumn("l", F.col("r") / 2)
    return N.local_contrast(rows, "l", "o", 3, 0.3, 0.8, 1.2).select("frame", "y", "x", rounded("o").alias("v"))


_BAND = _box_sql({"high": "m"}, 1, _box_sql({"low": "m"}, 1, _box_sql({"m": "v"}, 1, f"(select *, v * 1.5e0 as s from {PX})"), "min"), "max")


@query(f"select frame, y, x, {sql_rounded('case when s > high then high + (s - high) * 0.25e0 when s < low then low - (low - s) * 0.25e0 else s end')} as v from {_BAND}")
def halo_clamp(spark, sf_dir):
    rows = px(spark, sf_dir).withColumn("s", F.col("v") * 1.5)
    return N.halo_control(rows, "v", "s", "o", 75.0).select("frame", "y", "x", rounded("o").alias("v"))


@query(f"select frame, y, x, {sql_rounded('median(v)')} as v from {_near_sql('v', 1, 2)} group by 1, 2, 3")
def cfa_median9(spark, sf_dir):
    near = N.neighbourhood(px(spark, sf_dir), "v", 1, 2)
    return near.select("frame", "y", "x", rounded(N.median(F.col("near"))).alias("v"))


_MEDIAN3 = f"(select frame, y, x, case when count(v) = 9 then median(v) else max(v) filter (dy = 0 and dx = 0) end as v from {_near_sql('v', 1)} group by 1, 2, 3)"


@query(f"select frame, y, x, {sql_rounded('v')} as v from {_MEDIAN3}")
def median_filter3(spark, sf_dir):
    return N.median_filter(px(spark, sf_dir), "v", "o").select("frame", "y", "x", rounded("o").alias("v"))


_DEV = f"(select frame, y, x, case when count(v) = 9 then abs(max(v) filter (dy = 0 and dx = 0) - median(v)) else 0 end as d from {_near_sql('v', 1, 2)} group by 1, 2, 3)"
_HOT = f"(select frame, y, x, count(v) = 25 and max(v) filter (dy = 0 and dx = 0) * 24 > 2.5e0 * (sum(v) - max(v) filter (dy = 0 and dx = 0)) as bad from {_near_sql('d', 2, 1, _DEV)} group by 1, 2, 3)"


@query(f"select frame, y, x from {_HOT} where bad")
def hot_pixels(spark, sf_dir):
    return N.hot_pixels(px(spark, sf_dir), "v", 2.5).where("bad").select("frame", "y", "x")


_FILL = f"(select *, case when (x + y * 7) % 13 = 0 then null else v end as gv from {PX})"


@query(f"""with n as (select frame, y, x, sum(v * (1e0 / sqrt(dy * dy + dx * dx))) / sum(case when v is not null then 1e0 / sqrt(dy * dy + dx * dx) end) as m from {_near_sql('gv', 1, 2, _FILL)} where dy <> 0 or dx <> 0 group by 1, 2, 3)
select frame, y, x, {sql_rounded('case when (x + y * 7) % 13 = 0 then coalesce(m, v) else v end')} as v from {PX} join n using (frame, y, x)""")
def bad_pixel_fill(spark, sf_dir):
    rows = px(spark, sf_dir).withColumn("bad", (F.col("x") + F.col("y") * 7) % 13 == 0)
    return N.fill_bad(rows, "v", "o").select("frame", "y", "x", rounded("o").alias("v"))


@query(f"""with a as {_box_sql({'mg': 'g', 'ms': 'r', 'mgs': 'gs', 'mgg': 'gg'}, 2, f'(select *, g * r as gs, g * g as gg from {PX})')},
b as (select *, (mgs - mg * ms) / (mgg - mg * mg + 1000000) as ca from a), c as (select *, ms - ca * mg as cb from b)
select frame, y, x, {sql_rounded('ma * g + mb', 3)} as v from {_box_sql({'ma': 'ca', 'mb': 'cb'}, 2, 'c')}""")
def guided_filter(spark, sf_dir):
    return N.guided_filter(px(spark, sf_dir), "g", "r", "o", 2, 1000000.0).select("frame", "y", "x", rounded("o", 3).alias("v"))


@query(f"""with h as (select *, avg(r) over (partition by frame, y, x % 2 order by x rows between 1 preceding and 1 following) as h from {PX}), f as (select *, avg(h) over (partition by frame, x, y % 2 order by y rows between 1 preceding and 1 following) as o from h),
m as (select frame, c, avg(o) as m from f group by 1, 2)
select frame, y, x, {sql_rounded('greatest(v - 500, 0) * (m / greatest(o, 1e-5)) + 500', 3)} as v from f join m using (frame, c)""")
def flat_field_divide(spark, sf_dir):
    return N.flat_field(px(spark, sf_dir), "v", "r", "o", 1, 500.0).select("frame", "y", "x", rounded("o", 3).alias("v"))


@query(f"select p.frame, p.y, p.x, {sql_rounded('case when d.v is null then p.v else greatest(p.v + 500 - d.v, 0) end')} as v from {PX} p left join (select frame + 1 as frame, y, x, v from {PX}) d using (frame, y, x)")
def dark_subtract(spark, sf_dir):
    rows = px(spark, sf_dir)
    return N.subtract_dark(rows, rows.withColumn("frame", F.col("frame") + 1), "v", "o", 500.0).select("frame", "y", "x", rounded("o").alias("v"))


# ---- geometry


@query(f"select frame, {HEIGHT - 1} - y as y, {WIDTH - 1} - x as x, v from {PX}")
def flip_both(spark, sf_dir):
    return G.flip(px(spark, sf_dir), WIDTH, HEIGHT, True, True).select("frame", "y", "x", "v")


@query(f"select frame, x as y, {HEIGHT - 1} - y as x, v from {PX}")
def rotate_quarter(spark, sf_dir):
    return G.rotate(px(spark, sf_dir), WIDTH, HEIGHT, 90).select("frame", "y", "x", "v")


@query(f"select frame, cast(floor((y - 5) / 3) as bigint) as y, cast(floor((x - 10) / 3) as bigint) as x, v from {PX} where x between 10 and 39 and y between 5 and 44 and (x - 10) % 3 = 0 and (y - 5) % 3 = 0")
def crop_skip_read(spark, sf_dir):
    return G.crop_skip(px(spark, sf_dir), 10, 5, 30, 40, 3).select("frame", "y", "x", "v")


@query(f"select frame, cast(floor(y / 4) as bigint) as y, cast(floor(x / 4) as bigint) as x, {sql_rounded('avg(r)')} as r, {sql_rounded('avg(g)')} as g from {PX} group by 1, 2, 3")
def crop_average_read(spark, sf_dir):
    rows = G.crop_average(px(spark, sf_dir), ["r", "g"], 4)
    return rows.select("frame", "y", "x", rounded("r").alias("r"), rounded("g").alias("g"))


@query(f"select p.frame, j as y, i as x, p.v from {PX} p join range(35) a(i) on p.x = floor(i * {WIDTH} / 35e0) join range(90) b(j) on p.y = floor(j * {HEIGHT} / 90e0)")
def resize_nearest(spark, sf_dir):
    return G.resize_nearest(px(spark, sf_dir), ["v"], WIDTH, HEIGHT, 35, 90).select("frame", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "v")


def _taps_sql(name: str, taps) -> str:
    return f"(select * from (values {', '.join(f'({s}, {t}, {w!r}e0)' if 'e' not in repr(w) else f'({s}, {t}, {w!r})' for t, row in enumerate(taps) for s, w in row)}) {name}(s, t, w))"


def _resize_sql(make, new_width: int, new_height: int, digits: int) -> str:
    a, b = _taps_sql("a", make(WIDTH, new_width)), _taps_sql("b", make(HEIGHT, new_height))
    first = f"(select frame, y, a.t as x, sum(v * a.w) / sum(a.w) as v from {PX} p join {a} a on a.s = p.x group by 1, 2, 3)"
    return f"select frame, cast(b.t as bigint) as y, cast(x as bigint) as x, {sql_rounded('sum(v * b.w) / sum(b.w)', digits)} as v from {first} p join {b} b on b.s = p.y group by 1, 2, 3"


@query(_resize_sql(G.bilinear_taps, 35, 40, 4))
def resize_bilinear(spark, sf_dir):
    return G.resize_bilinear(px(spark, sf_dir), ["v"], WIDTH, HEIGHT, 35, 40).select("frame", "y", "x", rounded("v").alias("v"))


@query(_resize_sql(G.lanczos_taps, 25, 30, 3))
def resize_lanczos(spark, sf_dir):
    return G.resize_lanczos(px(spark, sf_dir), ["v"], WIDTH, HEIGHT, 25, 30).select("frame", "y", "x", rounded("v", 3).alias("v"))


_R2 = f"((power(x - {(WIDTH - 1) / 2}e0, 2) + power(y - {(HEIGHT - 1) / 2}e0, 2)) / {(WIDTH**2 + HEIGHT**2) / 4}e0)"


@query(f"select frame, y, x, {sql_rounded(f'v * (1 + 0.3e0 * {_R2} - 0.1e0 * {_R2} * {_R2})')} as v from {PX}")
def vignette_gain(spark, sf_dir):
    gain = G.radial_gain(F.col("x"), F.col("y"), WIDTH, HEIGHT, [0.3, -0.1])
    return px(spark, sf_dir).select("frame", "y", "x", rounded(F.col("v") * gain).alias("v"))


# ---- interpolation


def _pick(case: dict[str, str]) -> str:
    return f"avg(v) filter ({' or '.join(f'({c} and {o})' for c, o in case.items())})"


_SIDE, _POST, _CORNER = "(dy = 0 and dx <> 0)", "(dy <> 0 and dx = 0)", "(dy <> 0 and dx <> 0)"


@query(f"""with n as (select * from {_near_sql('v', 1)}), a as (select n.*, p.c, p.v as own from n join {PX} p using (frame, y, x))
select frame, y, x,
{sql_rounded(f"case when any_value(c) = 0 then any_value(own) when any_value(c) = 2 then avg(v) filter ({_CORNER}) when any_value(y) % 2 = 0 then avg(v) filter ({_SIDE}) else avg(v) filter ({_POST}) end")} as r,
{sql_rounded(f"case when any_value(c) = 1 then any_value(own) else avg(v) filter ({_SIDE} or {_POST}) end")} as g,
{sql_rounded(f"case when any_value(c) = 2 then any_value(own) when any_value(c) = 0 then avg(v) filter ({_CORNER}) when any_value(y) % 2 = 0 then avg(v) filter ({_POST}) else avg(v) filter ({_SIDE}) end")} as b
from a group by frame, y, x""")
def bilinear_demosaic(spark, sf_dir):
    rows = D.bilinear(px(spark, sf_dir).drop("r", "g", "b"), "v")
    return rows.select("frame", "y", "x", *[rounded(c).alias(c) for c in "rgb"])


@query(f"select frame, cast(floor(y / 2) as bigint) as y, cast(floor(x / 2) as bigint) as x, {', '.join(sql_rounded(f'avg(v) filter (c = {i})') + f' as {k}' for i, k in enumerate('rgb'))} from {PX} group by 1, 2, 3")
def half_size_demosaic(spark, sf_dir):
    rows = D.half_size(px(spark, sf_dir), "v")
    return rows.select("frame", "y", "x", *[rounded(c).alias(c) for c in "rgb"])


# ---- tiles from embeddings

_TILE = "(select vec_id as frame, label, cast(floor((i - 1) / 8) as bigint) as y, cast((i - 1) % 8 as bigint) as x, cast(embedding[i] as double) as v from embeddings, range(1, 65) t(i))"


def _tiles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), "label", F.posexplode("embedding").alias("i", "v"))
    return rows.select("frame", "label", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), F.col("v").cast("double").alias("v"))


@query(f"select label, {sql_rounded('avg(v)', 5)} as mean, {sql_rounded('stddev_pop(v)', 5)} as deviation, {sql_rounded('min(v)', 5)} as low, {sql_rounded('max(v)', 5)} as high from {_TILE} group by label")
def embedding_tile_stats(spark, sf_dir):
    rows = _tiles(spark, sf_dir).groupBy("label")
    return rows.agg(rounded(F.avg("v"), 5).alias("mean"), rounded(F.stddev_pop("v"), 5).alias("deviation"), rounded(F.min("v"), 5).alias("low"), rounded(F.max("v"), 5).alias("high"))


@query(f"select frame, y, x, {sql_rounded('o', 5)} as v from {_box_sql({'o': 'v'}, 1, _TILE)}")
def embedding_tile_blur(spark, sf_dir):
    return N.box_blur(_tiles(spark, sf_dir), {"o": "v"}, 1).select("frame", "y", "x", rounded("o", 5).alias("v"))
