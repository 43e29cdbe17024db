"""Queries of staged colour models, profiles and white balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import appearance as A
from ..functions import formulas as S
from ..operators import profiles as P
from . import tables as T
from .raster import PX, px
from .registry import query, rounded, sql_rounded

VIEW = A.Viewing()
_FORWARD = A.ciecam02(VIEW, "(r / 700 + 3)", "(g / 700 + 3)", "(b / 700 + 3)")
_INVERSE = A.xyz_from_ciecam02(VIEW, "(20 + r / 1000)", "(5 + g / 3000)", "(b / 200)")
_REDUCE = A.reduce_chroma("(6000 + r / 4)", "(g - 32768)", "(b - 32768)")


def _staged(name: str, stages, columns: list[str], digits: int) -> None:
    def run(spark, sf_dir):
        rows = A.staged(px(spark, sf_dir).select("frame", "y", "x", "r", "g", "b"), stages)
        return rows.select("frame", "y", "x", *[rounded(c, digits).alias(f"o_{c}") for c in columns])

    body = ", ".join(f"{sql_rounded(c, digits)} as o_{c}" for c in columns)
    query(f"select frame, y, x, {body} from {A.staged_sql(f'(select frame, y, x, r, g, b from {PX})', stages)}", name)(run)


_staged("ciecam02_forward", _FORWARD, ["J", "C", "Q", "M"], 5)
_staged("ciecam02_inverse", _INVERSE, ["out_x", "out_y", "out_z"], 5)
_staged("chroma_reduction", _REDUCE, ["share"], 6)


def _matrix_query(name: str, m, digits: int = 4) -> None:
    def run(spark, sf_dir):
        return px(spark, sf_dir).select("frame", "y", "x", *[rounded(F.expr(e), digits).alias(f"o_{c}") for c, e in zip("xyz", S.matrix3(m, "r", "g", "b"), strict=True)])

    body = ", ".join(f"{sql_rounded(e, digits)} as o_{c}" for c, e in zip("xyz", S.matrix3(m, "r", "g", "b"), strict=True))
    query(f"select frame, y, x, {body} from {PX}", name)(run)


_matrix_query("chromatic_adaptation", A.cat02((109.85, 100.0, 35.58)))
_matrix_query("black_and_white_mix", (A.bw_mixer(43, 33, 30, "orange"),) * 3)


@query(f"select frame, y, x, {sql_rounded(A.skin_weight('(r / 655.35e0)', '(g / 32768e0)', '(b / 900e0)'), 6)} as w from {PX}")
def skin_weight(spark, sf_dir):
    return px(spark, sf_dir).select("frame", "y", "x", rounded(F.expr(A.skin_weight("(r / 655.35e0)", "(g / 32768e0)", "(b / 900e0)")), 6).alias("w"))


@query(f"with s as (select * from (values (10, 10), (25, 30), (40, 12)) t(sx, sy)) select frame, {', '.join(sql_rounded(f'avg({c})') + f' as {c}' for c in 'rgb')}, count(*) as n from {PX} join s on x between sx - 3 and sx + 3 and y between sy - 3 and sy + 3 where greatest(r, g, b) < 60000 group by frame")
def spot_white_balance(spark, sf_dir):
    rows = P.spot_white_balance(px(spark, sf_dir), [(10, 10), (25, 30), (40, 12)], 7, 60000.0)
    return rows.select("frame", *[rounded(c).alias(c) for c in "rgb"], "n")


_LENS_SQL = f"(select lens as lens, 1.0e0 + shot_id % 3 as crop, min(shot_id) as lens_id from {T.sql(T.SHOTS)} where shot_id % 5 <> 0 group by 1, 2)"


@query(f"""with l as {_LENS_SQL}, s as (select shot_id, lens, 1.2e0 + shot_id % 2 as crop from {T.sql(T.SHOTS)})
select s.shot_id, s.lens, arg_min(l.lens_id, (l.crop > s.crop, abs(l.crop - s.crop), l.lens_id)) as lens_id from s left join l on lower(l.lens) = lower(s.lens) group by 1, 2""")
def find_lens(spark, sf_dir):
    shots = T.table(spark, sf_dir, T.SHOTS)
    lenses = shots.where("shot_id % 5 <> 0").groupBy("lens", (1.0 + F.col("shot_id") % 3).alias("crop")).agg(F.min("shot_id").alias("lens_id"))
    return P.find_lens(shots.select("shot_id", F.upper("lens").alias("lens"), (1.2 + F.col("shot_id") % 2).alias("crop")), lenses).join(shots.select("shot_id", F.col("lens").alias("name")), "shot_id").select("shot_id", F.col("name").alias("lens"), "lens_id")


@query(f"select file, case when shot_id % 4 = 0 then 7 else 3 end as denoise, 'b' as mode, case when shot_id % 4 = 0 then rank end as sharpen from {T.sql(T.SHOTS)} where shot_id % 2 = 0")
def plan_jobs(spark, sf_dir):
    shots = T.table(spark, sf_dir, T.SHOTS)
    side = shots.where("shot_id % 2 = 0").select("file", F.when(F.col("shot_id") % 4 == 0, 7).alias("denoise"), F.when(F.col("shot_id") % 4 == 0, F.col("rank")).alias("sharpen"))
    return P.plan_jobs(shots.select("file"), [{"denoise": 1, "mode": "a"}, {"denoise": 3, "mode": "b"}], side)


_TABLE = [(10.0 * i - 15 + 5 * j, 0.8 + 0.1 * i, 0.9 + 0.05 * j) for i in range(4) for j in range(3)]


def _entry(i: int) -> str:
    """Bilinear read of one plane of the table at (h * 4, s * 2), hues wrapping."""
    values = "[" + ", ".join(S.num(t[i]) for t in _TABLE) + "]"
    at = lambda dh, ds: f"({values})[((hi + {dh}) % 4) * 3 + least(si + {ds}, 2) + 1]"
    return f"((1 - fh) * ((1 - fs) * {at(0, 0)} + fs * {at(0, 1)}) + fh * ((1 - fs) * {at(1, 0)} + fs * {at(1, 1)}))"


@query(
    f"""with u as (select frame, y, x, r / 65535e0 as r, g / 65535e0 as g, b / 65535e0 as b, greatest(r, g, b) / 65535e0 as v, (greatest(r, g, b) - least(r, g, b)) / 65535e0 as d from {PX}),
t as (select frame, y, x, v, case when d < 1e-5 then 0 else d / v end as s, case when d < 1e-5 then 0 when r = v and g < b then 1 + (g - b) / (6 * d) when r = v then (g - b) / (6 * d) when g = v then 1 / 3e0 + (b - r) / (6 * d) else 2 / 3e0 + (r - g) / (6 * d) end as h from u),
i as (select *, cast(floor(h * 4) as bigint) as hi, cast(least(floor(s * 2), 1) as bigint) as si, h * 4 - floor(h * 4) as fh, s * 2 - least(floor(s * 2), 1) as fs from t),
o as (select frame, y, x, h + {_entry(0)} / 360 as h, least(s * {_entry(1)}, 1) as s, v * {_entry(2)} as v from i)
select frame, y, x, {sql_rounded('h - floor(h)', 6)} as h, {sql_rounded('s', 6)} as s, {sql_rounded('v', 6)} as v from o"""
)
def hue_sat_table(spark, sf_dir):
    h, s, v = (F.expr(e) for e in S.hsv("r", "g", "b"))
    out = P.hue_sat_table(F.col("h"), F.col("s"), F.col("v"), _TABLE, 4, 3)
    return px(spark, sf_dir).select("frame", "y", "x", h.alias("h"), s.alias("s"), v.alias("v")).select("frame", "y", "x", *[rounded(c, 6).alias(n) for c, n in zip(out, "hsv", strict=True)])
