"""The query of colour temperature by correlation, and its SQL typed out by hand."""

from __future__ import annotations

from ..operators import temperature as N
from . import tables as T
from .registry import query, rounded, sql_rounded

_OBSERVER = {
    "xbar": "0.362e0 * {442.0, 0.0624, 0.0374} + 1.056e0 * {599.8, 0.0264, 0.0323} - 0.065e0 * {501.1, 0.049, 0.0382}",
    "ybar": "0.821e0 * {568.8, 0.0213, 0.0247} + 0.286e0 * {530.9, 0.0613, 0.0322}",
    "zbar": "1.217e0 * {437.0, 0.0845, 0.0278} + 0.681e0 * {459.0, 0.0385, 0.0725}",
}


def _bells(text: str) -> str:
    """{mean, slope below, slope above} as the half-widths of a bell."""
    import re

    return re.sub(r"\{([\d.]+), ([\d.]+), ([\d.]+)\}", r"exp(-0.5e0 * power((nm - \1e0) * case when nm < \1e0 then \2e0 else \3e0 end, 2))", text)


_LIST = {"s0": N.MEAN, "s1": N.YELLOW, "s2": N.PINK}
_XY = "(0.4360747e0 * r + 0.3850649e0 * g + 0.1430804e0 * b) as x, (0.2225045e0 * r + 0.7168786e0 * g + 0.0606169e0 * b) as y, (0.0139322e0 * r + 0.0971045e0 * g + 0.7141733e0 * b) as z"
_GX, _GY = ((0.4360747 + 0.3850649 + 0.1430804), (0.2225045 + 0.7168786 + 0.0606169))
_GT = _GX + _GY + 0.0139322 + 0.0971045 + 0.7141733


def _shown(source: str, keep: str) -> str:
    """Chromaticities sx, sy of ``source`` through a camera with multipliers mr, mg, mb."""
    inner = f"select {keep}, mr, mg, mb, mr * (c0 * sx + c1 * sy + c2 * (1 - sx - sy)) as r, mg * (c3 * sx + c4 * sy + c5 * (1 - sx - sy)) as g, mb * (c6 * sx + c7 * sy + c8 * (1 - sx - sy)) as b from {source}, inv"
    return f"select {keep}, mr, mg, mb, x / (x + y + z) as gx, y / (x + y + z) as gy from (select {keep}, mr, mg, mb, {_XY} from ({inner}))"


_SQL = f"""with m as (select 0.4360747e0 as a, 0.3850649e0 as b, 0.1430804e0 as c, 0.2225045e0 as d, 0.7168786e0 as e, 0.0606169e0 as f, 0.0139322e0 as g, 0.0971045e0 as h, 0.7141733e0 as i),
inv as (select (e * i - f * h) / k as c0, (c * h - b * i) / k as c1, (b * f - c * e) / k as c2, (f * g - d * i) / k as c3, (a * i - c * g) / k as c4, (c * d - a * f) / k as c5, (d * h - e * g) / k as c6, (b * g - a * h) / k as c7, (a * e - b * d) / k as c8 from (select *, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) as k from m)),
w as (select nm, {", ".join(f"[{', '.join(map(str, v))}][(nm - 370) // 10]::double as {k}" for k, v in _LIST.items())}, {", ".join(f"{_bells(v)} as {k}" for k, v in _OBSERVER.items())} from (select unnest(range(380, 781, 10)) as nm)),
t0 as (select unnest(range(2500, 12001, 500)) as t),
t1 as (select t, case when t <= 7000 then -4.607e9 / (t ^ 3) + 2.9678e6 / (t ^ 2) + 99.11e0 / t + 0.244063e0 else -2.0064e9 / (t ^ 3) + 1.9018e6 / (t ^ 2) + 247.48e0 / t + 0.23704e0 end as x from t0),
t2 as (select t, x, -3 * x * x + 2.87e0 * x - 0.275e0 as y from t1),
t3 as (select t, (-1.3515e0 - 1.7703e0 * x + 5.9114e0 * y) / (0.0241e0 + 0.2562e0 * x - 0.7341e0 * y) as m1, (0.03e0 - 31.4424e0 * x + 30.0717e0 * y) / (0.0241e0 + 0.2562e0 * x - 0.7341e0 * y) as m2 from t2),
p as (select t, nm, xbar, ybar, zbar, case when t < 4000 then 3.7417715247e-16 * power(nm * 1e-9, -5) / (exp(1.438786e-2 / (nm * 1e-9 * t)) - 1) else s0 + m1 * s1 + m2 * s2 end as power from t3, w),
white as (select t, sum(power * xbar) / sum(power * ybar) as x, 1e0 as y, sum(power * zbar) / sum(power * ybar) as z from p group by t),
l0 as (select t, 1 / (c0 * x + c1 * y + c2 * z) as mr, 1 / (c3 * x + c4 * y + c5 * z) as mg, 1 / (c6 * x + c7 * y + c8 * z) as mb from white, inv),
l as (select t, v as green, mr / greatest(mr, mg * v, mb) as mr, mg * v / greatest(mr, mg * v, mb) as mg, mb / greatest(mr, mg * v, mb) as mb from l0, (select unnest([0.95e0, 1e0, 1.05e0]) as v)),
k as (select s, s // 18 as kind, s % 18 // 2 as place, case when s % 2 = 0 then 25e0 else 60e0 end as wide, case when s % 2 = 0 then 8e0 else 25e0 end as soft from (select unnest(range(0, 72)) as s)),
r as (select t, s, xbar, ybar, zbar, power * (0.05e0 + 0.85e0 * case kind when 0 then exp(-(((nm - 420 - 30 * place) / wide) ** 2)) when 1 then 1 / (1 + exp(-(nm - 480 - 20 * place) / soft)) when 2 then 1 - 1 / (1 + exp(-(nm - 480 - 20 * place) / soft)) else 1 - 0.9e0 * exp(-(((nm - 460 - 20 * place) / wide) ** 2)) end) as v from p, k),
q as (select t, s, sum(v * xbar) as x, sum(v * ybar) as y, sum(v * zbar) as z from r group by t, s),
surface as (select t, s, x / (x + y + z) as sx, y / (x + y + z) as sy from q),
one as (select mr, mg, mb from l where t = 5000 and green = 1),
c0 as (select frame, px.r as r0, px.g as g0, px.b as b0, px.r * mr as r, px.g * mg as g, px.b * mb as b from {T.sql(T.PIXELS)} px, one where px.y % 3 = 0 and px.x % 3 = 0 and greatest(px.r, px.g, px.b) < 64000 and least(px.r, px.g, px.b) > 0),
c1 as (select frame, r0, g0, b0, {_XY} from c0),
c2 as (select frame, floor(x / (x + y + z) / 0.01e0) as i, floor(y / (x + y + z) / 0.01e0) as j, count(*) as n, avg(r0) as r, avg(g0) as g, avg(b0) as b from c1 group by 1, 2, 3),
c3 as (select frame, i, j, n, r0, g0, b0, {_XY} from (select frame, i, j, n, r as r0, g as g0, b as b0, r * mr as r, g * mg as g, b * mb as b from c2, one)),
c4 as (select frame, i, j, r0, g0, b0, n, x / (x + y + z) as ix, y / (x + y + z) as iy from c3),
c5 as (select *, row_number() over (partition by frame order by sqrt((ix - {_GX / _GT!r}e0) ** 2 + (iy - {_GY / _GT!r}e0) ** 2) * n ** 0.05e0 desc, i, j) as rank from c4),
seen as ({_shown("(select s, sx, sy, mr, mg, mb from surface, one where t = 5000)", "s")}),
pair as (select frame, i, j, any_value(r0) as r, any_value(g0) as g, any_value(b0) as b, arg_min(s, ((ix - gx) ** 2 + (iy - gy) ** 2, s)) as s from c5, seen where rank <= 40 group by 1, 2, 3),
under as ({_shown("(select surface.t as t, green, s, sx, sy, mr, mg, mb from surface join l on l.t = surface.t)", "t, green, s")}),
h0 as (select frame, t, green, gx, gy, {_XY} from (select frame, t, green, gx, gy, r * mr as r, g * mg as g, b * mb as b from pair join under using (s))),
h as (select frame, t, green, x / (x + y + z) as a, gx as b from h0 union all select frame, t, green, y / (x + y + z), gy from h0),
st as (select frame, t, green, abs((avg(a) - avg(b)) / nullif(sqrt(((count(*) - 1) * var_samp(a) + (count(*) - 1) * var_samp(b)) / (2 * count(*) - 2) * 2 / count(*)), 0)) as v from h group by 1, 2, 3),
best as (select frame, arg_min({{'t': t, 'g': green, 'v': v}}, (v, abs(green - 1), abs(t - 5000), t)) as w from st where v is not null group by frame)
select f.frame, cast(w.t as int) as temperature, {sql_rounded('w.g', 2)} as green, {sql_rounded('w.v', 4)} as t, (select count(*) from c5 where c5.frame = f.frame and rank <= 40) as colors
from (select distinct frame from {T.sql(T.PIXELS)}) f left join best on best.frame = f.frame"""


@query(_SQL)
def correlated_temperature(spark, sf_dir):
    """Twenty temperatures by three tints against 72 surfaces for every frame."""
    rows = N.correlated_temperature(T.table(spark, sf_dir, T.PIXELS), list(range(2500, 12001, 500)), (0.95, 1.0, 1.05))
    return rows.select("frame", "temperature", rounded("green", 2).alias("green"), rounded("t", 4).alias("t"), "colors")
