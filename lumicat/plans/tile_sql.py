"""SQL of the queries over tiles and whole frames, typed out: nothing here comes from the operators.  Frames repeat their edges."""

from __future__ import annotations

from . import tables as T
from .registry import sql_rounded

PX = T.sql(T.PIXELS)


def _near(columns: str, source: str, dy: str, dx: str, reflect: bool = False) -> str:
    """(frame, y, x, dy, dx, c_<column>, n_<column>): each place and its neighbours at the offsets (dy, dx: SQL lists); beyond an
    edge the edge's samples repeat, or are mirrored."""

    def at(p: str, d: str, m: str) -> str:
        if reflect:
            return f"case when {p} + {d} < 0 then -{p} - {d} when {p} + {d} > {m} then 2 * {m} - {p} - {d} else {p} + {d} end"
        return f"least(greatest({p} + {d}, 0), {m})"

    names = columns.split()
    places = f"select *, max(y) over (partition by frame) as my, max(x) over (partition by frame) as mx from {source}"
    offsets = f"select *, {at('y', 'dy', 'my')} as ny, {at('x', 'dx', 'mx')} as nx from ({places}) cross join (select unnest({dy}) as dy) cross join (select unnest({dx}) as dx)"
    return f"(select p.frame, p.y, p.x, p.dy, p.dx, {', '.join(f'p.{c} as c_{c}, q.{c} as n_{c}' for c in names)} from ({offsets}) p join {source} q on q.frame = p.frame and q.y = p.ny and q.x = p.nx)"


def _taps(columns: str, source: str, offsets: str, weight: str, reflect: bool = False) -> str:
    """(frame, y, x, columns): weighted means along rows, then along columns; ``weight`` in terms of k."""
    names = columns.split()

    def one(s: str, dy: str, dx: str) -> str:
        w = weight.replace("k", "dx" if dy == "[0]" else "dy")
        return f"(select frame, y, x, {', '.join(f'sum(n_{c} * {w}) / sum({w}) as {c}' for c in names)} from {_near(columns, s, dy, dx, reflect)} group by 1, 2, 3)"

    return one(one(source, "[0]", offsets), offsets, "[0]")


def _gauss(columns: str, source: str, sigma: str, radius: int) -> str:
    return _taps(columns, source, f"range(-{radius}, {radius + 1})", f"exp(-k * k / (2e0 * {sigma} * {sigma}))")


BILATERAL = f"""with n as (select *, exp(-(dy * dy + dx * dx) / (2 * 1.5e0 * 1.5e0) - (n_r - c_r) * (n_r - c_r) / (2 * 8000e0 * 8000e0)) as w from {_near('r', PX, 'range(-3, 4)', 'range(-3, 4)')})
select frame, y, x, {sql_rounded('sum(w * n_r) / sum(w)', 3)} as o from n group by 1, 2, 3"""

FALSE_COLOR = f"""with p as (select frame, y, x, 0.299e0 * r + 0.587e0 * g + 0.114e0 * b as l, r - (0.299e0 * r + 0.587e0 * g + 0.114e0 * b) as i, b - (0.299e0 * r + 0.587e0 * g + 0.114e0 * b) as q from {PX}),
m as (select frame, y, x, median(n_i) as i, median(n_q) as q from {_near('i q', 'p', '[-1, 0, 1]', '[-1, 0, 1]')} group by 1, 2, 3),
n as (select frame, y, x, median(n_i) as i, median(n_q) as q from {_near('i q', 'm', '[-1, 0, 1]', '[-1, 0, 1]')} group by 1, 2, 3)
select p.frame, p.y, p.x, {sql_rounded('l + n.i', 3)} as r, {sql_rounded('l - (0.299e0 * n.i + 0.114e0 * n.q) / 0.587e0', 3)} as g, {sql_rounded('l + n.q', 3)} as b from p join n using (frame, y, x)"""


def _edge_pass(source: str) -> str:
    near = _near("r", source, "[-1, 0, 1]", "[-1, 0, 1]")
    at = lambda dy, dx: f"max(n_r) filter (dy = {dy} and dx = {dx})"
    step = f"select frame, y, x, max(c_r) as r, ({at(1, 0)} - {at(-1, 0)}) / 2 as gy, ({at(0, 1)} - {at(0, -1)}) / 2 as gx, {at(1, 0)} - 2 * max(c_r) + {at(-1, 0)} as yy, {at(0, 1)} - 2 * max(c_r) + {at(0, -1)} as xx from {near} group by 1, 2, 3"
    return f"(select frame, y, x, r - 0.2e0 * case when gy * gy + gx * gx > 0 then (gy * gy * yy + gx * gx * xx) / greatest(gy * gy + gx * gx, 1e-12) else 0 end as r from ({step}))"


EDGE_SHARPEN = f"""with a as {_edge_pass(PX)}, b as {_edge_pass('a')},
n as (select frame, y, x, max(c_r) as r, stddev_pop(n_r) filter (dy <> 0 or dx <> 0) as spread, avg(n_r) filter (abs(dy) + abs(dx) = 1) as m from {_near('r', 'b', '[-1, 0, 1]', '[-1, 0, 1]')} group by 1, 2, 3)
select frame, y, x, {sql_rounded('r + 0.3e0 * (r - m) / (1 + 1e0 * spread / (abs(r) + 1))', 3)} as o from n"""


def _directional(source: str, step: int) -> str:
    w = "(1000e0 / (abs(n_r - c_r) + 1000e0))"
    offsets = f"[{-2 * step}, {-step}, 0, {step}, {2 * step}]"
    return f"(select frame, y, x, sum({w} * n_r) / sum({w}) as r from {_near('r', source, offsets, offsets)} group by 1, 2, 3)"


PYRAMID = f"""with p as (select frame, y, x, r from {PX}), a as {_directional('p', 1)}, b as {_directional('a', 2)}, c as {_directional('b', 4)},
d as (select frame, y, x, p.r - a.r as d1, a.r - b.r as d2, b.r - c.r as d3, c.r as rest from p join a using (frame, y, x) join b using (frame, y, x) join c using (frame, y, x))
select frame, y, x, {sql_rounded('rest + d1 * (1 + 0.3e0 * least(abs(d1) / 500, 1)) + d2 * (1 + 0.1e0 * least(abs(d2) / 500, 1)) + d3', 3)} as o from d"""

RETINEX = f"""with p as (select frame, y, x, greatest(r, 1e-3) as r from {PX}), a as {_gauss('r', 'p', '2e0', 6)}, b as {_gauss('r', 'p', '6e0', 18)},
k as (select frame, y, x, p.r as v, (ln(p.r) - ln(greatest(a.r, 1e-3)) + ln(p.r) - ln(greatest(b.r, 1e-3))) / 2 as k from p join a using (frame, y, x) join b using (frame, y, x)),
s as (select frame, avg(v) as mv, stddev_pop(v) as sv, max(v) as top, avg(k) as mk, stddev_pop(k) as sk from k group by 1)
select frame, y, x, {sql_rounded('least(greatest(mv + sv * (k - mk) / sk, 0), top)', 3)} as o from k join s using (frame)"""


def _lines(source: str, across: str) -> str:
    m = f"select frame, {across} as at, avg(v) as m, max({across}) over (partition by frame) as top from {source} group by frame, {across}"
    smooth = f"select p.frame, p.at, any_value(p.m) as m, sum(q.m * exp(-k * k / 18e0)) / sum(exp(-k * k / 18e0)) as s from ({m}) p cross join (select unnest(range(-9, 10)) as k) join ({m}) q on q.frame = p.frame and q.at = least(greatest(p.at + k, 0), p.top) group by 1, 2"
    return f"(select t.frame, t.y, t.x, t.v - least(greatest(m - s, -2000), 2000) as v from {source} t join ({smooth}) o on o.frame = t.frame and o.at = t.{across})"


LINE_DENOISE = f"""with p as (select frame, y, x, v from {PX}), a as {_lines('p', 'y')} select frame, y, x, {sql_rounded('v', 3)} as o from {_lines('a', 'x')}"""

DEFRINGE = f"""with p as (select frame, y, x, g - 32768e0 as a, b - 32768e0 as b from {PX}), s as {_gauss('a b', 'p', '2e0', 6)},
c as (select frame, y, x, p.a, p.b, power(p.a - s.a, 2) + power(p.b - s.b, 2) as c from p join s using (frame, y, x)),
l as (select *, 1.3e0 * avg(c) over (partition by frame) as l from c), w as (select *, 1 / (c + l / 33 + 1e-12) as w from l),
n as (select frame, y, x, sum(n_w * n_a) / sum(n_w) as na, sum(n_w * n_b) / sum(n_w) as nb from {_near('w a b', 'w', 'range(-4, 5)', 'range(-4, 5)')} group by 1, 2, 3)
select frame, y, x, {sql_rounded('case when c > l then na else a end', 3)} as a, {sql_rounded('case when c > l then nb else b end', 3)} as b from w join n using (frame, y, x)"""


def _smooth(source: str, step: int) -> str:
    return _taps("r", source, f"[{-2 * step}, {-step}, 0, {step}, {2 * step}]", f"(case abs(k) when 0 then 6e0 when {step} then 4e0 else 1e0 end / 16)", True)


# the deviation of a level's noise: the middle of the first of 256 bins an octave with half of the frame's magnitudes
_LEVELS = f"""p as (select frame, y, x, r from {PX}), a as {_smooth('p', 1)}, b as {_smooth('a', 2)}, c as {_smooth('b', 4)},
d as (select frame, y, x, p.r - a.r as d0, a.r - b.r as d1, b.r - c.r as d2, c.r as rest from p join a using (frame, y, x) join b using (frame, y, x) join c using (frame, y, x)),
h as (select frame, c, bin, sum(count(*)) over (partition by frame, c order by bin nulls first) as cum, sum(count(*)) over (partition by frame, c) as total
  from (select frame, unnest(['d0', 'd1', 'd2']) as c, unnest([abs(d0), abs(d1), abs(d2)]) as v from d) t, lateral (select case when v > 0 then floor(log2(v) * 256) end as bin) group by 1, 2, 3),
q as (select frame, c, min(coalesce(power(2e0, (bin + 0.5e0) / 256), 0)) filter (2 * cum >= total) / 0.6745e0 as n from h group by 1, 2),
n as (select frame, max(n) filter (c = 'd0') as n0, max(n) filter (c = 'd1') as n1, max(n) filter (c = 'd2') as n2 from q group by 1)"""
WAVELET = f"""with {_LEVELS}
select frame, y, x, {sql_rounded('rest + 1.4e0 * (d0 * d0 / (d0 * d0 + 4 * n0 * n0 + 1e-30) * d0) + 1.2e0 * (d1 * d1 / (d1 * d1 + n1 * n1 + 1e-30) * d1) + d2', 3)} as o from d join n using (frame)"""


def _factor(k: int, sigma: str, radius: int) -> str:
    f = f"d{k} * d{k} / (d{k} * d{k} + n{k} * n{k} * exp(-d{k} * d{k} / (9 * n{k} * n{k} + 1e-30)) + 1e-30)"
    return _gauss(f"f{k}", f"(select frame, y, x, {f} as f{k} from d join n using (frame))", sigma, radius)


SHRINKAGE = f"""with {_LEVELS}, f0 as {_factor(0, '1e0', 3)}, f1 as {_factor(1, '1.5e0', 5)}, f2 as {_factor(2, '2e0', 6)}
select frame, y, x, {sql_rounded('rest + f0 * d0 + f1 * d1 + f2 * d2', 3)} as o from d join f0 using (frame, y, x) join f1 using (frame, y, x) join f2 using (frame, y, x)"""


def _box(columns: dict[str, str], radius: int, source: str, f: str = "avg") -> str:
    first = ", ".join(f"{f}({i}) over (partition by frame, y order by x rows between {radius} preceding and {radius} following) as h_{o}" for o, i in columns.items())
    second = ", ".join(f"{f}(h_{o}) over (partition by frame, x order by y rows between {radius} preceding and {radius} following) as {o}" for o in columns)
    return f"(select *, {second} from (select *, {first} from {source}))"


def _guided(guide: str, source_column: str, out: str, radius: int, eps: str, source: str) -> str:
    first = _box({"mg": guide, "ms": source_column, "mgs": "gs", "mgg": "gg"}, radius, f"(select *, {guide} * {source_column} as gs, {guide} * {guide} as gg from {source})")
    fit = f"(select *, ms - ca * mg as cb from (select *, (mgs - mg * ms) / (mgg - mg * mg + {eps}) as ca from {first}))"
    return f"(select *, ma * {guide} + mb as {out} from {_box({'ma': 'ca', 'mb': 'cb'}, radius, fit)})"


SHADOWS_HIGHLIGHTS = f"""with m as (select *, least(greatest(m, 0), 1) as k from {_guided('l', 'l', 'm', 4, '0.005e0', f'(select *, r / 65535 as l from {PX})')})
select frame, y, x, {sql_rounded('r * power(2e0, 30 / 100e0 * power(1 - k, 4) - 40 / 100e0 * power(k, 4))', 3)} as v from m"""

# fifteen bands of two stops; the gains' five values repeat towards both sides
_BANDS = "(select unnest(range(15)) * 2e0 - 16 as centre, unnest([20, 20, 10, 10, 10, 10, 0, 0, 0, -10, -10, -10, -10, -20, -20]) as gain)"
TONE_EQUALIZER = f"""with p as (select *, log2(greatest((0.2126729e0 * r + 0.7151521e0 * g + 0.0721750e0 * b) / 65535, power(2e0, -18))) as l from {PX}), m as {_guided('l', 'l', 'm', 3, '0.01e0', 'p')},
w as (select frame, y, x, sum(exp(-power(m - centre, 2) / 8) * power(2e0, gain / 100e0 * 2)) / sum(exp(-power(m - centre, 2) / 8)) as k from m cross join {_BANDS} group by 1, 2, 3)
select frame, y, x, {', '.join(sql_rounded(f'{c} * k', 3) + f' as {c}' for c in 'rgb')} from p join w using (frame, y, x)"""


def _shrinking(column: str, source: str, sigma: str, radius: int) -> str:
    """Gaussian weights renormalised at the edges."""
    for along, across in (("x", "y"), ("y", "x")):
        source = f"(select p.frame, p.y, p.x, sum(q.{column} * exp(-power(q.{along} - p.{along}, 2) / (2 * {sigma} * {sigma}))) / sum(exp(-power(q.{along} - p.{along}, 2) / (2 * {sigma} * {sigma}))) as {column} from {source} p join {source} q on q.frame = p.frame and q.{across} = p.{across} and q.{along} between p.{along} - {radius} and p.{along} + {radius} group by 1, 2, 3)"
    return source


IMPULSE_DENOISE = f"""with p as (select frame, y, x, r from {PX}), h as (select frame, y, x, p.r, abs(p.r - s.r) as h from p join {_shrinking('r', 'p', '1.5e0', 5)} s using (frame, y, x)),
n as (select a.frame, a.y, a.x, any_value(a.r) as r, any_value(a.h) * (count(*) - 1) > 4 * (sum(b.h) - any_value(a.h)) as bad from h a join h b on a.frame = b.frame and b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2 group by 1, 2, 3),
m as (select a.frame, a.y, a.x, avg(b.r) filter (not b.bad) as m from n a join n b on a.frame = b.frame and b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2 group by 1, 2, 3)
select frame, y, x, {sql_rounded('case when bad then coalesce(m, r) else r end', 3)} as v from n join m using (frame, y, x)"""

_GUESS = {"r": "power((ng + nb) / 2, 3)", "g": "power((nr + nb) / 2, 3)", "b": "power((nr + ng) / 2, 3)"}
RECOVER_OPPOSED = f"""with n as {_box({'nr': 'mr', 'ng': 'mg', 'nb': 'mb'}, 1, f'(select *, cbrt(greatest(r, 0)) as mr, cbrt(greatest(g, 0)) as mg, cbrt(greatest(b, 0)) as mb, case when greatest(r, g, b) >= 60000 then 1 else 0 end as hit from {PX})')},
m as {_box({'near': 'hit'}, 3, 'n', 'max')},
s as (select frame, {', '.join(f"coalesce(avg({c} - {_GUESS[c]}) filter (near = 1 and {c} < 60000 and {c} > 0.2e0 * 60000), 0) as s{c}" for c in 'rgb')} from m group by 1)
select frame, y, x, {', '.join(sql_rounded(f'case when {c} >= 60000 then greatest({c}, {_GUESS[c]} + s{c}) else {c} end', 3) + f' as {c}' for c in 'rgb')} from m join s using (frame)"""

BLEND_HIGHLIGHTS = f"""with c as (select *, least(r, 60000) as cr, least(g, 60000) as cg, least(b, 60000) as cb from {PX}),
k as (select *, sqrt(3e0) * (r - g) as c1, 2 * b - r - g as c2, sqrt(3e0) * (cr - cg) as k1, 2 * cb - cr - cg as k2, (r + g + b) / 3 as l from c),
s as (select *, case when c1 * c1 + c2 * c2 > 0 then sqrt((k1 * k1 + k2 * k2) / (c1 * c1 + c2 * c2)) else 1 end as s, greatest(r, g, b) > 57000 as hit from k)
select frame, y, x, {sql_rounded('case when hit then l - s * c2 / 6 + s * c1 / (2 * sqrt(3e0)) else r end', 3)} as o_r, {sql_rounded('case when hit then l - s * c2 / 6 - s * c1 / (2 * sqrt(3e0)) else g end', 3)} as o_g, {sql_rounded('case when hit then l + s * c2 / 3 else b end', 3)} as o_b from s"""

_SPREAD = " + ".join(f"abs({k}{i} - {k}{j})" for k in "os" for i in range(4) for j in range(i))
_GUESS = [f"(o{k} + (v - p{k}) / 2) / (1 + (v - p{k}) ** 2 + (q{k} - o{k}) ** 2)" for k in range(4)], [f"1 / (1 + (v - p{k}) ** 2 + (q{k} - o{k}) ** 2)" for k in range(4)]
_PICK = ", ".join(f"any_value(n_v) filter (dy = {dy} and dx = {dx}) as {n}" for k, (a, b) in enumerate([(-1, -1), (-1, 1), (1, -1), (1, 1)]) for n, dy, dx in ((f"o{k}", a, b), (f"p{k}", 2 * a, 2 * b), (f"q{k}", 3 * a, 3 * b)))
_SAME = ", ".join(f"any_value(n_v) filter (dy = {dy} and dx = {dx}) as s{k}" for k, (dy, dx) in enumerate([(-2, 0), (2, 0), (0, -2), (0, 2)]))
GREEN_LOCAL = f"""with n as (select frame, y, x, any_value(c_v) as v, any_value(c_c) as c, {_PICK}, {_SAME} from {_near('v c', PX, '[-3, -2, -1, 0, 1, 2, 3]', '[-3, -2, -1, 0, 1, 2, 3]')} group by 1, 2, 3),
e as (select frame, max(y) as my, max(x) as mx from {PX} group by 1),
g as (select n.*, case when c = 1 and y >= 4 and y <= my - 4 and x >= 4 and x <= mx - 6 and {_SPREAD} < 6 * 0.6e0 * abs(o0 + o1 + o2 + o3 - s0 - s1 - s2 - s3) then ({' + '.join(_GUESS[0])}) / ({' + '.join(_GUESS[1])}) end as g from n join e using (frame))
select frame, y, x, {sql_rounded('case when g - v < 0.6e0 * (g + v) then (g + v) / 2 else v end', 6)} as v from g"""

_W = "(case abs(dy) + abs(dx) when 1 then 0.5e0 else 0.25e0 end)"
_XT = ", ".join(f"sum(case when n_c = {i} then n_v * {_W} end) filter (inside) / sum(case when n_c = {i} then {_W} end) filter (inside) as m{i}" for i in range(3))
XTRANS_FAST = f"""with n as (select k.*, k.y + dy between 0 and my and k.x + dx between 0 and mx and (dy <> 0 or dx <> 0) as inside from {_near('v c', PX, '[-1, 0, 1]', '[-1, 0, 1]')} k join (select frame, max(y) as my, max(x) as mx from {PX} group by 1) using (frame)),
m as (select frame, y, x, any_value(c_v) as v, any_value(c_c) as c, {_XT} from n group by 1, 2, 3)
select frame, y, x, {', '.join(sql_rounded(f'case when c = {i} then v else m{i} end', 6) + f' as {n}' for i, n in enumerate('rgb'))} from m"""

MONO = f"select frame, y, x, v as r, v as g, v as b from {PX}"

DEHAZE = f"""with p as (select *, y // 5 as ty, x // 5 as tx from {PX}), l as (select frame, ty, tx, least(min(r), min(g), min(b)) as l from p group by 1, 2, 3), e as (select frame, quantile_cont(l, 0.95) as e from l group by 1),
k as (select frame, ty, tx from l join e using (frame) where l >= e), a as (select frame, greatest(avg(r), 1) as ar, greatest(avg(g), 1) as ag, greatest(avg(b), 1) as ab from p join k using (frame, ty, tx) group by 1),
d as (select frame, ty, tx, least(min(r / ar), min(g / ag), min(b / ab)) as d from p join a using (frame) group by 1, 2, 3),
t as (select frame, y, x, r, g, b, ar, ag, ab, (0.2126729e0 * r + 0.7151521e0 * g + 0.0721750e0 * b) / 65535 as l, 1 - 0.6e0 * least(greatest(d, 0), 1) as t from p join a using (frame) join d using (frame, ty, tx)),
m as (select *, greatest(m, 0.1e0) as k from {_guided('l', 't', 'm', 4, '1e-4', 't')})
select frame, y, x, {', '.join(sql_rounded(f'({c} - a{c}) / k + a{c}', 3) + f' as {c}' for c in 'rgb')} from m"""

# ---- mosaics: red at even rows and columns, blue at odd ones; mirrored edges keep parity

# whole numbers, so that results have few digits and rounding has no ties
_WHOLE = f"(select frame, y, x, r as v from {PX})"
_R, _B = "(y % 2 = 0 and x % 2 = 0)", "(y % 2 = 1 and x % 2 = 1)"
_NR, _NB = (f"(abs(y + dy) % 2 = {k} and abs(x + dx) % 2 = {k})" for k in (0, 1))
_TENT = "(case abs(dy) + abs(dx) when 0 then 1e0 when 1 then 0.5e0 else 0.25e0 end)"
_NEAR1, _NEAR2 = "[-1, 0, 1]", "[-2, -1, 0, 1, 2]"


def _pick(**at: tuple[int, int]) -> str:
    return ", ".join(f"any_value(n_v) filter (dy = {dy} and dx = {dx}) as {n}" for n, (dy, dx) in at.items())


ADAPTIVE_DEMOSAIC = f"""with n as (select frame, y, x, any_value(c_v) as v, {_pick(w1=(0, -1), e1=(0, 1), w2=(0, -2), e2=(0, 2), n1=(-1, 0), s1=(1, 0), n2=(-2, 0), s2=(2, 0))} from {_near('v', _WHOLE, _NEAR2, _NEAR2, True)} group by 1, 2, 3),
d as (select *, (w1 + e1) / 2 + (2 * v - w2 - e2) / 4 as along, (n1 + s1) / 2 + (2 * v - n2 - s2) / 4 as down, abs(w1 - e1) + abs(2 * v - w2 - e2) as dx, abs(n1 - s1) + abs(2 * v - n2 - s2) as dy from n),
g as (select frame, y, x, v, case when (y + x) % 2 = 1 then v when dx < dy then along when dy < dx then down else (along + down) / 2 end as g from d),
m as (select frame, y, x, any_value(c_v) as v, any_value(c_g) as g, sum({_TENT} * (n_v - n_g)) filter ({_NR}) / sum({_TENT}) filter ({_NR}) as dr, sum({_TENT} * (n_v - n_g)) filter ({_NB}) / sum({_TENT}) filter ({_NB}) as db from {_near('v g', 'g', _NEAR1, _NEAR1, True)} group by 1, 2, 3)
select frame, y, x, {sql_rounded(f'case when {_R} then v else g + dr end', 6)} as r, {sql_rounded('g', 6)} as g, {sql_rounded(f'case when {_B} then v else g + db end', 6)} as b from m"""

_NG = f"(not {_NR} and not {_NB})"
_COLORS = {"r": (_R, _NR), "g": (f"(not {_R} and not {_B})", _NG), "b": (_B, _NB)}
_BASE = ", ".join(f"case when {mine} then any_value(c_v) else sum({_TENT} * n_v) filter ({near}) / sum({_TENT}) filter ({near}) end as b{c}" for c, (mine, near) in _COLORS.items())
_WAYS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
_GRADIENTS = ", ".join(f"abs(p{k} - v) + abs(o{k} - o{7 - k}) as g{k}" for k in range(8))
_SUMS = ", ".join(f"({' + '.join(f'case when g{k} <= most then (q{c}{k} + b{c}) / 2 else 0 end' for k in range(8))}) / ({' + '.join(f'case when g{k} <= most then 1 else 0 end' for k in range(8))}) as m{c}" for c in "rgb")
_SHIFTED = ", ".join(f"any_value(n_{n}) filter (dy = {f * a} and dx = {f * b}) as {p}{k}" for k, (a, b) in enumerate(_WAYS) for n, p, f in (("v", "o", 1), ("v", "p", 2), ("br", "qr", 1), ("bg", "qg", 1), ("bb", "qb", 1)))
VNG_DEMOSAIC = f"""with b as (select frame, y, x, any_value(c_v) as v, {_BASE} from {_near('v', _WHOLE, _NEAR1, _NEAR1, True)} group by 1, 2, 3),
n as (select frame, y, x, any_value(c_v) as v, any_value(c_br) as br, any_value(c_bg) as bg, any_value(c_bb) as bb, {_SHIFTED} from {_near('v br bg bb', 'b', _NEAR2, _NEAR2, True)} group by 1, 2, 3),
g as (select *, {_GRADIENTS} from n),
l as (select *, least({", ".join(f"g{k}" for k in range(8))}) * 1.5e0 + 0.5e0 * (greatest({", ".join(f"g{k}" for k in range(8))}) - least({", ".join(f"g{k}" for k in range(8))})) as most from g),
m as (select frame, y, x, v, {_SUMS} from l),
o as (select *, case when {_R} then mr when {_B} then mb else mg end as own from m)
select frame, y, x, {", ".join(sql_rounded(f'case when {mine} then v else v + m{c} - own end', 6) + f" as {c}" for c, (mine, _) in _COLORS.items())} from o"""

_FOUR = "[-4, -3, -2, -1, 0, 1, 2, 3, 4]"
_SIDES = [(0, -1), (0, 1), (-1, 0), (1, 0)]
_LINE = ", ".join(f"any_value(n_v) filter (dy = {f * a} and dx = {f * b}) as v{k}{f}" for k, (a, b) in enumerate(_SIDES) for f in (1, 2, 3)) + ", " + ", ".join(f"any_value(n_low) filter (dy = {2 * a} and dx = {2 * b}) as l{k}" for k, (a, b) in enumerate(_SIDES))
_ESTIMATES = ", ".join(f"v{k}1 * (1 + (low - l{k}) / (1e-5 + low + l{k})) as e{k}, 1e-5 + abs(v{k}1 - v{k ^ 1}1) + abs(v - v{k}2) + abs(v{k}1 - v{k}3) as g{k}" for k in range(4))
RATIO_DEMOSAIC = f"""with l as (select frame, y, x, any_value(c_v) as v, sum({_TENT} * n_v) / 4 as low from {_near('v', _WHOLE, _NEAR1, _NEAR1, True)} group by 1, 2, 3),
n as (select frame, y, x, any_value(c_v) as v, any_value(c_low) as low, {_LINE} from {_near('v low', 'l', _FOUR, _FOUR, True)} where dy = 0 or dx = 0 group by 1, 2, 3),
e as (select *, {_ESTIMATES}, v03 - 3 * v01 + 3 * v11 - v13 as rh, v23 - 3 * v21 + 3 * v31 - v33 as rv from n),
k as (select frame, y, x, v, (e0 * g1 + e1 * g0) / (g0 + g1) as along, (e2 * g3 + e3 * g2) / (g2 + g3) as down, rh, rv from e),
q as (select frame, y, x, any_value(c_v) as v, any_value(c_along) as along, any_value(c_down) as down, sum(n_rh * n_rh) + 1e-9 as a, sum(n_rv * n_rv) + 1e-9 as b from {_near('v along down rh rv', 'k', _NEAR1, _NEAR1, True)} group by 1, 2, 3),
g as (select frame, y, x, v, case when (y + x) % 2 = 1 then v else b / (a + b) * along + a / (a + b) * down end as g from q),
m as (select frame, y, x, any_value(c_v) as v, any_value(c_g) as g, sum({_TENT} * (n_v - n_g)) filter ({_NR}) / sum({_TENT}) filter ({_NR}) as dr, sum({_TENT} * (n_v - n_g)) filter ({_NB}) / sum({_TENT}) filter ({_NB}) as db from {_near('v g', 'g', _NEAR1, _NEAR1, True)} group by 1, 2, 3)
select frame, y, x, {sql_rounded(f'case when {_R} then v else g + dr end', 3)} as r, {sql_rounded('g', 3)} as g, {sql_rounded(f'case when {_B} then v else g + db end', 3)} as b from m"""

# ---- the recursive Gaussian of width 3, published coefficients: forward and backward along columns, then along rows
_Q = 0.98711 * 3 - 0.96330
_B0 = 1.57825 + 2.44413 * _Q + 1.4281 * _Q**2 + 0.422205 * _Q**3
_BACK = ((2.44413 * _Q + 2.85619 * _Q**2 + 1.26661 * _Q**3) / _B0, -(1.4281 * _Q**2 + 1.26661 * _Q**3) / _B0, 0.422205 * _Q**3 / _B0)


def _sweep(name: str, source: str, back: bool) -> str:
    """A recursive CTE along ``pos`` of each (frame, line) of ``source``; the first sample stands for all before it."""
    first = f"pos = (select max(pos) from {source} m where m.frame = s.frame)" if back else "pos = 0"
    terms = " + ".join(f"({b!r}e0) * f.w{i}" for i, b in enumerate(_BACK, 1))
    return f"""{name} as (select frame, line, pos, v as w1, v as w2, v as w3 from {source} s where {first}
union all select s.frame, s.line, s.pos, {1 - sum(_BACK)!r}e0 * s.v + {terms}, f.w1, f.w2 from {name} f join {source} s on s.frame = f.frame and s.line = f.line and s.pos = f.pos {'-' if back else '+'} 1)"""


GAUSSIAN_RECURSIVE = f"""with recursive a0 as (select frame, x as line, y as pos, r as v from {PX}), {_sweep('a1', 'a0', False)},
a2 as (select frame, line, pos, w1 as v from a1), {_sweep('a3', 'a2', True)},
c0 as (select frame, pos as line, line as pos, w1 as v from a3), {_sweep('c1', 'c0', False)},
c2 as (select frame, line, pos, w1 as v from c1), {_sweep('c3', 'c2', True)}
select frame, line as y, pos as x, {sql_rounded('w1', 3)} as o from c3"""

# ---- grain: a hash of the lattice's corners in 64-bit arithmetic, blended smoothly; three samples a cell
_WRAP = "18446744073709551616::hugeint"
GRAIN = f"""with p as (select frame, y, x, r, y / 3e0 - floor(y / 3e0) as fy, x / 3e0 - floor(x / 3e0) as fx, cast(floor(y / 3e0) as bigint) as iy, cast(floor(x / 3e0) as bigint) as ix from {PX}),
c as (select p.*, dy, dx, xor((((iy + dy)::hugeint * 11400714819323198485::hugeint) % {_WRAP})::ubigint, (((ix + dx)::hugeint * 14029467366897019727::hugeint) % {_WRAP})::ubigint) as h0 from p cross join (select unnest([0, 1]) as dy) cross join (select unnest([0, 1]) as dx)),
h as (select *, xor(h0, h0 >> 29) as h1 from c),
m as (select *, ((((h1 >> 32)::hugeint * 13787848793156543929::hugeint) % 4294967296::hugeint * 4294967296::hugeint + (h1 & 4294967295)::hugeint * 13787848793156543929::hugeint) % {_WRAP})::ubigint as h2 from h),
v as (select *, xor(h2, h2 >> 32)::double / 9223372036854775808e0 - 1 as noise, fy * fy * (3 - 2 * fy) as ty, fx * fx * (3 - 2 * fx) as tx from m)
select frame, y, x, {sql_rounded('any_value(r) + 900 * sum(noise * (case dy when 1 then ty else 1 - ty end) * (case dx when 1 then tx else 1 - tx end))', 3)} as o from v group by frame, y, x"""

# ---- ten rounds of damped deconvolution by a Gaussian of 0.8, seven taps, edges repeated


def _taps(column: str, along: str) -> str:
    from math import exp

    weights = [exp(-(k * k) / (2 * 0.8**2)) for k in range(-3, 4)]
    across = "x" if along == "y" else "y"
    w = f"(partition by frame, {across} order by {along})"
    whole = f"(partition by frame, {across} order by {along} rows between unbounded preceding and unbounded following)"
    side = {-1: lambda k: f"coalesce(lag({column}, {k}) over {w}, first_value({column}) over {whole})", 1: lambda k: f"coalesce(lead({column}, {k}) over {w}, last_value({column}) over {whole})"}
    return " + ".join(f"({weight / sum(weights)!r}e0) * {column if k == 0 else side[1 if k > 0 else -1](abs(k))}" for k, weight in zip(range(-3, 4), weights, strict=True))


def _round(i: int) -> str:
    return f"""d{i} as materialized (select *, {_taps('z', 'y')} as t from z{i}),
e{i} as materialized (select frame, y, x, a, z, a / greatest({_taps('t', 'x')}, 1e-6) - 1 as t from d{i}),
f{i} as materialized (select frame, y, x, a, z, 1 + t * least(1, abs(t) / 0.2e0) ** 2 as t from e{i}),
g{i} as materialized (select frame, y, x, a, z, {_taps('t', 'y')} as t from f{i}),
z{i + 1} as materialized (select frame, y, x, a, z * ({_taps('t', 'x')}) as z from g{i})"""


DECONVOLUTION = f"""with z0 as materialized (select frame, y, x, greatest(r, 1e-6) as a, greatest(r, 1e-6) as z from {PX}),
{", ".join(map(_round, range(10)))} select frame, y, x, {sql_rounded('z', 3)} as o from z10"""

# ---- holes filled from their surroundings: a place's turn is its distance in steps to the nearest sample that isn't clipped, its
# value the mean of the neighbours whose turn was just before.  Ten turns: deeper holes would stay out of the result
_TURNS = ",\n".join(
    f"""i{n} as materialized (select * from i{n - 1} union all select c.frame, c.y, c.x, {n} as turn, avg(k.v) as v from turns c join i{n - 1} k on k.frame = c.frame and k.turn = {n - 1} and abs(k.y - c.y) + abs(k.x - c.x) = 1 where c.turn = {n} group by all)"""
    for n in range(1, 11)
)
INPAINT = f"""with p as (select frame, y, x, r from {PX}),
turns as materialized (select h.frame, h.y, h.x, min(abs(h.y - k.y) + abs(h.x - k.x)) as turn from p h join p k on k.frame = h.frame and k.r <= 60000 where h.r > 60000 group by all),
i0 as materialized (select frame, y, x, 0 as turn, r as v from p where r <= 60000),
{_TURNS}
select frame, y, x, {sql_rounded('v', 3)} as o from i10"""

# ---- differences along rows and columns, smoothed and fused by their variances


def _nine() -> list[float]:
    from math import exp

    w = [exp(-(k * k) / 8) for k in range(-4, 5)]
    return [x / sum(w) for x in w]


_CROSS = {"h": ("dy = 0", "dx"), "v": ("dx = 0", "dy")}
_WEIGHT = "(case abs({0}) " + " ".join(f"when {k} then {_nine()[4 + k]!r}e0" for k in range(5)) + " end)"
_SMOOTH = ", ".join(f"sum({_WEIGHT.format(at)} * n_d{a}) filter ({on}) as s{a}" for a, (on, at) in _CROSS.items())
_STATS = ", ".join(f"avg(n_s{a}) filter ({on}) as m{a}, var_pop(n_s{a}) filter ({on}) + 1e-9 as g{a}, avg((n_d{a} - n_s{a}) ** 2) filter ({on}) + 1e-9 as q{a}" for a, (on, _) in _CROSS.items())
_FROM_GREEN = f"""m as (select frame, y, x, any_value(c_v) as v, any_value(c_g) as g, sum({_TENT} * (n_v - n_g)) filter ({_NR}) / sum({_TENT}) filter ({_NR}) as dr, sum({_TENT} * (n_v - n_g)) filter ({_NB}) / sum({_TENT}) filter ({_NB}) as db from {_near('v g', 'g', _NEAR1, _NEAR1, True)} group by 1, 2, 3)
select frame, y, x, {sql_rounded(f'case when {_R} then v else g + dr end', 3)} as r, {sql_rounded('g', 3)} as g, {sql_rounded(f'case when {_B} then v else g + db end', 3)} as b from m"""
_DIRECTIONS = f"""n as (select frame, y, x, any_value(c_v) as v, {_pick(w1=(0, -1), e1=(0, 1), w2=(0, -2), e2=(0, 2), n1=(-1, 0), s1=(1, 0), n2=(-2, 0), s2=(2, 0))} from {_near('v', _WHOLE, _NEAR2, _NEAR2, True)} group by 1, 2, 3)"""
LMMSE_DEMOSAIC = f"""with {_DIRECTIONS},
d as (select frame, y, x, v, (case when (y + x) % 2 = 1 then 1 else -1 end) * (v - (w1 + e1) / 2 - (2 * v - w2 - e2) / 4) as dh, (case when (y + x) % 2 = 1 then 1 else -1 end) * (v - (n1 + s1) / 2 - (2 * v - n2 - s2) / 4) as dv from n),
s as materialized (select frame, y, x, any_value(c_v) as v, any_value(c_dh) as dh, any_value(c_dv) as dv, {_SMOOTH} from {_near('v dh dv', 'd', _FOUR, _FOUR, True)} where dy = 0 or dx = 0 group by 1, 2, 3),
t as (select frame, y, x, any_value(c_v) as v, any_value(c_dh) as dh, any_value(c_dv) as dv, {_STATS} from {_near('v dh dv sh sv', 's', _FOUR, _FOUR, True)} where dy = 0 or dx = 0 group by 1, 2, 3),
e as (select frame, y, x, v, mh + gh / (gh + qh) * (dh - mh) as a, gh * qh / (gh + qh) + 1e-9 as va, mv + gv / (gv + qv) * (dv - mv) as b, gv * qv / (gv + qv) + 1e-9 as vb from t),
g as materialized (select frame, y, x, v, case when (y + x) % 2 = 1 then v else v + (a * vb + b * va) / (va + vb) end as g from e),
{_FROM_GREEN}"""

# ---- both directions rendered, the more homogeneous one taken
_AXES = ("a", "d")  # along rows, down columns
_DIFFER = ", ".join(f"sum({_TENT} * (n_v - n_g{k})) filter ({near}) / sum({_TENT}) filter ({near}) as {c}{k}" for k in _AXES for c, near in (("r", _NR), ("b", _NB)))
_PLANES = ", ".join(f"116 * {{l}} as l{k}, 500 * (cbrt(greatest(r{k}, 0)) - {{l}}) as p{k}, 200 * ({{l}} - cbrt(greatest(b{k}, 0))) as q{k}".replace("{l}", f"cbrt(greatest(0.2126729e0 * r{k} + 0.7151521e0 * g{k} + 0.072175e0 * b{k}, 0))") for k in _AXES)
_GAPS = ", ".join(f"any_value(abs(c_l{k} - n_l{k})) filter (dy = {dy} and dx = {dx}) as l{k}{i}, any_value((c_p{k} - n_p{k}) ** 2 + (c_q{k} - n_q{k}) ** 2) filter (dy = {dy} and dx = {dx}) as c{k}{i}" for k in _AXES for i, (dy, dx) in enumerate(((0, -1), (0, 1), (-1, 0), (1, 0))))
_ALIKE = ", ".join(" + ".join(f"case when l{k}{i} <= ll and c{k}{i} <= lc then 1 else 0 end" for i in range(4)) + f" as n{k}" for k in _AXES)
HOMOGENEITY_DEMOSAIC = f"""with {_DIRECTIONS},
g as (select frame, y, x, v, case when (y + x) % 2 = 1 then v else (w1 + e1) / 2 + (2 * v - w2 - e2) / 4 end as ga, case when (y + x) % 2 = 1 then v else (n1 + s1) / 2 + (2 * v - n2 - s2) / 4 end as gd from n),
m as (select frame, y, x, any_value(c_v) as v, any_value(c_ga) as ga, any_value(c_gd) as gd, {_DIFFER} from {_near('v ga gd', 'g', _NEAR1, _NEAR1, True)} group by 1, 2, 3),
c as materialized (select frame, y, x, ga, gd, {", ".join(f"case when {mine} then v else g{k} + {c}{k} end as {c}{k}" for k in _AXES for c, mine in (("r", _R), ("b", _B)))} from m),
k as materialized (select *, {_PLANES} from c),
w as (select frame, y, x, {_GAPS} from {_near('la pa qa ld pd qd', 'k', _NEAR1, _NEAR1, True)} group by 1, 2, 3),
u as (select *, least(greatest(la0, la1), greatest(ld2, ld3)) as ll, least(greatest(ca0, ca1), greatest(cd2, cd3)) as lc from w),
h as materialized (select frame, y, x, {_ALIKE} from u),
t as (select frame, y, x, sum(n_na) as ta, sum(n_nd) as td from {_near('na nd', 'h', _NEAR1, _NEAR1, True)} group by 1, 2, 3),
o as (select c.*, case when ta > td then 1e0 when ta < td then 0e0 else 0.5e0 end as f from c join t using (frame, y, x))
select frame, y, x, {", ".join(sql_rounded(f'f * {c}a + (1 - f) * {c}d', 6) + f" as {c}" for c in "rgb")} from o"""
