"""Lookup tables and control-point curves.

Curves are small: they are evaluated on the driver into a table and applied as a literal array with linear interpolation,
a column expression of built-in functions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(table: Sequence[float], at: Column, clip_low: bool = True, clip_high: bool = True) -> Column:
    """Linear interpolation in ``table``; beyond an end the end value if that side is clipped, else the last segment goes on."""
    n = len(table)
    if n == 1:
        return F.lit(float(table[0]))
    values = F.array(*[F.lit(float(v)) for v in table])
    k = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(n - 2)).cast("int")
    t = at - k
    a, b = F.get(values, k), F.get(values, k + 1)
    out = a + t * (b - a)
    if clip_low:
        out = F.when(at < 0, F.lit(float(table[0]))).otherwise(out)
    if clip_high:
        out = F.when(at > n - 1, F.lit(float(table[-1]))).otherwise(out)
    return out


def linear(points: Sequence[tuple[float, float]]) -> Callable[[float], float]:
    """Straight lines between points sorted by x; constant beyond the ends."""
    xs, ys = zip(*sorted(points), strict=True)

    def value(t: float) -> float:
        if t <= xs[0]:
            return ys[0]
        if t >= xs[-1]:
            return ys[-1]
        k = bisect_right(xs, t) - 1
        return ys[k] + (t - xs[k]) * (ys[k + 1] - ys[k]) / (xs[k + 1] - xs[k]) if xs[k + 1] > xs[k] else ys[k + 1]

    return value


def spline(points: Sequence[tuple[float, float]]) -> Callable[[float], float]:
    """A natural cubic spline, clamped to 0..1; constant beyond the ends."""
    xs, ys = (list(v) for v in zip(*sorted(points), strict=True))
    n = len(xs)
    if n < 3:
        return linear(points)
    second, u = [0.0] * n, [0.0] * n
    for i in range(1, n - 1):
        sig = (xs[i] - xs[i - 1]) / (xs[i + 1] - xs[i - 1])
        p = sig * second[i - 1] + 2
        second[i] = (sig - 1) / p
        slope = (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) - (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1])
        u[i] = (6 * slope / (xs[i + 1] - xs[i - 1]) - sig * u[i - 1]) / p
    for i in range(n - 2, -1, -1):
        second[i] = second[i] * second[i + 1] + u[i]

    def value(t: float) -> float:
        if t <= xs[0]:
            return ys[0]
        if t >= xs[-1]:
            return ys[-1]
        k = bisect_right(xs, t) - 1
        h = xs[k + 1] - xs[k]
        a, b = (xs[k + 1] - t) / h, (t - xs[k]) / h
        y = a * ys[k] + b * ys[k + 1] + ((a**3 - a) * second[k] + (b**3 - b) * second[k + 1]) * h * h / 6
        return min(1.0, max(0.0, y))

    return value


def catmull_rom(points: Sequence[tuple[float, float]], steps: int = 64) -> Callable[[float], float]:
    """A centripetal curve through the points, sampled densely and read linearly."""
    pts = sorted(points)
    if len(pts) < 3:
        return linear(pts)
    pts = [(2 * pts[0][0] - pts[1][0], 2 * pts[0][1] - pts[1][1]), *pts, (2 * pts[-1][0] - pts[-2][0], 2 * pts[-1][1] - pts[-2][1])]
    out = []
    for p0, p1, p2, p3 in zip(pts, pts[1:], pts[2:], pts[3:], strict=False):
        knots = [0.0]
        for a, b in ((p0, p1), (p1, p2), (p2, p3)):
            knots.append(knots[-1] + max(((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.25, 1e-9))
        for i in range(steps):
            t = knots[1] + (knots[2] - knots[1]) * i / steps
            lerp = lambda a, b, ta, tb: tuple((tb - t) / (tb - ta) * u + (t - ta) / (tb - ta) * v for u, v in zip(a, b, strict=True))  # noqa: E731,B023
            a1, a2, a3 = lerp(p0, p1, knots[0], knots[1]), lerp(p1, p2, knots[1], knots[2]), lerp(p2, p3, knots[2], knots[3])
            out.append(lerp(lerp(a1, a2, knots[0], knots[2]), lerp(a2, a3, knots[1], knots[3]), knots[1], knots[2]))
    out.append(pts[-2])
    return linear([(x, min(1.0, max(0.0, y))) for x, y in out])


def b_spline(points: Sequence[tuple[float, float]], weights: Sequence[float] | None = None, degree: int = 2) -> Callable[[float], float]:
    """A rational B-spline over control points sorted by x, through the first and the last one; constant beyond them.

    Knots are uniform between clamped ends.  The curve is a function of x where the controls' x rise; its parameter is found by
    bisection, so values are exact and not read from a polyline.
    """
    pts = sorted(points)
    if len(pts) <= degree:
        return linear(pts)
    w = list(weights) if weights else [1.0] * len(pts)
    spans = len(pts) - degree
    knots = [0.0] * degree + [float(i) for i in range(spans + 1)] + [float(spans)] * degree

    def at(u: float) -> tuple[float, float]:
        k = min(degree + int(u), len(pts) - 1)  # the knot span
        basis = [1.0]
        for d in range(1, degree + 1):  # each pass raises the degree of the basis functions of the span by one
            grown = [0.0] * (d + 1)
            for i, n in enumerate(basis):
                low, high = knots[k - d + 1 + i], knots[k + 1 + i]
                share = (u - low) / (high - low)
                grown[i] += (1 - share) * n
                grown[i + 1] += share * n
            basis = grown
        parts = [(n * w[i], *pts[i]) for n, i in zip(basis, range(k - degree, k + 1), strict=True)]
        below = sum(n for n, _, _ in parts)
        return sum(n * x for n, x, _ in parts) / below, sum(n * y for n, _, y in parts) / below

    def value(t: float) -> float:
        if t <= pts[0][0]:
            return pts[0][1]
        if t >= pts[-1][0]:
            return pts[-1][1]
        low, high = 0.0, float(spans)
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if at(mid)[0] < t else (low, mid)
        return at((low + high) / 2)[1]

    return value


def _bend(x: float, low: float, high: float) -> float:
    """A curve from (0, 0) to (1, 1) whose lower half hangs (``low`` 0) or rises (1), and the upper half by ``high``: the mean of
    the four combinations, weighted by both."""
    hang = lambda t: t**3 * (2 - t)
    rise = lambda t: 1 - hang(1 - t)
    half = lambda first, second: first(2 * x) / 2 if x <= 0.5 else 0.5 + second(2 * x - 1) / 2
    shapes = {(0, 0): hang(x), (1, 1): rise(x), (0, 1): half(hang, rise), (1, 0): half(rise, hang)}
    return sum((low if a else 1 - low) * (high if b else 1 - high) * y for (a, b), y in shapes.items())


def parametric(highlights: float, lights: float, darks: float, shadows: float, splits: tuple[float, float, float] = (0.25, 0.5, 0.75)) -> Callable[[float], float]:
    """Four sliders of -100..100 over the regions between three splits.

    Darks and lights bend the whole curve with the middle split at its centre; below what becomes of the centre, shadows bend
    the curve around the first split, above it highlights around the last.  Powers bring each split to the middle of its
    range, so regions may be unequal.
    """
    if not any((highlights, lights, darks, shadows)):
        return lambda t: t
    low, mid, top = (min(max(s, 0.001), 0.99) for s in splits)
    sh, dk, lt, hl = ((v + 100) / 200 for v in (shadows, darks, lights, highlights))
    to_half = lambda x: log(0.5) / log(x)  # noqa: E731  the power that brings x to one half
    whole, under, over = to_half(mid), to_half(min(low / mid, 0.999)), to_half(max(min((top - mid) / (1 - mid), 0.999), 0.001))
    centre = _bend(0.5, dk, lt) ** (1 / whole)

    def value(t: float) -> float:
        if t <= 1e-14:
            return 0.0
        y = _bend(t**whole, dk, lt) ** (1 / whole)
        if t < mid:
            return centre * _bend((y / centre) ** under, sh, 0.5) ** (1 / under)
        part = max(0.0, (y - centre) / (1 - centre))
        return y if part**over < 1e-6 else centre + (1 - centre) * _bend(part**over, 0.5, hl) ** (1 / over)

    return value


def flat(points: Sequence[tuple[float, float]]) -> Callable[[float], float]:
    """A periodic curve on 0..1: before the first point it continues from the last one; no points give one half."""
    if not points:
        return lambda t: 0.5
    pts = sorted(points)
    around = [(pts[-1][0] - 1, pts[-1][1]), *pts, (pts[0][0] + 1, pts[0][1])]
    return linear(around)


def sampled(curve: Callable[[float], float], size: int = 256) -> list[float]:
    return [curve(i / (size - 1)) for i in range(size)]


def in_gamma(curve: Callable[[float], float], size: int = 256) -> list[float]:
    """A curve applied in the display's transfer curve: to gamma, curve, back.  The identity gives an empty table."""
    from math import exp

    up = lambda x: x * 12.92310 if x <= 0.003040 else 1.055 * exp(log(x) / 2.4) - 0.055
    down = lambda x: x / 12.92310 if x <= 0.039286 else exp(log((x + 0.055) / 1.055) * 2.4)
    if all(abs(curve(i / 64) - i / 64) < 1e-9 for i in range(65)):
        return []
    return [down(curve(up(i / (size - 1)))) for i in range(size)]


def exposure_table(ev: float, black: float, highlight: float, threshold: float, shadow: float, contrast: float, mean: float, size: int = 256) -> list[float]:
    """One table for exposure, black point, highlight and shadow compression and contrast around a mean."""
    gain = 2.0**ev
    out = []
    for i in range(size):
        x = max(0.0, i / (size - 1) - black) / max(1e-6, 1 - black) * gain
        knee = 1 - (1 - threshold / 100) * min(1.0, highlight / 100)
        if highlight and x > knee:
            reach = max(gain - knee, 1e-6)
            x = knee + (1 - knee) * (1 - (1 - min(1.0, (x - knee) / reach)) ** (1 + highlight / 50))
        if shadow:
            x = x + shadow / 100 * 0.25 * x * max(0.0, 1 - x) ** 3
        if contrast and 0 < x < 1:
            bend = 1 + contrast / 100
            x = mean * (x / mean) ** bend if x < mean else 1 - (1 - mean) * ((1 - x) / (1 - mean)) ** bend
        out.append(min(1.0, max(0.0, x)))
    return out


def film_like(r: Column, g: Column, b: Column, curve: Sequence[float]) -> tuple[Column, Column, Column]:
    """The largest and the smallest channel through the curve (0..1), the middle one at its old place between them."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    at = lambda c: lookup(curve, c * (len(curve) - 1))
    new_top, new_low = at(top), at(low)
    place = lambda c: new_low + (new_top - new_low) * F.coalesce(F.try_divide(c - low, top - low), F.lit(0.0))
    return place(r), place(g), place(b)


def weighted_triangle(r: Column, g: Column, b: Column, curve: Sequence[float]) -> tuple[Column, Column, Column]:
    """Each channel (0..1): one half of its own curved value, a quarter of where each other channel's change moves it:
    towards black in proportion below that channel, towards white in proportion above it."""
    channels = (r, g, b)
    curved = [lookup(curve, c * (len(curve) - 1)) for c in channels]

    def moved(by: int, c: Column) -> Column:
        a, change = channels[by], curved[by] - channels[by]
        room = F.when(c < a, F.try_divide(c, a)).otherwise(F.try_divide(1 - c, 1 - a))
        return F.when(c == a, curved[by]).otherwise(c + change * room)

    return tuple(0.5 * curved[i] + sum(0.25 * moved(j, c) for j in range(3) if j != i) for i, c in enumerate(channels))


def cube_lookup(r: Column, g: Column, b: Column, table: Sequence[Sequence[float]], level: int) -> tuple[Column, Column, Column]:
    """Trilinear interpolation in a small level^3 table of (r, g, b), red fastest; channels in 0..1.  The table stands in the plan:
    ``apply_cube`` takes tables of a usual size."""
    planes = [F.array(*[F.lit(float(row[c])) for row in table]) for c in range(3)]
    at = [F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * (level - 1) for c in (r, g, b)]
    base = [F.least(F.floor(a), F.lit(level - 2)).cast("int") for a in at]
    frac = [a - k for a, k in zip(at, base, strict=True)]
    out = []
    for plane in planes:
        total = F.lit(0.0)
        for corner in range(8):
            bits = [(corner >> i) & 1 for i in range(3)]
            w = F.lit(1.0)
            for f, bit in zip(frac, bits, strict=True):
                w = w * (f if bit else 1 - f)
            index = (base[0] + bits[0]) + (base[1] + bits[1]) * level + (base[2] + bits[2]) * level * level
            total = total + w * F.get(plane, index)
        out.append(total)
    return tuple(out)


#: Cells of a table that is sent to all tasks (about 50 MB); larger ones are joined as Spark sees fit.
CELLS_SENT = 250_000


def cube_cells(nodes: DataFrame) -> DataFrame:
    """(ci, cj, ck, r0 ... b7): the eight corners of each cell of a table (ri, gi, bi, r, g, b), each node once."""
    corners = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    at = [(F.col(c) - F.shiftright(F.col("k"), i).bitwiseAND(1)).cast("long").alias(n) for i, (c, n) in enumerate((("ri", "ci"), ("gi", "cj"), ("bi", "ck")))]
    named = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(8) for c in "rgb"]
    return corners.groupBy(*at).agg(*named)


def apply_cube(px: DataFrame, nodes: DataFrame, level: int, r: str = "r", g: str = "g", b: str = "b", top: float = 65535.0) -> DataFrame:
    """``px`` with r, g and b (0..top) through a table of level^3 nodes (ri, gi, bi, r, g, b in 0..top), trilinear.

    A pixel looks its cell up in a table of (level - 1)^3 rows; nothing of the table stands in the plan.
    """
    cells = cube_cells(nodes)
    if (level - 1) ** 3 <= CELLS_SENT:
        cells = F.broadcast(cells)
    names = [(r, "ci"), (g, "cj"), (b, "ck")]
    at = {f"_{n}": F.least(F.greatest(F.col(c) / top, F.lit(0.0)), F.lit(1.0)) * (level - 1) for c, n in names}
    rows = px.withColumns(at).withColumns({n: F.least(F.floor(f"_{n}"), F.lit(level - 2)).cast("long") for _, n in names})
    rows = rows.withColumns({f"_{n}": F.col(f"_{n}") - F.col(n) for _, n in names})
    low = cells.select("ci", "cj", "ck", *[F.col(f"{c}{k}").alias(f"_{c}{k}") for k in range(8) for c in "rgb"])
    share = lambda k: reduce(lambda a, w: a * w, [F.col(f"_{n}") if k >> i & 1 else 1 - F.col(f"_{n}") for i, (_, n) in enumerate(names)])
    new = {name: reduce(lambda a, w: a + w, [share(k) * F.col(f"_{c}{k}") for k in range(8)]) for name, c in zip((r, g, b), "rgb", strict=True)}
    return rows.join(low, ["ci", "cj", "ck"], "left").withColumns(new).select(*px.columns)
