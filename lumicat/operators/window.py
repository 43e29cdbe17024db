"""Neighbourhood operators over dense rasters (frame, y, x, values).

Separable filters are two windows, along rows and along columns: the exchange is by (frame, y) and by (frame, x), so a
task sees lines, never a frame.  Others look up neighbours by lag and lead over the same two partitionings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _line(radius: int | None, along: str, *by: str):
    across = "y" if along == "x" else "x"
    w = W.partitionBy("frame", *by, across).orderBy(along)
    return w if radius is None else w.rowsBetween(-radius, radius)


def separable(px: DataFrame, columns: dict[str, str], radius: int, f: Callable[[Column], Column]) -> DataFrame:
    """``f`` over (2 radius + 1) squares that shrink at the edges, as two passes: out column -> in column."""
    rows = px.withColumns({f"_{o}": f(F.col(i)).over(_line(radius, "x")) for o, i in columns.items()})
    out = rows.withColumns({o: f(F.col(f"_{o}")).over(_line(radius, "y")) for o in columns})
    return out.drop(*[f"_{o}" for o in columns])


def box_blur(px: DataFrame, columns: dict[str, str], radius: int) -> DataFrame:
    """Running means; at the edges over the samples there are."""
    return separable(px, columns, radius, F.avg)


def box_blur_rows(px: DataFrame, columns: dict[str, str], radius: int) -> DataFrame:
    return px.withColumns({o: F.avg(i).over(_line(radius, "x")) for o, i in columns.items()})


def box_blur_abs(px: DataFrame, columns: dict[str, str], radius: int) -> DataFrame:
    named = px.withColumns({f"_a_{o}": F.abs(i) for o, i in columns.items()})
    return box_blur(named, {o: f"_a_{o}" for o in columns}, radius).drop(*[f"_a_{o}" for o in columns])


def extremes(px: DataFrame, value: str, radius: int) -> DataFrame:
    """``low`` and ``high`` of each neighbourhood."""
    return separable(separable(px, {"low": value}, radius, F.min), {"high": value}, radius, F.max)


def cfa_box_blur(px: DataFrame, value: str, out: str, radius: int) -> DataFrame:
    """Box blur among samples of the same place in the 2 x 2 colour pattern."""
    parity = px.withColumn("_py", F.col("y") % 2).withColumn("_px", F.col("x") % 2)
    first = parity.withColumn("_h", F.avg(value).over(_line(radius, "x", "_px")))
    return first.withColumn(out, F.avg("_h").over(_line(radius, "y", "_py"))).drop("_h", "_py", "_px")


def gaussian_blur(px: DataFrame, columns: dict[str, str], sigma: float) -> DataFrame:
    """Gaussian weights up to three sigma, renormalised at the edges: two passes of shifted sums."""
    from math import ceil, exp

    radius = max(1, ceil(3 * sigma))
    weights = [exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]

    def one(c: Column, along: str) -> Column:
        w = _line(None, along)
        taps = [F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k else c for k in range(-radius, radius + 1)]
        top = sum((F.coalesce(t, F.lit(0.0)) * v for t, v in zip(taps, weights, strict=True)), F.lit(0.0))
        below = sum((F.when(t.isNotNull(), F.lit(v)).otherwise(0.0) for t, v in zip(taps, weights, strict=True)), F.lit(0.0))
        return top / below

    rows = px.withColumns({f"_{o}": one(F.col(i), "x") for o, i in columns.items()})
    return rows.withColumns({o: one(F.col(f"_{o}"), "y") for o in columns}).drop(*[f"_{o}" for o in columns])


def neighbourhood(px: DataFrame, value: str, radius: int, step: int = 1) -> DataFrame:
    """``near``: an array of the (2 radius + 1) squared samples at distances of ``step``, row by row; null outside."""
    offsets = [step * k for k in range(-radius, radius + 1)]
    shift = lambda c, k, w: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k else c
    rows = px.withColumn("_row", F.array(*[shift(F.col(value), k, _line(None, "x")) for k in offsets]))
    w = _line(None, "y")
    none = F.array(*[F.lit(None).cast("double")] * len(offsets))
    return rows.withColumn("near", F.flatten(F.array(*[F.coalesce(shift(F.col("_row"), k, w), none) for k in offsets]))).drop("_row")


def median(values: Column) -> Column:
    """The middle of the non-null values; of an even number the mean of the two in the middle."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    odd = F.get(v, F.floor(n / 2).cast("int"))
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, odd).otherwise((F.get(v, F.floor(n / 2).cast("int") - 1) + odd) / 2)


def middle4of6(values: Column) -> Column:
    return F.slice(F.array_sort(values), 2, 4)


def median_filter(px: DataFrame, value: str, out: str, radius: int = 1, passes: int = 1) -> DataFrame:
    """Median of the neighbourhood; samples at the edge, which have no full one, stay."""
    for _ in range(passes):
        near = neighbourhood(px, value, radius)
        full = F.size(F.filter("near", lambda x: x.isNull())) == 0
        px = near.withColumn(out, F.when(full, median(F.col("near"))).otherwise(F.col(value))).drop("near")
        value = out
    return px


def hot_pixels(px: DataFrame, value: str, threshold: float, hot: bool = True, dead: bool = True) -> DataFrame:
    """``bad``: the deviation from the median of the nine same-colour samples stands out from the deviations around it.

    Deviations of the wanted sign only; bad where 24 times the deviation exceeds ``threshold`` times the sum of the other
    24 in the 5 x 5 square.  Samples without a full square aren't bad.
    """
    near = neighbourhood(px, value, 1, 2)
    full = F.size(F.filter("near", lambda x: x.isNull())) == 0
    d = F.col(value) - median(F.col("near"))
    keep = F.when(d > 0, F.lit(1 if hot else 0)).otherwise(F.lit(1 if dead else 0))
    dev = near.withColumn("_dev", F.when(full & (keep == 1), F.abs(d)).otherwise(0.0)).drop("near")
    sums = dev.withColumn("_s", F.sum("_dev").over(_line(2, "x"))).withColumn("_n", F.count("*").over(_line(2, "x")))
    sums = sums.withColumn("_s", F.sum("_s").over(_line(2, "y"))).withColumn("_n", F.sum("_n").over(_line(2, "y")))
    bad = (F.col("_n") == 25) & (F.col("_dev") * 24 > threshold * (F.col("_s") - F.col("_dev")))
    return sums.withColumn("bad", F.coalesce(bad, F.lit(False))).drop("_dev", "_s", "_n")


def zero_pixels(px: DataFrame, value: str) -> DataFrame:
    return px.where(F.col(value) == 0).select("frame", "y", "x")


def fill_bad(px: DataFrame, value: str, out: str, bad: str = "bad") -> DataFrame:
    """Bad samples become the mean of the good same-colour neighbours two steps away, weighted by inverse distance; those
    without any stay."""
    good = px.withColumn("_g", F.when(~F.col(bad), F.col(value)))
    near = neighbourhood(good, "_g", 1, 2)
    weight = [1 / (2 * ((i // 3 - 1) ** 2 + (i % 3 - 1) ** 2) ** 0.5) if i != 4 else 0.0 for i in range(9)]
    at = lambda i: F.get(F.col("near"), i)
    top = sum((F.coalesce(at(i), F.lit(0.0)) * w for i, w in enumerate(weight)), F.lit(0.0))
    below = sum((F.when(at(i).isNotNull(), F.lit(w)).otherwise(0.0) for i, w in enumerate(weight)), F.lit(0.0))
    return near.withColumn(out, F.when(F.col(bad), F.coalesce(F.try_divide(top, below), F.col(value))).otherwise(F.col(value))).drop("_g", "near")


def unsharp(px: DataFrame, value: str, out: str, radius: int, amount: float, threshold: float) -> DataFrame:
    """v + amount * (v - blur) where the difference exceeds the threshold."""
    blurred = box_blur(px, {"_blur": value}, radius)
    d = F.col(value) - F.col("_blur")
    return blurred.withColumn(out, F.when(F.abs(d) > threshold, F.greatest(F.col(value) + amount * d, F.lit(0.0))).otherwise(F.col(value))).drop("_blur")


def local_contrast(px: DataFrame, value: str, out: str, radius: int, amount: float, darkness: float, lightness: float) -> DataFrame:
    """v + amount * (v - blur), the difference times lightness if positive, else darkness; clamped to 0.0001..32767."""
    blurred = box_blur(px, {"_blur": value}, radius)
    d = F.col(value) - F.col("_blur")
    d = amount * d * F.when(d > 0, F.lit(lightness)).otherwise(F.lit(darkness))
    return blurred.withColumn(out, F.least(F.greatest(F.col(value) + d, F.lit(0.0001)), F.lit(32767.0))).drop("_blur")


def halo_control(px: DataFrame, value: str, sharpened: str, out: str, amount: float) -> DataFrame:
    """A sharpened value beyond the band of the smoothed neighbourhood keeps ``100 - amount`` percent of its overshoot."""
    smooth = box_blur(px, {"_m": value}, 1)
    band = extremes(smooth, "_m", 1)
    s, over = F.col(sharpened), 1 - amount / 100
    lim = F.when(s > F.col("high"), F.col("high") + (s - F.col("high")) * over).when(s < F.col("low"), F.col("low") - (F.col("low") - s) * over).otherwise(s)
    return band.withColumn(out, lim).drop("_m", "low", "high")


def contrast(px: DataFrame, value: str, out: str, scale: float) -> DataFrame:
    """Length of the differences one and two samples away in both directions; null near the edge."""
    wx, wy = _line(None, "x"), _line(None, "y")
    d = lambda k, w: F.lead(value, k).over(w) - F.lag(value, k).over(w)
    rows = px.withColumns({"_x1": d(1, wx), "_x2": d(2, wx)})
    rows = rows.withColumns({"_y1": d(1, wy), "_y2": d(2, wy)})
    c = F.sqrt(sum((F.col(k) * F.col(k) for k in ("_x1", "_x2", "_y1", "_y2")), F.lit(0.0))) * scale
    return rows.withColumn(out, c).drop("_x1", "_x2", "_y1", "_y2")


def guided_filter(px: DataFrame, guide: str, source: str, out: str, radius: int, eps: float) -> DataFrame:
    """Edge-preserving smoothing of ``source`` along ``guide``: linear coefficients per square, averaged."""
    rows = px.withColumns({"_gs": F.col(guide) * F.col(source), "_gg": F.col(guide) * F.col(guide)})
    m = box_blur(rows, {"_mg": guide, "_ms": source, "_mgs": "_gs", "_mgg": "_gg"}, radius)
    a = (F.col("_mgs") - F.col("_mg") * F.col("_ms")) / (F.col("_mgg") - F.col("_mg") * F.col("_mg") + eps)
    ab = m.withColumn("_a", a).withColumn("_b", F.col("_ms") - F.col("_a") * F.col("_mg"))
    fin = box_blur(ab, {"_ma": "_a", "_mb": "_b"}, radius)
    return fin.withColumn(out, F.col("_ma") * F.col(guide) + F.col("_mb")).drop("_gs", "_gg", "_mg", "_ms", "_mgs", "_mgg", "_a", "_b", "_ma", "_mb")


def green_equilibrate_local(px: DataFrame, value: str, out: str, threshold: float) -> DataFrame:
    """Greens halfway to what the other kind of green says where the two kinds differ by more than either varies.

    The four greens on the diagonals are of the other kind, those two samples away along rows and columns of the same one.
    Where their spreads together stay below ``threshold`` times the difference of their sums (spreads are sums over the six
    pairs, hence the factor), the green is interpolated from its diagonals, each continued by half the slope beyond it and
    weighted against the changes along it; what would brighten it by more than ``threshold`` is left.  Samples within four rows
    of an edge (four columns left, six right) stay.
    """
    near = neighbourhood(px, value, 3)
    at = lambda dy, dx: F.get("near", 7 * (dy + 3) + dx + 3)
    ways = [(a, b) for a in (-1, 1) for b in (-1, 1)]
    kinds = {"_o": [at(a, b) for a, b in ways], "_s": [at(-2, 0), at(2, 0), at(0, -2), at(0, 2)]}
    sums = {k: sum(v[1:], v[0]) for k, v in kinds.items()}
    spread = [F.abs(v[i] - v[j]) for v in kinds.values() for i in range(4) for j in range(i)]
    differ = sum(spread[1:], spread[0]) < 6 * threshold * F.abs(sums["_o"] - sums["_s"])
    v = F.col(value)
    weights = [1 / (1 + F.pow(v - at(2 * a, 2 * b), F.lit(2)) + F.pow(at(3 * a, 3 * b) - at(a, b), F.lit(2))) for a, b in ways]
    values = [at(a, b) + (v - at(2 * a, 2 * b)) / 2 for a, b in ways]
    guess = sum((x * w for x, w in zip(values[1:], weights[1:], strict=True)), values[0] * weights[0]) / sum(weights[1:], weights[0])
    ends = px.groupBy("frame").agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))
    inner = F.col("y").between(4, F.col("_my") - 4) & (F.col("x") >= 4) & (F.col("x") <= F.col("_mx") - 6)
    rows = near.join(ends, "frame").withColumn("_g", F.when((F.col("c") == 1) & inner & differ, guess))
    lifted = (F.col("_g") + v) / 2
    return rows.withColumn(out, F.when(F.col("_g") - v < threshold * (F.col("_g") + v), lifted).otherwise(v)).drop("near", "_g", "_my", "_mx")


def flat_field(px: DataFrame, value: str, flat: str, out: str, radius: int, black: float) -> DataFrame:
    """Divides by the blurred flat relative to the mean of its colour."""
    blurred = cfa_box_blur(px, flat, "_blur", radius)
    mean = blurred.groupBy("frame", "c").agg(F.avg("_blur").alias("_mean"))
    factor = F.coalesce(F.try_divide(F.col("_mean"), F.greatest(F.col("_blur"), F.lit(1e-5))), F.lit(1.0))
    return blurred.join(mean, ["frame", "c"]).withColumn(out, F.greatest(F.col(value) - black, F.lit(0.0)) * factor + black).drop("_blur", "_mean")


def subtract_dark(px: DataFrame, dark: DataFrame, value: str, out: str, black: float) -> DataFrame:
    """max(v + black - dark, 0) by pixel; without a dark sample the value stays."""
    d = dark.select("frame", "y", "x", F.col(value).alias("_d"))
    return px.join(d, ["frame", "y", "x"], "left").withColumn(out, F.when(F.col("_d").isNull(), F.col(value)).otherwise(F.greatest(F.col(value) + black - F.col("_d"), F.lit(0.0)))).drop("_d")
