"""Aggregates over pixels: histograms and what is derived from them, tile statistics, white balance.

A histogram is a table (frame, channel, bin, n) of bounded size a frame: pixels meet only in partial counts.  Cumulative
steps are windows over a frame's bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(px: DataFrame, channels: dict[str, Column], weight: int = 1, low: int = 0, high: int = 65535, *by: str) -> DataFrame:
    """(by, channel, bin, n): truncated values, clamped to low..high; one pass for all channels."""
    by = by or ("frame",)
    pairs = F.array(*[F.struct(F.lit(k).alias("channel"), F.least(F.greatest(v.cast("bigint"), F.lit(low)), F.lit(high)).cast("bigint").alias("bin")) for k, v in channels.items()])
    return px.select(*by, F.explode(pairs).alias("h")).select(*by, "h.channel", "h.bin").groupBy(*by, "channel", "bin").agg((F.count("*") * weight).alias("n"))


def histogram2d(px: DataFrame, row: Column, column: Column, size: int, *by: str) -> DataFrame:
    """(by, row, col, n) on a size x size grid; what lies outside is dropped."""
    by = by or ("frame",)
    cells = px.select(*by, F.inline(F.array(F.struct(row.alias("_r"), column.alias("_c")))))  # each place is computed once
    inside = (F.col("_r") >= 0) & (F.col("_c") >= 0) & (F.col("_r") < size) & (F.col("_c") < size)
    return cells.where(inside).groupBy(*by, F.col("_r").cast("bigint").alias("row"), F.col("_c").cast("bigint").alias("col")).agg(F.count("*").alias("n"))


def waveform(px: DataFrame, channels: dict[str, Column], levels: int = 256, top: float = 65536.0) -> DataFrame:
    """(frame, x, channel, bin, n): levels by image column."""
    scaled = {k: v * levels / top for k, v in channels.items()}
    return histogram(px, scaled, 1, 0, levels - 1, "frame", "x")


def rebin(hist: DataFrame, shift: int, *by: str) -> DataFrame:
    by = by or ("frame", "channel")
    return hist.groupBy(*by, F.shiftright("bin", shift).alias("bin")).agg(F.sum("n").alias("n"))


def sum_and_average(hist: DataFrame, *by: str) -> DataFrame:
    by = by or ("frame", "channel")
    return hist.groupBy(*by).agg(F.sum("n").alias("total"), F.try_divide(F.sum(F.col("bin") * F.col("n")), F.sum("n")).alias("average"))


def cumulative(hist: DataFrame, *by: str) -> DataFrame:
    """Adds ``cum`` (up to and with the bin) and ``total``; windows run over the bins of one histogram."""
    by = by or ("frame", "channel")
    w = W.partitionBy(*by)
    return hist.withColumn("cum", F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))


def median_bin(hist: DataFrame, *by: str) -> DataFrame:
    """The first bin at which at least half of the mass lies at or below."""
    by = by or ("frame", "channel")
    return cumulative(hist, *by).groupBy(*by).agg(F.min(F.when(F.col("cum") * 2 >= F.col("total"), F.col("bin"))).alias("median"))


def clip_points(hist: DataFrame, percent: float, top: int, *by: str) -> DataFrame:
    """(black, white): from either end, the bins that can be clipped without losing more than ``percent`` of the mass."""
    by = by or ("frame", "channel")
    c = cumulative(hist, *by).withColumn("allowed", F.floor(F.col("total") * percent / 100))
    above = F.col("total") - F.col("cum") + F.col("n")
    return c.groupBy(*by).agg(F.least(F.coalesce(F.min(F.when(F.col("cum") > F.col("allowed"), F.col("bin"))), F.lit(0)), F.lit(top)).alias("black"), F.coalesce(F.max(F.when(above > F.col("allowed"), F.col("bin"))), F.lit(1)).alias("white"))


def percentile(px: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Percentiles interpolated in a histogram of min(65536, n) bins, clamped to the range; constants give themselves."""
    by = by or ("frame",)
    v = F.col(value)
    ends = px.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("total"))
    scaled = px.select(*by, v.alias("v")).join(ends, list(by)).withColumn("scale", (F.least(F.col("total"), F.lit(65536)) - 1) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")))
    h = scaled.groupBy(*by, "lo", "hi", "total", "scale", F.coalesce(F.floor(F.col("scale") * (F.col("v") - F.col("lo"))), F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    h = h.withColumn("cum", F.sum("n").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
    out = []
    for name, share in shares.items():
        t = F.col("total") * share
        c0, c1 = F.col("cum") - t, t - (F.col("cum") - F.col("n"))
        k = F.col("bin") + 1
        at = F.when(t <= 0, F.lit(0.0)).otherwise((c1 * k + c0 * (k - 1)) / (c0 + c1))
        inside = F.least(F.greatest(at / F.col("scale") + F.col("lo"), F.col("lo")), F.col("hi"))
        out.append(F.min_by(F.when(F.col("hi") == F.col("lo"), F.col("lo")).otherwise(inside), F.when(F.col("cum") >= t, F.col("bin"))).alias(name))
    return h.groupBy(*by).agg(*out)


def mad(px: DataFrame, value: Column, bins: int, *by: str) -> DataFrame:
    """Median of truncated absolute values over 0.6745, interpolated inside its bin."""
    by = by or ("frame",)
    h = px.select(*by, F.least(F.abs(value).cast("bigint"), F.lit(bins - 1)).alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    c = cumulative(h, *by)
    half = F.floor(F.col("total") / 2)
    # the bins before the first one with which the count reaches half
    at = F.min_by(F.struct("bin", "cum", "n", half.alias("half")), F.when(F.col("cum") >= half, F.col("bin")))
    m = c.groupBy(*by).agg(at.alias("m"))
    before = F.col("m.cum") - F.col("m.n")
    value = (F.col("m.bin") + (F.col("m.half") - before) / (F.col("m.cum") - before)) / 0.6745
    return m.select(*by, value.alias("mad"))


def cdf_match(source: DataFrame, target: DataFrame, *by: str) -> DataFrame:
    """(by, bin, matched): for each source bin the target bin whose cumulative count is nearest, ties to the upper one.

    ``source`` and ``target``: (by, bin, cum) of at most 256 bins a group, counts of equal totals.
    """
    t = target.select(*by, F.col("bin").alias("tb"), F.col("cum").alias("tc"))
    pairs = source.select(*by, "bin", "cum").join(t, list(by))
    # equal target counts are a plateau: its first bin
    return pairs.groupBy(*by, "bin").agg(F.min_by("tb", F.struct(F.abs(F.col("cum") - F.col("tc")).alias("d"), -F.col("tc"), F.col("tb"))).alias("matched"))


# ---- tiles and channels


def tile_stats(px: DataFrame, value: str, size: int, *by: str) -> DataFrame:
    """Mean, and variance over mean, of each size x size tile."""
    by = by or ("frame",)
    tile = (F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx"))
    return px.groupBy(*by, *tile).agg(F.avg(value).alias("mean"), F.try_divide(F.var_pop(value), F.avg(value)).alias("relative_variance"))


def channel_means(px: DataFrame, value: str, channel: str, top: float, border: int, width: int, height: int) -> DataFrame:
    """Grey-world means of each colour without clipped samples and a border."""
    inside = F.col("x").between(border, width - 1 - border) & F.col("y").between(border, height - 1 - border)
    return px.where(inside & (F.col(value) <= top)).groupBy("frame", channel).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def grey_world(means: DataFrame, channel: str = "c") -> DataFrame:
    """Multipliers that bring red and blue to green: (frame, rm, gm, bm)."""
    m = lambda c: F.max(F.when(F.col(channel) == c, F.col("mean")))
    return means.groupBy("frame").agg(F.try_divide(m(1), m(0)).alias("rm"), F.lit(1.0).alias("gm"), F.try_divide(m(1), m(2)).alias("bm"))


def min_values(px: DataFrame, value: str, channel: str, zero_is_bad: bool = False) -> DataFrame:
    rows = px.where(F.col(value) != 0) if zero_is_bad else px
    return rows.groupBy("frame", channel).agg(F.min(value).alias("min"))


def equalize_groups(px: DataFrame, value: str, group: Column, where: Column) -> DataFrame:
    """Both groups of the selected samples scaled to their common mean; the others stay."""
    means = px.where(where).groupBy("frame").agg(F.avg(F.when(group, F.col(value))).alias("_a"), F.avg(F.when(~group, F.col(value))).alias("_b"))
    common = (F.col("_a") + F.col("_b")) / 2
    factor = F.when(~where, F.lit(1.0)).when(group, F.try_divide(common, F.col("_a"))).otherwise(F.try_divide(common, F.col("_b")))
    return px.join(means, "frame", "left").withColumn(value, F.col(value) * F.coalesce(factor, F.lit(1.0))).drop("_a", "_b")


def scale_factors(pre: list[float], white: list[float], black: list[float]) -> tuple[list[float], float]:
    """Channel scales to 65535 and the ratio of the largest to the smallest multiplier; a missing second green is the first."""
    pre = [*pre[:3], pre[3] or pre[1]]
    top = max(pre)
    return [p / top * 65535 / (w - b) for p, w, b in zip(pre, white, black, strict=True)], top / min(pre)


def student_t(pairs: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Two-sample t with pooled variance."""
    n1, n2 = F.count(x), F.count(y)
    pooled = ((F.count(x) - 1) * F.var_samp(x) + (F.count(y) - 1) * F.var_samp(y)) / (n1 + n2 - 2)
    return pairs.groupBy(*by).agg(F.try_divide(F.avg(x) - F.avg(y), F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("t"))


def signed_stats(rows: DataFrame, value: str, threshold: float, *by: str) -> DataFrame:
    """Means and deviations of the coefficients beyond either threshold, with the extremes; 0 where there are none."""
    v = F.col(value)
    plus, minus = F.when(v >= threshold, v), F.when(v < -threshold, v)
    zero = F.lit(0.0)
    return rows.groupBy(*by).agg(F.coalesce(F.avg(plus), zero).alias("mean_plus"), F.coalesce(F.avg(minus), zero).alias("mean_minus"), F.coalesce(F.stddev_pop(plus), zero).alias("sigma_plus"), F.coalesce(F.stddev_pop(minus), zero).alias("sigma_minus"), F.coalesce(F.max(v), zero).alias("max"), F.coalesce(F.min(v), zero).alias("min"))


def brightness_factors(medians: DataFrame, reference: int) -> DataFrame:
    """Factor of each frame to the reference frame's median, by channel."""
    ref = medians.where(F.col("frame") == reference).select("channel", F.col("median").alias("_ref"))
    return medians.join(F.broadcast(ref), "channel").select("frame", "channel", F.try_divide("_ref", "median").alias("factor"))  # ref: one row a channel


def dark_channel(px: DataFrame, size: int, ambient: tuple[float, float, float], strength: float) -> DataFrame:
    """Per patch 1 - strength * (least channel minimum over ambient light, in 0..1)."""
    low = F.least(*[F.min(c) / a for c, a in zip(("r", "g", "b"), ambient, strict=True)])
    patch = (F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx"))
    return px.groupBy("frame", *patch).agg((1 - strength * F.least(F.greatest(low, F.lit(0.0)), F.lit(1.0))).alias("t"))


def spot_stats(px: DataFrame, x: int, y: int, size: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Mean and maximum of each channel in a square window."""
    half = size // 2
    inside = px.where(F.col("x").between(x - half, x + half) & F.col("y").between(y - half, y + half))
    return inside.groupBy("frame").agg(*[f(c).alias(f"{k}_{c}") for c in channels for k, f in (("avg", F.avg), ("max", F.max))])


def weighted_spectrum(spectrum: DataFrame, observer: DataFrame) -> DataFrame:
    """X, Y, Z of each spectrum: sums over wavelengths of radiance by observer weights, Y normalised to 1."""
    rows = spectrum.join(observer, "nm")
    total = F.sum(F.col("power") * F.col("ybar"))
    return rows.groupBy("name").agg(*[F.try_divide(F.sum(F.col("power") * F.col(f"{c}bar")), total).alias(c.upper()) for c in ("x", "y", "z")])


def mapping_to_curve(mapping: list[int], points: int = 9) -> list[tuple[float, float]]:
    """Control points of a tone curve from a bin-to-bin mapping (at most 256 entries): evenly spaced, rising, from (0, 0)
    to (1, 1).  A mapping that never leaves zero gives the identity."""
    n = len(mapping)
    if not n or not any(mapping):
        return [(0.0, 0.0), (1.0, 1.0)]
    out, high = [(0.0, 0.0)], 0.0
    for k in range(1, points - 1):
        i = round(k * (n - 1) / (points - 1))
        high = max(high, mapping[i] / (n - 1))
        out.append((i / (n - 1), min(high, 1.0)))
    return [*out, (1.0, 1.0)]


def matched_tone_curve(source: DataFrame, target: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, curve): control points that give the source's luminance histogram the target's shape.

    Both are (frame, bin, cum) of 256 bins; a frame's mapping is at most 256 rows, folded in one grouped call.
    """
    import pandas as pd

    matched = cdf_match(source, target, frame)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        mapping = [0] * 256
        for b, m in zip(pdf["bin"], pdf["matched"], strict=True):
            mapping[int(b)] = int(m)
        known = 0
        for i, v in enumerate(mapping):  # bins without samples continue the one before
            known = mapping[i] = v or known
        return pd.DataFrame([{frame: pdf[frame].iloc[0], "curve": [list(p) for p in mapping_to_curve(mapping)]}])

    return matched.groupBy(frame).applyInPandas(fold, f"{frame} long, curve array<array<double>>")


def channel_medians(px: DataFrame, border: float, width: int, height: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Exact medians of each channel without a border of the given share.

    Equal values are counted first, and the middle is found on running counts over sorted values, which spill; no task holds
    a frame's values at once.
    """
    bx, by = int(width * border), int(height * border)
    inside = px.where(F.col("x").between(bx, width - 1 - bx) & F.col("y").between(by, height - 1 - by))
    named = inside.select("frame", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in channels])).alias("s")).select("frame", "s.*").where("v is not null")
    counts = named.groupBy("frame", "c", "v").agg(F.count("*").alias("n"))
    w = W.partitionBy("frame", "c")
    ranked = counts.withColumns({"cum": F.sum("n").over(w.orderBy("v")), "total": F.sum("n").over(w)})
    middle = (F.min(F.when(F.col("cum") * 2 >= F.col("total"), F.col("v"))) + F.min(F.when(F.col("cum") * 2 > F.col("total"), F.col("v")))) / 2
    return ranked.groupBy("frame").pivot("c", list(channels)).agg(middle)


def noise_residual(mads: DataFrame, *by: str) -> DataFrame:
    """Sum and maximum of squared deviations over levels and directions."""
    return mads.groupBy(*by).agg(F.sum(F.col("mad") * F.col("mad")).alias("total"), F.max(F.col("mad") * F.col("mad")).alias("most"))
