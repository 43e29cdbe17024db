"""Tone, detail and repair operators composed of windows, aggregates and column expressions."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formulas as S
from .window import _line, box_blur, contrast, extremes, gaussian_blur, guided_filter, neighbourhood


def blend_mask(px: DataFrame, value: str, out: str, threshold: float) -> DataFrame:
    """A sigmoid of the local contrast, one half at ``threshold``; places without full neighbourhoods get 0; a threshold of
    0 gives 1 everywhere."""
    if threshold <= 0:
        return px.withColumn(out, F.lit(1.0))
    rows = contrast(px, value, "_c", 0.0625 / 327.68)
    return rows.withColumn(out, F.coalesce(F.expr(S.blend_factor("_c", S.num(threshold))), F.lit(0.0))).drop("_c")


def contrast_threshold(px: DataFrame, value: str, size: int) -> DataFrame:
    """(frame, ty, tx, threshold): per tile the smallest hundredth at which the blend mask's sum over the tile's inner
    places is at most one percent of them, plus one hundredth; a tile without one gets 1.01."""
    rows = contrast(px, value, "_c", 0.0625 / 327.68).withColumns({"ty": F.floor(F.col("y") / size), "tx": F.floor(F.col("x") / size)})
    inner = (F.col("x") % size).between(2, size - 3) & (F.col("y") % size).between(2, size - 3) & F.col("_c").isNotNull()
    # one row a tile and hundredth comes out; a pixel is repeated in the task that reads it and summed there first
    steps = rows.where(inner).select("frame", "ty", "tx", "_c", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("c"))
    sums = steps.groupBy("frame", "ty", "tx", "c").agg(F.sum(F.expr(S.blend_factor("_c", f"(c / {S.num(100)})"))).alias("s"))
    limit = (size - 4) ** 2 / 100
    first = F.min(F.when(F.col("s") <= limit, F.col("c")))
    return sums.groupBy("frame", "ty", "tx").agg(((F.coalesce(first, F.lit(100)) + 1) / 100).alias("threshold"))


def shadows_highlights(px: DataFrame, value: str, out: str, radius: int, highlights: float, shadows: float) -> DataFrame:
    """Gains from a smoothed lightness in 0..1: dark places rise, bright ones fall, edges stay."""
    rows = guided_filter(px.withColumn("_l", F.col(value) / 65535), "_l", "_l", "_m", radius, 0.005)
    m = F.least(F.greatest(F.col("_m"), F.lit(0.0)), F.lit(1.0))
    low, high = F.pow(1 - m, 4), F.pow(m, 4)
    gain = F.pow(F.lit(2.0), shadows / 100 * low - highlights / 100 * high)
    return rows.withColumn(out, F.col(value) * gain).drop("_l", "_m")


def tone_equalizer(px: DataFrame, out: dict[str, str], bands: list[float], radius: int) -> DataFrame:
    """Gains in stops by luminance band: Gaussian weights around centres every two stops from -16 up, over a smoothed log
    luminance.  ``out``: new column -> channel."""
    base = px.withColumn("_y", F.log2(F.greatest(F.expr(S.luminance("r", "g", "b")) / 65535, F.lit(2.0**-18))))
    base = guided_filter(base, "_y", "_y", "_base", radius, 0.01)
    # fifteen windows; the given bands sit in the middle, their neighbours repeat the outer ones
    centres = [-16.0 + 2 * k for k in range(15)]
    gains = [bands[min(len(bands) - 1, max(0, round((c + 16) / 28 * (len(bands) - 1))))] for c in centres]
    weight = lambda c: F.exp(-F.pow(F.col("_base") - c, 2) / (2 * 2.0**2))
    top = sum((weight(c) * (2.0 ** (g / 100 * 2)) for c, g in zip(centres, gains, strict=True)), F.lit(0.0))
    below = sum((weight(c) for c in centres), F.lit(0.0))
    return base.withColumns({o: F.col(c) * top / below for o, c in out.items()}).drop("_y", "_base")


def vibrance(px: DataFrame, a: str, b: str, pastels: float, saturated: float, split: float) -> DataFrame:
    """Chroma scaled by how saturated a colour is; skin hues move half as much."""
    c, h = S.lch_from_lab(a, b)
    chroma, hue = F.expr(c), F.expr(h)
    share = F.least(chroma / split, F.lit(1.0))
    amount = (1 - share) * pastels / 100 + share * saturated / 100
    skin = F.when(hue.between(0.3, 1.3), F.lit(0.5)).otherwise(1.0)
    gain = 1 + amount * skin
    return px.withColumns({a: F.col(a) * gain, b: F.col(b) * gain})


def color_regions(px: DataFrame, regions: list[dict]) -> DataFrame:
    """Slope, offset and power per channel inside soft ranges of lightness and hue, in order: each region sees the last."""
    for r in regions:
        weight = F.expr(S.trapezoid("l", *r["lightness"])) if "lightness" in r else F.lit(1.0)
        for c in ("r", "g", "b"):
            x = F.greatest(F.col(c) / 65535 * r.get("slope", 1.0) + r.get("offset", 0.0), F.lit(0.0))
            new = F.pow(x, 1 / r.get("power", 1.0)) * 65535
            px = px.withColumn(c, F.col(c) + weight * (new - F.col(c)))
    return px


def dehaze(px: DataFrame, size: int, strength: float, radius: int) -> DataFrame:
    """Haze removed: ambient light from the brightest patches of the dark channel, transmission refined along luminance.

    The ambient light is one row a frame and joined to its pixels.
    """
    patch = px.withColumns({"_ty": F.floor(F.col("y") / size), "_tx": F.floor(F.col("x") / size)})
    low = patch.groupBy("frame", "_ty", "_tx").agg(F.least(F.min("r"), F.min("g"), F.min("b")).alias("_low"))
    edge = low.groupBy("frame").agg(F.percentile("_low", 0.95).alias("_edge"))
    bright = low.join(edge, "frame").where(F.col("_low") >= F.col("_edge")).select("frame", "_ty", "_tx")
    light = patch.join(bright, ["frame", "_ty", "_tx"]).groupBy("frame").agg(*[F.greatest(F.avg(c), F.lit(1.0)).alias(f"_a{c}") for c in "rgb"])
    rows = patch.join(light, "frame")
    dark = rows.groupBy("frame", "_ty", "_tx").agg(F.least(*[F.min(F.col(c) / F.col(f"_a{c}")) for c in "rgb"]).alias("_d"))
    rows = rows.join(dark, ["frame", "_ty", "_tx"]).withColumn("_t", 1 - strength * F.least(F.greatest(F.col("_d"), F.lit(0.0)), F.lit(1.0)))
    rows = guided_filter(rows.withColumn("_y", F.expr(S.luminance("r", "g", "b")) / 65535), "_y", "_t", "_tr", radius, 1e-4)
    t = F.greatest(F.col("_tr"), F.lit(0.1))
    out = rows.withColumns({c: (F.col(c) - F.col(f"_a{c}")) / t + F.col(f"_a{c}") for c in "rgb"})
    return out.drop("_ty", "_tx", "_d", "_t", "_tr", "_y", "_ar", "_ag", "_ab")


def impulse_denoise(px: DataFrame, value: str, out: str, sigma: float, threshold: float) -> DataFrame:
    """Samples that stand out from their blur more than the 24 around them become a mean of the ordinary ones."""
    rows = gaussian_blur(px, {"_low": value}, sigma).withColumn("_h", F.abs(F.col(value) - F.col("_low")))
    sums = rows.withColumn("_s", F.sum("_h").over(_line(2, "x"))).withColumn("_n", F.count("*").over(_line(2, "x")))
    sums = sums.withColumn("_s", F.sum("_s").over(_line(2, "y"))).withColumn("_n", F.sum("_n").over(_line(2, "y")))
    impulse = F.col("_h") * (F.col("_n") - 1) > threshold * (F.col("_s") - F.col("_h"))
    marked = sums.withColumn("_bad", impulse).withColumn("_ok", F.when(~F.col("_bad"), F.col(value)))
    near = box_blur_sum(marked, "_ok", 2)
    return near.withColumn(out, F.when(F.col("_bad"), F.coalesce(F.try_divide("_top", "_count"), F.col(value))).otherwise(F.col(value))).drop("_low", "_h", "_s", "_n", "_bad", "_ok", "_top", "_count")


def box_blur_sum(px: DataFrame, value: str, radius: int) -> DataFrame:
    """Sum and count of the non-null samples of each square."""
    rows = px.withColumns({"_top": F.sum(value).over(_line(radius, "x")), "_count": F.count(value).over(_line(radius, "x"))})
    return rows.withColumns({"_top": F.sum("_top").over(_line(radius, "y")), "_count": F.sum("_count").over(_line(radius, "y"))})


def recover_opposed(px: DataFrame, clip: float) -> DataFrame:
    """Clipped channels rebuilt from the mean cube root of the other two around them, plus the mean chroma of unclipped
    places near clipped ones (one row a frame)."""
    root = {f"_m{c}": F.cbrt(F.greatest(F.col(c), F.lit(0.0))) for c in "rgb"}
    rows = box_blur(px.withColumns(root), {f"_n{c}": f"_m{c}" for c in "rgb"}, 1)
    guess = {c: F.pow((F.col(f"_n{a}") + F.col(f"_n{b}")) / 2, 3) for c, a, b in (("r", "g", "b"), ("g", "r", "b"), ("b", "r", "g"))}
    marks = rows.withColumns({f"_c{c}": (F.col(c) >= clip).cast("int") for c in "rgb"})
    marks = extremes(marks.withColumn("_any", F.greatest("_cr", "_cg", "_cb").cast("double")), "_any", 3).drop("low")
    near = F.col("high") == 1
    shift = marks.groupBy("frame").agg(*[F.coalesce(F.avg(F.when(near & (F.col(f"_c{c}") == 0) & (F.col(c) > 0.2 * clip), F.col(c) - guess[c])), F.lit(0.0)).alias(f"_s{c}") for c in "rgb"])
    out = marks.join(shift, "frame").withColumns({f"_o{c}": F.when(F.col(f"_c{c}") == 1, F.greatest(F.col(c), guess[c] + F.col(f"_s{c}"))).otherwise(F.col(c)) for c in "rgb"})
    return out.select(*[c for c in px.columns if c not in "rgb"], *[F.col(f"_o{c}").alias(c) for c in "rgb"])


def blend_highlights(r: Column, g: Column, b: Column, top: float) -> tuple[Column, Column, Column]:
    """Pixels with a channel over 95 % of ``top``: in an opponent space, chroma scaled to what it was before clipping."""
    root3 = 3**0.5
    clip = [F.least(c, F.lit(top)) for c in (r, g, b)]
    light = (r + g + b) / 3
    one, two = root3 * (r - g), 2 * b - r - g
    k1, k2 = root3 * (clip[0] - clip[1]), 2 * clip[2] - clip[0] - clip[1]
    ratio = F.coalesce(F.sqrt(F.try_divide(k1 * k1 + k2 * k2, one * one + two * two)), F.lit(1.0))
    a, h = ratio * one, ratio * two
    out = (light - h / 6 + a / (2 * root3), light - h / 6 - a / (2 * root3), light + h / 3)
    hit = F.greatest(r, g, b) > 0.95 * top
    return tuple(F.when(hit, o).otherwise(c) for o, c in zip(out, (r, g, b), strict=True))


def _spot_layers(spots: list[dict]) -> list[list[dict]]:
    """Spots in layers: those of a layer neither read nor write what another of it writes, so their order doesn't matter."""
    def meet(a: tuple[float, float], ra: float, b: tuple[float, float], rb: float) -> bool:
        return all(abs(p - q) <= ra + rb for p, q in zip(a, b, strict=True))

    level: list[int] = []
    for i, s in enumerate(spots):
        before = [level[j] + 1 for j, e in enumerate(spots[:i]) if any(meet(s[a], s["radius"], e[b], e["radius"]) for a, b in (("source", "target"), ("target", "target"), ("target", "source")))]
        level.append(max(before, default=0))
    return [[s for s, at in zip(spots, level, strict=True) if at == k] for k in range(max(level, default=-1) + 1)]


def remove_spots(px: DataFrame, spots: list[dict], channels: list[str]) -> DataFrame:
    """Source circles copied over target circles with a feathered edge, in order: a spot may copy what an earlier one made.

    Spots that don't touch each other are one layer.  A layer takes the pixels of its source squares (against the user's few
    marks, sent to all tasks) and joins them to the raster once, so there are as many joins as spots build on each other.
    """
    for layer in _spot_layers(spots):
        marks = [F.struct(*[F.lit(float(v)).alias(n) for n, v in (("sx", s["source"][0]), ("sy", s["source"][1]), ("tx", s["target"][0]), ("ty", s["target"][1]), ("r", s["radius"]), ("hard", s["radius"] * (1 - s.get("feather", 0.0))), ("most", s.get("opacity", 1.0)))]) for s in layer]
        near = F.filter(F.array(*marks), lambda m: F.col("x").between(m["sx"] - m["r"], m["sx"] + m["r"]) & F.col("y").between(m["sy"] - m["r"], m["sy"] + m["r"]))
        source = px.select("frame", "y", "x", *channels, F.explode(near).alias("m"))
        y, x, m = F.col("y") + F.col("m.ty") - F.col("m.sy"), F.col("x") + F.col("m.tx") - F.col("m.sx"), F.col("m")
        d = F.sqrt(F.pow(x - m["tx"], 2) + F.pow(y - m["ty"], 2))
        w = F.when(d > m["r"], F.lit(0.0)).when(d <= m["hard"], m["most"]).otherwise(m["most"] * (m["r"] - d) / F.greatest(m["r"] - m["hard"], F.lit(1e-9)))
        source = source.select("frame", y.cast("long").alias("y"), x.cast("long").alias("x"), w.alias("_w"), *[F.col(c).alias(f"_s{c}") for c in channels])
        made = {c: F.when(F.col("_w").isNull(), F.col(c)).otherwise(F.col("_w") * F.col(f"_s{c}") + (1 - F.col("_w")) * F.col(c)) for c in channels}
        px = px.join(source, ["frame", "y", "x"], "left").withColumns(made).drop("_w", *[f"_s{c}" for c in channels])
    return px


def merge_shifted(frames: DataFrame, value: str, group: str, motion: float) -> DataFrame:
    """(group, y, x, r, g, b, moved): four exposures of one scene shifted by a pixel each, so that every place is sampled
    in each colour.  Where the two greens differ by more than ``motion`` times their mean the place moved, and only the
    first exposure's neighbours would help (``moved``)."""
    pick = lambda c: F.avg(F.when(F.col("c") == c, F.col(value)))
    green = F.when(F.col("c") == 1, F.col(value))
    out = frames.groupBy(group, "y", "x").agg(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"), (F.max(green) - F.min(green)).alias("_d"))
    return out.withColumn("moved", F.col("_d") > motion * F.col("g")).drop("_d")


def line_artefacts(px: DataFrame, value: str, rows: list[int], ratio: float) -> DataFrame:
    """(frame, y): rows among ``rows`` (modulo their period) whose sum stands out from both neighbours."""
    sums = px.groupBy("frame", "y").agg(F.sum(value).alias("s"))
    w = W.partitionBy("frame").orderBy("y")
    near = sums.withColumns({"a": F.lag("s").over(w), "b": F.lead("s").over(w)})
    return near.where(F.col("y").isin(*rows) & (F.col("s") > ratio * F.greatest("a", "b"))).select("frame", "y")


def capture_radius(px: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """(frame, radius): the Gaussian radius that explains the largest ratio of neighbouring greens inside the limits."""
    w = W.partitionBy("frame", "y").orderBy("x")
    green = px.where("c = 1")
    pair = green.withColumn("_n", F.lead(value).over(w))
    a, b = F.greatest(value, "_n"), F.least(F.col(value), F.col("_n"))
    ratio = F.max(F.when((b > low) & (a < high), a / b))
    return pair.groupBy("frame").agg(ratio.alias("_r")).select("frame", F.sqrt(1 / F.log(F.when(F.col("_r") > 1, F.col("_r")))).alias("radius"))


def noise_levels(px: DataFrame, a: str, b: str, size: int) -> DataFrame:
    """(frame, ty, tx, chroma noise, luminance): deviations of neighbouring differences of both chroma planes by tile."""
    w = _line(None, "x")
    d = px.withColumns({"_a": F.col(a) - F.lag(a).over(w), "_b": F.col(b) - F.lag(b).over(w)})
    tile = (F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx"))
    return d.groupBy("frame", *tile).agg(((F.stddev_pop("_a") + F.stddev_pop("_b")) / 2).alias("chroma_noise"), F.avg("l").alias("lightness"))


def denoise_amount(noise: Column, lightness: Column) -> Column:
    """A strength of 0..100 from a tile's noise; dark tiles count more."""
    dark = F.when(lightness < 6000, F.lit(1.3)).when(lightness < 12000, F.lit(1.1)).otherwise(1.0)
    return F.least(F.greatest(noise * dark / 327.68 * 12, F.lit(0.0)), F.lit(100.0))


def out_of_gamut(px: DataFrame, matrix) -> DataFrame:
    """``warn``: whether a pixel leaves 0..65535 in the target space."""
    out = [F.expr(e) for e in S.matrix3(matrix, "r", "g", "b")]
    hit = F.lit(False)
    for c in out:
        hit = hit | (c < -0.5) | (c > 65535.5)
    return px.withColumn("warn", hit)


def detail_ratio(px: DataFrame, value: str, radius: int) -> DataFrame:
    """Mean and extremes of a blurred luminance map, by frame."""
    return box_blur(px, {"_m": value}, radius).groupBy("frame").agg(F.avg("_m").alias("mean"), F.min("_m").alias("low"), F.max("_m").alias("high"))


def level_count(radius: float) -> int:
    return max(1, int(log2(max(1.0, radius))) + 1)


def near_median_chroma(px: DataFrame, a: str, b: str, radius: int = 1) -> DataFrame:
    """Both chroma planes by the median of their neighbourhood."""
    from .window import median

    for c in (a, b):
        px = neighbourhood(px, c, radius).withColumn(c, median(F.col("near"))).drop("near")
    return px
