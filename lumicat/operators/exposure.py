"""Automatic exposure from luminance histograms.

Order statistics are aggregates over running sums of a frame's bins (at most 65536 >> compression); what follows from them
is one row of scalars a frame.  Only the mean after the transfer curve needs the bins a second time: an equi-join with
those scalars.
"""

from __future__ import annotations

from math import log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as S
from .histogram import clip_points, cumulative

#: Middle grey, full scale, limits of the exposure.
GREY, FULL, STOPS = 0.1842, 65536.0, (-5.0, 12.0)
#: The shares of the mass that the eight levels hold, each counted from where the level before it ended.
LEVELS = (1 / 8,) * 7 + (1 / 16,)
#: The stops of the upper levels' exposure; gain of highlight compression; gain and share of brightness,
#: with its divisor below and above a knee; gain and top of contrast.
UPPER, HIGHLIGHT, BRIGHT, BRIGHT_SHARE, KNEE, LINE, CONTRAST, EVEN = 15.5, 2.3, 15.0, 0.25, 0.1, (0.10833, 0.0833), 50.0, 1.1
RESULTS = {"expcomp": "double", "bright": "int", "contr": "int", "black": "int", "hlcompr": "int", "hlcomprthresh": "int"}


def _whole(c: Column) -> Column:
    """Towards zero."""
    return F.signum(c) * F.floor(F.abs(c))


def _within(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def levels(hist: DataFrame, clip: float, top: int, *by: str) -> DataFrame:
    """(by, mean, lowest, highest, median, level array, black, white): order statistics of each histogram, in bins.

    ``level``: a level ends with the first bin at which what it holds exceeds its share of ``LEVELS``, as log2(1 + bin), and
    the next one starts empty after it; of levels that don't end, the first is the mass it holds (more than any logarithm
    of a bin unless it is tiny) and the others are 0.  Black and white: clip points for ``clip`` percent.
    """
    c = cumulative(hist.where("n > 0"), *by)
    order = c.groupBy(*by).agg(
        (F.sum(F.col("bin") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("bin").alias("lowest"),
        F.greatest(F.max("bin"), F.lit(1)).alias("highest"),
        F.min(F.when(F.col("cum") * 2 >= F.col("total"), F.col("bin"))).alias("median"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"),  # no more than a histogram has bins
    )
    share = F.array(*[F.lit(s) for s in LEVELS])

    def fill(s: Column, b: Column) -> Column:
        held = s["held"] + b["n"]
        ends = F.coalesce(held > F.col("total") * F.get(share, F.size(s["out"])), F.lit(False))
        out = F.when(ends, F.concat(s["out"], F.array(F.log2(1.0 + b["bin"])))).otherwise(s["out"])
        return F.struct(F.when(ends, F.lit(0).cast("long")).otherwise(held).alias("held"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<double>").alias("out"))
    rest = lambda s: F.slice(F.concat(s["out"], F.array(s["held"].cast("double")), F.array_repeat(F.lit(0.0), len(LEVELS))), 1, len(LEVELS))
    order = order.withColumn("level", F.aggregate("bins", start, fill, rest)).drop("bins", "total")
    return order.join(clip_points(hist, clip, top - 1, *by), list(by)).withColumn("white", F.greatest(F.least("white", F.lit(top - 1)), F.lit(1)))


def auto_exposure(hist: DataFrame, compression: int, clip: float, *by: str) -> DataFrame:
    """(by, expcomp, bright, contr, black, hlcompr, hlcomprthresh) for each luminance histogram (by, bin, n).

    Bins are 16-bit values shifted right by ``compression``; ``clip``: the percentage that may be clipped at either end.
    Histograms that are empty, have their median in the first bin or one
    value only give zeros; an empty table gives an empty table.
    """
    by = by or ("frame",)
    top, unit = 65536 >> compression, float(1 << compression)
    hist = hist.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    s = levels(hist, clip, top, *by)
    level = [F.get("level", i) for i in range(8)]
    # levels beyond the top (a natural logarithm, as published) are replaced by the course of those below
    limit = log1p(top)
    s = s.withColumn("l6", F.when(level[6] > limit, 1.5 * level[5] - 0.5 * level[4]).otherwise(level[6]))
    s = s.withColumn("l7", F.when(level[7] > limit, 1.5 * F.col("l6") - 0.5 * level[5]).otherwise(level[7]))
    level[6] = F.col("l6")
    step = [(level[i + 1] - level[i]) / F.greatest(F.abs(level[i + (i > 2)] - level[3]), F.lit(0.5)) for i in range(1, 6)]
    s = s.withColumn("spread", sum(step[1:], step[0]) / 5)
    usable = (F.col("median") > 0) & (F.col("mean") >= 1) & (F.col("lowest") < F.floor("mean")) & (F.col("spread") > 0)
    black = F.least("black", F.greatest(F.col("white") - 1, F.lit(0)))
    s = s.select(*by, usable.alias("usable"), "spread", "l6", "l7", *[(c * unit).alias(n) for n, c in {"mean": F.col("mean"), "median": F.col("median"), "highest": F.col("highest"), "white": F.col("white"), "dark": black}.items()])
    # stops that bring the mean to grey, and the upper levels to the top: weighted towards the smaller one where they differ
    to_grey = F.log2(GREY * FULL / (F.col("mean") - F.col("dark") + GREY * F.col("dark")))
    to_top = 0.5 * (UPPER - compression - (2 * F.col("l7") - F.col("l6")) + F.log2(FULL / F.col("highest")))
    s = s.withColumns({"m": to_grey, "u": to_top}).withColumns({"wm": F.abs("m"), "wu": F.abs("u")})
    weighted = (F.col("m") * F.col("wu") + F.col("u") * F.col("wm")) / (F.col("wm") + F.col("wu"))
    s = s.withColumn("ev", F.when(F.col("wm") - F.col("wu") > 1, weighted).otherwise((F.col("m") + F.col("u")) / 2))
    s = s.withColumn("gain", F.pow(F.lit(2.0), "ev"))
    s = s.withColumn("scale", F.sqrt(F.col("gain") * FULL / F.col("highest"))).withColumn("shadow", _whole(F.col("dark") * F.col("scale")))
    middle = F.col("gain") * F.sqrt(F.col("median") * F.col("mean")) / FULL
    s = s.withColumn("middle", middle)
    lift = F.try_divide(BRIGHT * (GREY - F.col("middle")), F.when(F.col("middle") < KNEE, F.col("middle")).otherwise(LINE[0] - LINE[1] * F.col("middle")))
    over = HIGHLIGHT * (F.col("gain") * F.col("white") / FULL - 1) / (F.greatest("ev", F.lit(0.0)) + 1)
    s = s.withColumns({"bright": _within(_whole(BRIGHT_SHARE * F.greatest(_whole(lift), F.lit(0.0))), -100, 100), "contr": _within(_whole(CONTRAST * (EVEN - F.col("spread"))), 0, 100), "hlcompr": _within(_whole(100 * over), 0, 100)})
    # the black point is measured against the white one after the curve, which leaves room above the mean brightness
    shown = hist.join(s.select(*by, "scale"), list(by)).withColumn("v", F.least(F.col("scale") * F.col("bin") * unit / 65535, F.lit(1.0)))
    shown = shown.groupBy(*by).agg((F.sum(F.col("n") * F.expr(S.gamma("v"))) * 65535 / F.sum("n")).alias("shown"))
    s = s.join(shown, list(by)).withColumn("v", F.col("white") * F.col("scale") / FULL)
    s = s.withColumn("w", F.floor(F.expr(S.gamma("v")) * FULL))
    s = s.withColumn("w", F.when(F.col("shadow") < F.col("shown"), F.greatest("w", F.floor((F.col("shown") - F.col("shadow")) * 4 / 3 + F.col("shadow")))).otherwise(F.col("w")))
    s = s.withColumn("v", F.col("w") / 65535).withColumn("black", F.coalesce(F.floor(F.try_divide(F.col("shadow"), F.expr(S.gamma_inverse("v")))), F.lit(0)))
    s = s.withColumns({"expcomp": _within(F.col("ev"), *STOPS), "hlcomprthresh": F.lit(0)})
    return s.select(*by, *[F.when(F.col("usable"), F.col(c)).otherwise(F.lit(0)).cast(t).alias(c) for c, t in RESULTS.items()])
