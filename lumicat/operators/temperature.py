"""Colour temperature by correlation: the colours that a frame shows against what reference surfaces look like under each light.

1. ``lights``: spectral powers of candidate illuminants and the multipliers that make each grey.
2. ``surfaces``: chromaticities of reference reflectances under each light: reflectance x power x observer, summed over
   wavelengths.
3. A frame's samples are counted in cells of chromaticity under a first guess; the cells that are both frequent and far from
   grey are its colours (a bounded number), each paired with the surface nearest to it under that guess.
4. Under every candidate light the colours' chromaticities are held against their surfaces' by Student's t; the light whose
   means differ least wins.
Pixels meet only in the counts of step 3; all later tables have a bounded number of rows a frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formulas as S
from ..functions.whitebalance import daylight_xy, observer
from .histogram import student_t

#: The components of daylight from 380 to 780 nm every 10 nm (mean, yellow-blue, pink-green).
NM = tuple(range(380, 790, 10))
MEAN = (63.4, 65.8, 94.8, 104.8, 105.9, 96.8, 113.9, 125.6, 125.5, 121.3, 121.3, 113.5, 113.1, 110.8, 106.5, 108.8, 105.3, 104.4, 100.0, 96.0, 95.1, 89.1, 90.5, 90.3, 88.4, 84.0, 85.1, 81.9, 82.6, 84.9, 81.3, 71.9, 74.3, 76.4, 63.3, 71.7, 77.0, 65.2, 47.7, 68.6, 65.0)
YELLOW = (38.5, 35.0, 43.4, 46.3, 43.9, 37.1, 36.7, 35.9, 32.6, 27.9, 24.3, 20.1, 16.2, 13.2, 8.6, 6.1, 4.2, 1.9, 0.0, -1.6, -3.5, -3.5, -5.8, -7.2, -8.6, -9.5, -10.9, -10.7, -12.0, -14.0, -13.6, -12.0, -13.3, -12.9, -10.6, -11.6, -12.2, -10.2, -7.8, -11.2, -10.4)
PINK = (3.0, 1.2, -1.1, -0.5, -0.7, -1.2, -2.6, -2.9, -2.8, -2.6, -2.6, -1.8, -1.5, -1.3, -1.2, -1.0, -0.5, -0.3, 0.0, 0.2, 0.5, 2.1, 3.2, 4.1, 4.7, 5.1, 6.7, 7.3, 8.6, 9.8, 10.2, 8.3, 9.6, 8.5, 7.0, 7.6, 8.0, 6.7, 5.2, 7.4, 6.8)
#: Surfaces of each kind: nine places by two widths.
PLACES, WIDTHS = 9, 2


def powers(spark: SparkSession, temperatures: Sequence[int]) -> DataFrame:
    """(temperature, nm, power, xbar, ybar, zbar): black bodies below 4000 K, daylight from there on."""
    light = []
    for t in temperatures:
        if t < 4000:
            light.append((t, False, 0.0, 0.0))
        else:
            x, y = daylight_xy(t)
            m = 0.0241 + 0.2562 * x - 0.7341 * y
            light.append((t, True, (-1.3515 - 1.7703 * x + 5.9114 * y) / m, (0.0300 - 31.4424 * x + 30.0717 * y) / m))
    waves = [(nm, *observer(nm), s0, s1, s2) for nm, s0, s1, s2 in zip(NM, MEAN, YELLOW, PINK, strict=True)]
    lights = spark.createDataFrame(light, "temperature int, daylight boolean, m1 double, m2 double")
    waves = spark.createDataFrame(waves, "nm int, xbar double, ybar double, zbar double, s0 double, s1 double, s2 double")
    body = F.expr(S.planck("cast(nm as double)", "cast(temperature as double)"))
    power = F.when(F.col("daylight"), F.col("s0") + F.col("m1") * F.col("s1") + F.col("m2") * F.col("s2")).otherwise(body)
    # every light at every wavelength: two fixed tables
    return lights.crossJoin(F.broadcast(waves)).select("temperature", "nm", power.alias("power"), "xbar", "ybar", "zbar")


def reflectance(surface: Column, nm: Column) -> Column:
    """How much a reference surface reflects.  By rule: bands, rising edges, falling edges and gaps, each at nine places in two
    widths, over a base of 5 %."""
    kind, place, wide = F.floor(surface / (PLACES * WIDTHS)), F.floor(surface % (PLACES * WIDTHS) / WIDTHS), surface % WIDTHS
    band = lambda centre: F.exp(-F.pow((nm - centre) / F.when(wide == 0, 25.0).otherwise(60.0), F.lit(2)))
    edge = 1 / (1 + F.exp(-(nm - (480 + 20 * place)) / F.when(wide == 0, 8.0).otherwise(25.0)))
    shape = F.when(kind == 0, band(420 + 30 * place)).when(kind == 1, edge).when(kind == 2, 1 - edge).otherwise(1 - 0.9 * band(460 + 20 * place))
    return 0.05 + 0.85 * shape


def surfaces(power: DataFrame) -> DataFrame:
    """(temperature, surface, sx, sy): chromaticities of the reference surfaces under each light."""
    rows = power.withColumn("surface", F.explode(F.sequence(F.lit(0), F.lit(4 * PLACES * WIDTHS - 1)))).withColumn("s", reflectance(F.col("surface"), F.col("nm")) * F.col("power"))
    xyz = rows.groupBy("temperature", "surface").agg(*[F.sum(F.col("s") * F.col(f"{c}bar")).alias(c) for c in "xyz"])
    total = F.col("x") + F.col("y") + F.col("z")
    return xyz.select("temperature", "surface", (F.col("x") / total).alias("sx"), (F.col("y") / total).alias("sy"))


def lights(power: DataFrame, greens: Sequence[float] = (1.0,), matrix: S.Matrix = S.SRGB_FROM_XYZ) -> DataFrame:
    """(temperature, green, mr, mg, mb): multipliers of camera channels that make each light grey, the largest being 1."""
    white = power.groupBy("temperature").agg(*[(F.sum(F.col("power") * F.col(f"{c}bar")) / F.sum(F.col("power") * F.col("ybar"))).alias(c) for c in "xyz"])
    rgb = white.select("temperature", *[F.greatest(F.expr(e), F.lit(1e-6)).alias(c) for c, e in zip("rgb", S.matrix3(matrix, "x", "y", "z"), strict=True)])
    rows = rgb.withColumn("green", F.explode(F.array(*[F.lit(float(g)) for g in greens])))
    rows = rows.select("temperature", "green", (1 / F.col("r")).alias("mr"), (F.col("green") / F.col("g")).alias("mg"), (1 / F.col("b")).alias("mb"))
    top = F.greatest("mr", "mg", "mb")
    return rows.select("temperature", "green", *[(F.col(m) / top).alias(m) for m in ("mr", "mg", "mb")])


def _chromaticity(matrix: S.Matrix) -> tuple[Column, Column]:
    """x and y of r, g and b under the multipliers mr, mg and mb."""
    x, y, z = (F.expr(e) for e in S.matrix3(matrix, "(r * mr)", "(g * mg)", "(b * mb)"))
    total = x + y + z
    return F.try_divide(x, total), F.try_divide(y, total)


def frame_colors(px: DataFrame, first: DataFrame, step: int, cell: float, colors: int, top: float, matrix: S.Matrix) -> DataFrame:
    """(frame, i, j, n, r, g, b, ix, iy): the most telling cells of chromaticity of each frame under the first guess (one row of
    ``lights``), with their mean channels."""
    sample = px.where((F.col("y") % step == 0) & (F.col("x") % step == 0) & (F.greatest("r", "g", "b") < top) & (F.least("r", "g", "b") > 0)).select("frame", "r", "g", "b")
    x, y = _chromaticity(matrix)
    one = F.broadcast(first.select("mr", "mg", "mb"))  # a single row
    cells = sample.crossJoin(one).withColumns({"i": F.floor(x / cell), "j": F.floor(y / cell)}).groupBy("frame", "i", "j").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    rows = cells.crossJoin(one).withColumns({"ix": x, "iy": y})
    grey = [sum(row) / sum(map(sum, matrix)) for row in matrix[:2]]
    far = F.sqrt(F.pow(F.col("ix") - grey[0], F.lit(2)) + F.pow(F.col("iy") - grey[1], F.lit(2)))
    rank = F.row_number().over(W.partitionBy("frame").orderBy(F.desc(far * F.pow(F.col("n").cast("double"), F.lit(0.05))), "i", "j"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= colors).drop("rank", "mr", "mg", "mb")


def correlated_temperature(px: DataFrame, temperatures: Sequence[int], greens: Sequence[float] = (1.0,), reference: int = 5000, step: int = 3, cell: float = 0.01, colors: int = 40, top: float = 64000.0, matrix: S.Matrix = S.XYZ_FROM_SRGB) -> DataFrame:
    """(frame, temperature, green, t, colors): the light under which a frame's colours fit the reference surfaces best.

    ``matrix`` leads from camera channels to XYZ; ``reference`` is the first guess and one of the candidates; every
    ``step``-th row and column is read, clipped and black samples aren't.  Equal fits: the green nearest to 1, then the
    temperature nearest to the guess, then the lower.  Frames with fewer than two colours have null results.
    """
    spark = px.sparkSession
    # the observer's numbers fit a light of equal power; grey is where a light's multipliers bring it
    power = powers(spark, sorted({*temperatures, reference}))
    table, shown = lights(power, greens, S.inverse3(matrix)), surfaces(power)
    first = lights(power.where(F.col("temperature") == reference), (1.0,), S.inverse3(matrix))
    found = frame_colors(px, first, step, cell, colors, top, matrix)
    at_guess = shown.where(F.col("temperature") == reference).drop("temperature")
    gap = F.pow(F.col("ix") - F.col("gx"), F.lit(2)) + F.pow(F.col("iy") - F.col("gy"), F.lit(2))
    # what a surface looks like under the guess's multipliers: its chromaticity, adapted like the frame's
    seen = _adapted(at_guess.crossJoin(F.broadcast(first)), matrix)
    paired = found.crossJoin(F.broadcast(seen.select("surface", "gx", "gy"))).groupBy("frame", "i", "j").agg(F.min_by("surface", F.struct(gap.alias("d"), "surface")).alias("surface"), *[F.first(c).alias(c) for c in "rgb"])
    x, y = _chromaticity(matrix)
    under = _adapted(shown.join(F.broadcast(table), "temperature"), matrix).select("temperature", "green", "surface", "gx", "gy", "mr", "mg", "mb")
    rows = paired.join(F.broadcast(under), "surface").withColumns({"ix": x, "iy": y})  # surfaces x lights: fixed by the arguments
    both = rows.select("frame", "temperature", "green", F.explode(F.array(F.struct(F.col("ix").alias("a"), F.col("gx").alias("b")), F.struct(F.col("iy").alias("a"), F.col("gy").alias("b")))).alias("v")).select("frame", "temperature", "green", "v.a", "v.b")
    fits = student_t(both, "a", "b", "frame", "temperature", "green").withColumn("t", F.abs("t"))
    fits = fits.where(F.col("temperature").isin(*temperatures) & F.col("t").isNotNull())
    order = F.struct("t", F.abs(F.col("green") - 1).alias("g"), F.abs(F.col("temperature") - reference).alias("d"), "temperature")
    best = fits.groupBy("frame").agg(F.min_by(F.struct("temperature", "green", "t"), order).alias("w"))
    counts = found.groupBy("frame").agg(F.count("*").alias("colors"))
    frames = px.select("frame").distinct()
    return frames.join(best, "frame", "left").join(counts, "frame", "left").select("frame", "w.temperature", "w.green", "w.t", F.coalesce("colors", F.lit(0)).alias("colors"))


def _adapted(rows: DataFrame, matrix: S.Matrix) -> DataFrame:
    """gx, gy: chromaticities sx, sy (under a light) as a camera with that light's multipliers shows them."""
    inverse = S.inverse3(matrix)
    sz = (1 - F.col("sx") - F.col("sy"))
    camera = {n: F.lit(row[0]) * F.col("sx") + F.lit(row[1]) * F.col("sy") + F.lit(row[2]) * sz for n, row in zip("rgb", inverse, strict=True)}
    x, y = _chromaticity(matrix)
    return rows.withColumns(camera).withColumns({"gx": x, "gy": y}).drop("r", "g", "b")
