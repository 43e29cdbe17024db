"""Interpolation of colour filter mosaics (frame, y, x, c, value); c is 0 red, 1 green, 2 blue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .window import neighbourhood


def rggb(x: Column, y: Column) -> Column:
    """The colour of a place in the RGGB pattern."""
    return F.when((x % 2 == 0) & (y % 2 == 0), 0).when((x % 2 == 1) & (y % 2 == 1), 2).otherwise(1)


def _mean(*at: int) -> Column:
    known = [F.get("near", i) for i in at]
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in known])
    count = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), 1).otherwise(0) for v in known])
    return F.try_divide(total, count)


def bilinear(px: DataFrame, value: str) -> DataFrame:
    """r, g, b: each missing colour is the mean of the two or four nearest samples of it; at the edges of those there are."""
    near = neighbourhood(px, value, 1)
    v, row_red = F.col(value), F.col("y") % 2 == 0
    sides, posts, cross, corners = _mean(3, 5), _mean(1, 7), _mean(1, 3, 5, 7), _mean(0, 2, 6, 8)
    r = F.when(F.col("c") == 0, v).when(F.col("c") == 2, corners).when(row_red, sides).otherwise(posts)
    g = F.when(F.col("c") == 1, v).otherwise(cross)
    b = F.when(F.col("c") == 2, v).when(F.col("c") == 0, corners).when(row_red, posts).otherwise(sides)
    return near.withColumns({"r": r, "g": g, "b": b}).drop("near")


def mono(px: DataFrame, value: str) -> DataFrame:
    """No interpolation: all channels are the sample."""
    return px.withColumns({c: F.col(value) for c in ("r", "g", "b")})


def half_size(px: DataFrame, value: str) -> DataFrame:
    """One pixel for each 2 x 2 cell: its red, its blue and the mean of its greens."""
    pick = lambda c: F.avg(F.when(F.col("c") == c, F.col(value)))
    return px.groupBy("frame", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


def blend(a: DataFrame, b: DataFrame, mask: DataFrame) -> DataFrame:
    """Two renderings mixed by a mask (frame, y, x, w): w of ``a``, the rest of ``b``."""
    keys = ["frame", "y", "x"]
    other = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("r", "g", "b")])
    rows = a.join(other, keys).join(mask.select(*keys, "w"), keys)
    return rows.withColumns({c: F.col("w") * F.col(c) + (1 - F.col("w")) * F.col(f"_{c}") for c in ("r", "g", "b")}).drop("_r", "_g", "_b", "w")


def xtrans_fast(px: DataFrame, value: str) -> DataFrame:
    """Six-by-six mosaics: weighted sums of the 3 x 3 neighbours of each colour (sides count a half, corners a quarter)."""
    weights = (0.25, 0.5, 0.25, 0.5, 1.0, 0.5, 0.25, 0.5, 0.25)
    pair = px.withColumn("_p", F.col(value)).withColumn("_c", F.col("c").cast("double"))
    near = neighbourhood(neighbourhood(pair, "_p", 1).withColumnRenamed("near", "_v"), "_c", 1)
    out = {}
    for k, name in enumerate(("r", "g", "b")):
        hit = lambda i: (F.get("near", i) == k) & F.get("_v", i).isNotNull()  # noqa: E731,B023
        top = sum((F.when(hit(i), F.get("_v", i) * w).otherwise(0.0) for i, w in enumerate(weights) if i != 4), F.lit(0.0))
        below = sum((F.when(hit(i), F.lit(w)).otherwise(0.0) for i, w in enumerate(weights) if i != 4), F.lit(0.0))
        out[name] = F.when(F.col("c") == k, F.col(value)).otherwise(F.try_divide(top, below))
    return near.withColumns(out).drop("near", "_v", "_p", "_c")


def demosaic(px: DataFrame, value: str, method: str = "bilinear", contrast: float = 0.0) -> DataFrame:
    """By method: ``bilinear``, ``mono``, ``half``, ``xtrans_fast``; on tiles those of ``mosaics.METHODS`` and ``texture``; for
    six-by-six mosaics ``xtrans`` (three passes) and ``xtrans_one`` (one); ``dual`` (``adaptive`` where the contrast mask is
    high, bilinear elsewhere).  Others raise."""
    simple = {"bilinear": bilinear, "mono": mono, "half": half_size, "xtrans_fast": xtrans_fast}
    if method in simple:
        return simple[method](px, value)
    from .mosaics import METHODS
    from .textures import six_by_six, texture_aware
    from .tiles import apply_kernel
    from .tone import blend_mask

    if method in ("xtrans", "xtrans_one"):
        passes = 3 if method == "xtrans" else 1
        return apply_kernel(px, [value], lambda v: dict(zip("rgb", six_by_six(v, passes), strict=True)), ["r", "g", "b"], size=252, halo=24 if passes == 3 else 12, period=6)
    if method == "texture":
        return apply_kernel(px, [value], lambda v: dict(zip("rgb", texture_aware(v), strict=True)), ["r", "g", "b"], halo=22, period=2)
    if method not in METHODS and method != "dual":
        raise ValueError(f"no method {method}")
    kernel = METHODS["adaptive" if method == "dual" else method]
    fine = apply_kernel(px, [value], lambda v: dict(zip("rgb", kernel(v), strict=True)), ["r", "g", "b"], halo=14, period=2)
    return fine if method != "dual" else blend(fine, bilinear(px.drop("r", "g", "b"), value), blend_mask(px, value, "w", contrast))
