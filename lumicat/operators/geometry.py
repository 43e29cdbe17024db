"""Geometry of rasters: flips, rotations, crops, resampling and position-dependent gains."""

from __future__ import annotations

from math import ceil, floor, pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flip(px: DataFrame, width: int, height: int, horizontal: bool = False, vertical: bool = False) -> DataFrame:
    x = width - 1 - F.col("x") if horizontal else F.col("x")
    y = height - 1 - F.col("y") if vertical else F.col("y")
    return px.withColumns({"x": x, "y": y})


def rotate(px: DataFrame, width: int, height: int, degrees: int) -> DataFrame:
    """Clockwise, by multiples of 90; other angles leave the raster as it is."""
    x, y = F.col("x"), F.col("y")
    turned = {90: (height - 1 - y, x), 180: (width - 1 - x, height - 1 - y), 270: (y, width - 1 - x)}.get(degrees % 360)
    return px.withColumns({"x": turned[0], "y": turned[1]}) if turned else px


def crop_skip(px: DataFrame, x: int, y: int, width: int, height: int, skip: int = 1) -> DataFrame:
    """Every ``skip``-th sample of a window; the window's filter reaches the scan."""
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    rows = px.where(inside & ((F.col("x") - x) % skip == 0) & ((F.col("y") - y) % skip == 0))
    return rows.withColumns({"x": F.floor((F.col("x") - x) / skip), "y": F.floor((F.col("y") - y) / skip)})


def crop_average(px: DataFrame, channels: list[str], skip: int) -> DataFrame:
    """Means of skip x skip squares."""
    return px.groupBy("frame", F.floor(F.col("y") / skip).alias("y"), F.floor(F.col("x") / skip).alias("x")).agg(*[F.avg(c).alias(c) for c in channels])


def _grid(frames: DataFrame, width: int, height: int) -> DataFrame:
    """All target positions of each frame: generated from its key, not joined."""
    ys = frames.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return ys.select("frame", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def resize_nearest(px: DataFrame, channels: list[str], width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """The sample at floor(i * old / new).  Each source sample is repeated to the targets that read it."""
    targets = lambda c, old, new: F.sequence(F.ceil(F.col(c) * new / F.lit(old)), F.ceil((F.col(c) + 1) * new / F.lit(old)) - 1)
    some = lambda c, old, new: F.ceil(F.col(c) * new / F.lit(old)) <= F.ceil((F.col(c) + 1) * new / F.lit(old)) - 1
    rows = px.where(some("x", width, new_width) & some("y", height, new_height))
    rows = rows.select("frame", F.explode(targets("y", height, new_height)).alias("y"), F.col("x"), *channels)
    return rows.select("frame", "y", F.explode(targets("x", width, new_width)).alias("x"), *channels)


def _resample(px: DataFrame, channels: list[str], axis: str, taps: list[list[tuple[int, float]]]) -> DataFrame:
    """One axis resampled by a table of (source, weight) per target: each sample is sent to the targets it weighs in, and
    the parts are summed.  ``taps`` is as long as the new axis."""
    other = "y" if axis == "x" else "x"
    uses: dict[int, list[tuple[int, float]]] = {}
    for target, sources in enumerate(taps):
        for s, w in sources:
            uses.setdefault(s, []).append((target, w))
    spark = px.sparkSession
    table = spark.createDataFrame([(s, t, float(w)) for s, ts in uses.items() for t, w in ts], f"{axis} bigint, _t bigint, _w double")
    rows = px.withColumn(axis, F.col(axis).cast("bigint")).join(F.broadcast(table), axis)  # a few rows a line of the target
    sums = rows.groupBy("frame", other, "_t").agg(*[(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in channels])
    return sums.withColumnRenamed("_t", axis)


def bilinear_taps(old: int, new: int) -> list[list[tuple[int, float]]]:
    """Source coordinate i * old / new, without a half-sample shift."""
    out = []
    for i in range(new):
        at = i * old / new
        k = floor(at)
        out.append([(k, 1 - (at - k)), (min(k + 1, old - 1), at - k)] if at > k else [(k, 1.0)])
    return out


def lanczos_taps(old: int, new: int, a: float = 3.0) -> list[list[tuple[int, float]]]:
    """Windowed sinc around (i + 0.5) / scale - 0.5; wider when shrinking; weights are normalised where they are used."""
    scale = new / old
    spread = min(scale, 1.0)
    out = []
    for i in range(new):
        at = (i + 0.5) / scale - 0.5
        row = []
        for k in range(max(0, floor(at - a / spread) + 1), min(old, floor(at + a / spread) + 1)):
            z = spread * (at - k)
            w = 1.0 if abs(z) < 1e-5 else 0.0 if abs(z) > a else a * sin(pi * z) * sin(pi * z / a) / (pi * z) ** 2
            row.append((k, w))
        out.append(row)
    return out


def resize_bilinear(px: DataFrame, channels: list[str], width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    return _resample(_resample(px, channels, "x", bilinear_taps(width, new_width)), channels, "y", bilinear_taps(height, new_height))


def resize_lanczos(px: DataFrame, channels: list[str], width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    return _resample(_resample(px, channels, "x", lanczos_taps(width, new_width)), channels, "y", lanczos_taps(height, new_height))


def resize_scale(mode: str, width: int, height: int, value: float = 1.0, box: tuple[int, int] = (0, 0)) -> float:
    """The factor of a resize request: scale, width, height, fit (both), long or short edge; differences up to 1e-5 are 1."""
    s = {"scale": value, "width": box[0] / width, "height": box[1] / height, "fit": min(box[0] / width, box[1] / height), "long": max(box) / max(width, height), "short": min(box) / min(width, height)}[mode]
    return 1.0 if abs(s - 1) <= 1e-5 else s


def gradient_gain(x: Column, y: Column, width: int, height: int, degree: float, feather: float, strength: float, cx: float = 0.0, cy: float = 0.0) -> Column:
    """A graduated filter in stops: 1 on one side of a feathered band through the centre, 2^-strength on the other."""
    from math import cos, hypot, radians

    u, v = cos(radians(degree)), sin(radians(degree))
    across = (x - width * (0.5 + cx / 2)) * -v + (y - height * (0.5 + cy / 2)) * u
    band = max(feather / 100 * hypot(width, height), 1e-6)
    t = F.least(F.greatest(across / band + 0.5, F.lit(0.0)), F.lit(1.0))
    smooth = t * t * (3 - 2 * t)
    return F.pow(F.lit(2.0), -strength * smooth)


def vignette_gain(x: Column, y: Column, width: int, height: int, strength: float, feather: float, roundness: float) -> Column:
    """A post-crop vignette in stops from the centre of a superellipse outwards."""
    n = 2 + 10 * (1 - roundness)
    d = F.pow(F.pow(F.abs(2 * x / width - 1), n) + F.pow(F.abs(2 * y / height - 1), n), 1 / n)
    t = F.least(F.greatest((d - (1 - feather)) / max(feather, 1e-6), F.lit(0.0)), F.lit(1.0))
    return F.pow(F.lit(2.0), -strength * t * t * (3 - 2 * t))


def radial_gain(x: Column, y: Column, width: int, height: int, terms: list[float]) -> Column:
    """1 + sum of terms k_i r^(2 i), r relative to half the diagonal."""
    r2 = (F.pow(x - (width - 1) / 2, 2) + F.pow(y - (height - 1) / 2, 2)) / ((width * width + height * height) / 4)
    gain = F.lit(1.0)
    for i, k in enumerate(terms, 1):
        gain = gain + k * F.pow(r2, i)
    return gain


def distort(x: Column, y: Column, width: int, height: int, k: tuple[float, float, float], shift: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """Radial (three terms) and tangential distortion of coordinates around the centre."""
    f = max(width, height)
    u, v = (x - width / 2) / f, (y - height / 2) / f
    r2 = u * u + v * v
    radial = 1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))
    common = 2 * (shift[1] * u + shift[0] * v)
    return (u * (radial + common) + shift[1] * r2) * f + width / 2, (v * (radial + common) + shift[0] * r2) * f + height / 2


def tiles(size: int, overlap: int, width: int, height: int) -> dict[str, int]:
    """Counts, sizes and strides of overlapping tiles; sizes are even, one tile covers what fits."""
    def one(dim: int) -> tuple[int, int, int]:
        if size >= dim:
            return 1, dim, dim
        n = ceil(dim / (size - overlap))
        s = ceil(dim / n) + overlap
        s += s & 1
        return n, s, s - overlap

    (nw, w, sw), (nh, h, sh) = one(width), one(height)
    return {"tiles_x": nw, "tiles_y": nh, "tile_width": w, "tile_height": h, "skip_x": sw, "skip_y": sh}


def spot_dependencies(spots: list[dict], visible: set[int]) -> set[int]:
    """Spots needed to draw the visible ones: a spot needs earlier spots whose target overlaps its source, and theirs.

    Spots are the user's marks on one picture, a list of the driver's.
    """
    def meet(a: tuple, b: tuple) -> bool:
        return a[0] - a[2] < b[0] + b[2] and b[0] - b[2] < a[0] + a[2] and a[1] - a[2] < b[1] + b[2] and b[1] - b[2] < a[1] + a[2]

    needed, todo = set(visible), sorted(visible)
    while todo:
        i = todo.pop()
        for j in range(i):
            if j not in needed and meet(spots[i]["source"], spots[j]["target"]):
                needed.add(j)
                todo.append(j)
    return needed


def gain_map(px: DataFrame, grid: DataFrame, width: int, height: int, points_x: int, points_y: int, value: str, out: str, black: float) -> DataFrame:
    """Bilinear gains from a (parity, gy, gx, gain) grid, applied above the black level; the map is chosen by the parity
    of row and column."""
    fx = F.col("x") * (points_x - 1) / F.lit(width)
    fy = F.col("y") * (points_y - 1) / F.lit(height)
    rows = px.withColumn("parity", (F.col("y") % 2) * 2 + F.col("x") % 2).withColumns({"_gx": F.floor(fx), "_gy": F.floor(fy), "_tx": fx - F.floor(fx), "_ty": fy - F.floor(fy)})
    table = F.broadcast(grid)  # points_x * points_y rows for each of four parities
    gain = F.lit(0.0)
    for dy in (0, 1):
        for dx in (0, 1):
            node = table.select(F.col("parity"), (F.col("gy") - dy).alias("_gy"), (F.col("gx") - dx).alias("_gx"), F.col("gain").alias(f"_g{dy}{dx}"))
            rows = rows.join(node, ["parity", "_gy", "_gx"], "left")
            w = (F.col("_ty") if dy else 1 - F.col("_ty")) * (F.col("_tx") if dx else 1 - F.col("_tx"))
            gain = gain + w * F.coalesce(f"_g{dy}{dx}", F.lit(1.0))
    return rows.withColumn(out, (F.col(value) - black) * gain + black).drop("parity", "_gx", "_gy", "_tx", "_ty", "_g00", "_g01", "_g10", "_g11")
