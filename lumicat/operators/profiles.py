"""Parameters and profiles: changed fields, jobs, lookups of lenses and camera profiles, hooks, look tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import photo


def changed(a: Column, b: Column, fields: list[str]) -> Column:
    """Whether two structs differ in one of the fields; nulls are values."""
    out = F.lit(False)
    for f in fields:
        out = out | ~a.getField(f).eqNullSafe(b.getField(f))
    return out


def plan_jobs(files: DataFrame, profiles: list[dict], sidecars: DataFrame | None = None, on_missing: str = "skip") -> DataFrame:
    """(file, fields...) of a batch run: the last profile that sets a field wins; with ``sidecars`` (file, fields...) a
    file's own fields go over them, and files without one are skipped or keep the profiles alone."""
    fields = sorted({k for p in profiles for k in p} | set(sidecars.columns if sidecars is not None else ()) - {"file"})
    last = {k: next((p[k] for p in reversed(profiles) if k in p), None) for k in fields}
    if sidecars is None:
        return files.select("file", *[F.lit(last[k]).alias(k) for k in fields])
    own = sidecars.select("file", *[F.col(k).alias(f"_{k}") for k in sidecars.columns if k != "file"])
    rows = files.join(own, "file", "inner" if on_missing == "skip" else "left")
    value = lambda k: F.coalesce(F.col(f"_{k}"), F.lit(last[k])) if k in sidecars.columns else F.lit(last[k])
    return rows.select("file", *[value(k).alias(k) for k in fields])


def find_lens(shots: DataFrame, lenses: DataFrame) -> DataFrame:
    """(shot_id, lens, lens_id): the entry of the same name whose crop factor is nearest to and not above the camera's,
    else the nearest; names without case."""
    kinds = lenses.select("lens_id", F.lower("lens").alias("_l"), F.col("crop").alias("_c"))
    pair = shots.select("shot_id", "lens", "crop", F.lower("lens").alias("_l")).join(kinds, "_l", "left")
    best = F.struct((F.col("_c") > F.col("crop")).alias("above"), F.abs(F.col("_c") - F.col("crop")).alias("d"), F.col("lens_id").alias("id"))
    return pair.groupBy("shot_id", "lens").agg(F.min(F.when(F.col("lens_id").isNotNull(), best))["id"].alias("lens_id"))


def standard_profile(shots: DataFrame, standard: DataFrame, files: DataFrame) -> DataFrame:
    """(shot_id, path): the standard set's profile of the camera (without case), else a file named after the camera."""
    a = standard.select(F.lower("camera").alias("_k"), F.col("path").alias("_a"))
    b = files.where(photo.file_type("path") == "dcp").select(F.lower(photo.without_extension(photo.base_name("path"))).alias("_k"), F.col("path").alias("_b"))
    rows = shots.select("shot_id", F.lower("camera").alias("_k"))
    return rows.join(a, "_k", "left").join(b, "_k", "left").select("shot_id", F.coalesce("_a", "_b").alias("path"))


def build_profiles(shots: DataFrame, build: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function from metadata to parameters, over Arrow batches: the extension point for custom profiles."""

    def run(batches):
        for pdf in batches:
            yield build(pdf)

    return shots.mapInPandas(run, schema)


def register_action(actions: DataFrame, event: str, mask: int) -> DataFrame:
    """The action table with one event's stages set."""
    row = actions.sparkSession.createDataFrame([(event, mask)], actions.select("event", "mask").schema)
    return actions.where(F.col("event") != event).unionByName(row)


def hue_sat_table(h: Column, s: Column, v: Column, table: list[tuple[float, float, float]], hues: int, sats: int) -> tuple[Column, Column, Column]:
    """A look table (hue shift in degrees, saturation and value scale) of hues x sats entries, bilinear, hues wrapping.

    h in turns, s and v in 0..1.
    """
    planes = [F.array(*[F.lit(float(t[i])) for t in table]) for i in range(3)]
    at_h, at_s = h * hues, F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * (sats - 1)
    ih, is_ = F.floor(at_h), F.least(F.floor(at_s), F.lit(max(sats - 2, 0)))
    fh, fs = at_h - ih, at_s - is_
    out = []
    for plane in planes:
        total = F.lit(0.0)
        for dh in (0, 1):
            for ds in (0, 1):
                index = (F.pmod(ih + dh, F.lit(hues)) * sats + F.least(is_ + ds, F.lit(sats - 1))).cast("int")
                total = total + (fh if dh else 1 - fh) * (fs if ds else 1 - fs) * F.get(plane, index)
        out.append(total)
    hue = h + out[0] / 360
    return hue - F.floor(hue), F.least(s * out[1], F.lit(1.0)), v * out[2]


def spot_white_balance(px: DataFrame, spots: list[tuple[int, int]], size: int, top: float) -> DataFrame:
    """(frame, r, g, b, n): means of the unclipped pixels in squares around the picked points; a pixel counts once a point."""
    table = px.sparkSession.createDataFrame(list(spots), "sx int, sy int")
    half = size // 2
    near = (F.col("x").between(F.col("sx") - half, F.col("sx") + half)) & (F.col("y").between(F.col("sy") - half, F.col("sy") + half))
    rows = px.where(F.greatest("r", "g", "b") < top).join(F.broadcast(table), near)  # the picked points: a few rows
    return rows.groupBy("frame").agg(*[F.avg(c).alias(c) for c in "rgb"], F.count("*").alias("n"))
