"""Matching joins: nearest calibration frames, sensitivity levels, profile rules, bracketed lens frames.

Nearest matches run in two steps, so that no step is a nested loop over large sides: frames and probes of an exact key are read
together in the order of time; what is left is matched inside its camera, distinct settings against distinct calibration
settings, whose number doesn't grow with the shots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import photo


def stops(a: Column, b: Column) -> Column:
    """Distance in powers of two; null when either isn't positive."""
    return F.abs(F.log2(F.when((a > 0) & (b > 0), a / b)))


def calibration_key(fields: list[str]) -> Column:
    """Text key: numbers with two digits, so that values that print alike match."""
    return F.concat_ws(" ", *[F.upper(F.col(f)) if f in ("make", "model", "lens") else F.format_string("%.2f", F.col(f).cast("double")) for f in fields])


def nearest_calibration(probes: DataFrame, frames: DataFrame, exact: list[str], camera: list[str], weights: dict[str, float], probe_id: str = "shot_id", frame_id: str = "frame_id", time: str = "ts") -> DataFrame:
    """(probe_id, frame_id, distance): the frame of the same key nearest in time, else of the same camera the nearest in
    weighted stops (time doesn't count there); null without any.  Ties go to the smallest frame id.

    ``weights``: field -> weight of its squared distance in stops; fields that differ otherwise must be in ``camera``.
    """
    p = probes.select(probe_id, *camera, *weights, F.col(time).alias("_t"), calibration_key(exact).alias("_key"))
    f = frames.select(F.col(frame_id).alias("_f"), *[F.col(c).alias(f"_{c}") for c in (*camera, *weights)], F.col(time).alias("_t"), calibration_key(exact).alias("_key"))
    # a probe has a frame in time if its key has one with a time: known from the distinct keys, before anything is matched
    keys = f.where(F.col("_t").isNotNull() & F.col("_f").isNotNull()).select("_key").distinct().withColumn("_timed", F.lit(True))
    timed = F.coalesce(F.col("_timed"), F.lit(False)) & F.col("_t").isNotNull()
    known = p.join(keys, "_key", "left")
    same = nearest_in_time(known.where(timed).select(probe_id, "_key", "_t"), f.select("_key", "_f", "_t"), probe_id).withColumn("distance", F.lit(0.0))
    left = known.where(~timed)
    # frames that share all values are one candidate, the first of them; probes that do are matched once
    kinds = f.groupBy(*[f"_{c}" for c in (*camera, *weights)]).agg(F.min("_f").alias("_f"))
    fields = [*camera, *weights]
    distance = F.sqrt(sum((F.lit(w) * F.pow(stops(F.col(c).cast("double"), F.col(f"_{c}").cast("double")), 2) for c, w in weights.items()), F.lit(0.0)))

    def candidates(wanted: DataFrame) -> DataFrame:
        return wanted.join(kinds, [F.upper(wanted[c]) == F.upper(kinds[f"_{c}"]) for c in camera]).withColumn("_d", distance)

    # the least distance first, then the first frame at it: both hash aggregates, which hold a row a setting and no pairs
    near = candidates(left.select(*fields).distinct()).where(F.col("_d").isNotNull()).groupBy(*fields).agg(F.min("_d").alias("distance"))
    near = candidates(near).where(F.col("_d") == F.col("distance")).groupBy(*fields, "distance").agg(F.min("_f").alias("frame_id"))
    near = near.select(*[F.col(c).alias(f"_{c}") for c in fields], "frame_id", "distance")
    near = left.join(near, [left[c].eqNullSafe(near[f"_{c}"]) for c in fields], "left").select(probe_id, "frame_id", "distance")
    return same.unionByName(near)


def nearest_in_time(probes: DataFrame, frames: DataFrame, probe_id: str, span: int = 86_400) -> DataFrame:
    """(probe_id, frame_id): of the frames (_key, _f, _t) of a probe's key (probe_id, _key, _t) the nearest in time, then the
    smallest id; probes without any, or without a time, are left out.

    Both sides are dealt by key and ``span`` of time and read in the order of time, so neither a pair of a probe and a frame
    nor a key as a whole comes together anywhere.  Only spans with probes are read; what lies in others comes as one frame
    before and one after.
    """
    id_type, frame_type = probes.schema[probe_id].dataType, frames.schema["_f"].dataType
    at = F.floor(F.col("_t") / span).alias("_span")
    sole = frames.where(F.col("_t").isNotNull() & F.col("_f").isNotNull()).groupBy("_key", "_t").agg(F.min("_f").alias("_f")).select("_key", at, "_t", "_f")
    asked = probes.where(F.col("_t").isNotNull()).select("_key", at, "_t", F.col(probe_id).alias("_p"))
    spans = sole.withColumn("_probe", F.lit(False)).unionByName(asked.select("_key", "_span", F.lit(None).cast(sole.schema["_t"].dataType).alias("_t"), F.lit(None).cast(frame_type).alias("_f"), F.lit(True).alias("_probe")))
    # times differ within a key, so the frame at the last or first of them is one
    spans = spans.groupBy("_key", "_span").agg(F.max("_probe").alias("_probe"), F.max("_t").alias("_t1"), F.max_by("_f", "_t").alias("_f1"), F.min("_t").alias("_t0"), F.min_by("_f", "_t").alias("_f0"))
    ends = {k: F.when(F.col(f"_t{k}").isNotNull(), F.struct(F.col(f"_t{k}").alias("_t"), F.col(f"_f{k}").alias("_f"))) for k in (0, 1)}
    whole = W.partitionBy("_key").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select("_key", "_span", "_probe", F.last(ends[1], True).over(whole.orderBy("_span")).alias("_before"), F.last(ends[0], True).over(whole.orderBy(F.desc("_span"))).alias("_after")).where("_probe")
    carried = carried.select("_key", "_span", F.explode(F.array_compact(F.array("_before", "_after"))).alias("_x")).select("_key", "_span", "_x.*")
    inside = sole.join(asked.select("_key", "_span").distinct(), ["_key", "_span"], "left_semi")
    rows = inside.unionByName(carried).withColumn("_p", F.lit(None).cast(id_type)).withColumn("_probe", F.lit(False))
    rows = rows.unionByName(asked.withColumn("_f", F.lit(None).cast(frame_type)).withColumn("_probe", F.lit(True)))
    frame = F.when(~F.col("_probe"), F.struct("_t", "_f"))
    within = W.partitionBy("_key", "_span").rangeBetween(W.unboundedPreceding, 0)
    found = rows.withColumns({"_lo": F.max(frame).over(within.orderBy("_t")), "_hi": F.min(frame).over(within.orderBy(F.desc("_t")))}).where("_probe")
    gap = lambda c: F.struct(F.abs(F.col("_t") - F.col(f"{c}._t")).alias("gap"), F.col(f"{c}._f").alias("f"))
    best = F.least(*[F.when(F.col(c).isNotNull(), gap(c)) for c in ("_lo", "_hi")])
    return found.select(F.col("_p").alias(probe_id), best["f"].alias("frame_id")).where(F.col("frame_id").isNotNull())


def dark_frames(probes: DataFrame, darks: DataFrame) -> DataFrame:
    return nearest_calibration(probes, darks, ["make", "model", "iso", "shutter"], ["make", "model"], {"iso": 1.0, "shutter": 1.0})


def flat_fields(probes: DataFrame, flats: DataFrame) -> DataFrame:
    """Aperture counts double, lens must agree."""
    return nearest_calibration(probes, flats, ["make", "model", "lens", "focal", "aperture"], ["make", "model", "lens"], {"focal": 1.0, "aperture": 2.0})


def hot_pixels(matches: DataFrame, bad: DataFrame) -> DataFrame:
    """(shot_id, x, y) of the bad pixels of each shot's frame; ``bad``: (frame_id, pixels array of structs x, y)."""
    return matches.join(bad, "frame_id").select("shot_id", F.explode("pixels").alias("p")).select("shot_id", "p.x", "p.y")


def nearest_level(probes: DataFrame, levels: DataFrame, key: str, probe: str = "iso", level: str = "level_iso", probe_id: str = "shot_id") -> DataFrame:
    """The level entry of each probe's camera with the nearest sensitivity; ties go to the higher, sensitivities of 0 and
    less to the lowest entry; null without entries.  Probes with equal key and value are matched once."""
    wanted = probes.select(key, probe).distinct()
    off = F.when(F.col(probe) <= 0, F.col(level)).otherwise(F.abs(F.col(level) - F.col(probe)))
    best = wanted.join(levels, key).groupBy(key, probe).agg(F.min_by(F.struct(*[c for c in levels.columns if c != key]), F.struct(off.alias("a"), F.when(F.col(probe) <= 0, F.col(level)).otherwise(-F.col(level)).alias("b"))).alias("m"))
    return probes.select(probe_id, key, probe).join(best.select(key, probe, "m.*"), [key, probe], "left")


def white_level(level: Column, fnumber: Column, scale: dict[float, float], most: Column) -> Column:
    """A white level scaled by an aperture table: the exact entry, else the one a third of a stop rounds to, else the
    smallest larger one; capped."""
    exact = F.lit(None).cast("double")
    above = F.lit(None).cast("double")
    for f, factor in sorted(scale.items(), reverse=True):
        exact = F.when(F.abs(fnumber - f) < 1e-9, F.lit(factor)).otherwise(exact)
        above = F.when(fnumber < f, F.lit(factor)).otherwise(above)
    third = F.lit(None).cast("double")
    for f, factor in scale.items():
        third = F.when(F.round(F.log2(fnumber) * 6) == F.round(F.log2(F.lit(float(f))) * 6), F.lit(factor)).otherwise(third)
    return F.least(level * F.coalesce(exact, third, above, F.lit(1.0)), most)


def matching_rules(shots: DataFrame, rules: DataFrame) -> DataFrame:
    """(shot_id, serial, profile) of every rule that matches: inclusive ranges and text terms.

    The rule table is a small dimension: it is broadcast when Spark's own threshold finds it small enough.
    """
    inside = [F.col(f).between(F.col(f"{f}_min"), F.col(f"{f}_max")) for f in ("iso", "fnumber", "focal", "shutter")]
    text = [photo.text_match(F.col(f"{f}_value"), F.col(f), F.col(f"{f}_enabled")) for f in ("camera", "lens")]
    condition = inside[0]
    for term in (*inside[1:], *text):
        condition = condition & term
    return shots.join(rules, condition).select("shot_id", "serial", "profile")


def layered_profile(matches: DataFrame, profiles: DataFrame, fields: list[str]) -> DataFrame:
    """One row a shot: each field from the matching rule with the highest serial whose profile sets it."""
    rows = matches.join(profiles, "profile")
    return rows.groupBy("shot_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("serial"))).alias(f) for f in fields])


def bracket(probes: DataFrame, frames: DataFrame, key: str, by: str, values: list[str], probe_id: str = "shot_id") -> DataFrame:
    """``values`` interpolated linearly between the frames below and above each probe; beyond the ends the end frame."""
    f = frames.select(key, F.col(by).alias("_at"), *[F.col(v).alias(f"_{v}") for v in values])
    wanted = probes.select(key, by).distinct()
    entry = F.struct("_at", *[f"_{v}" for v in values])
    ends = wanted.join(f, key).groupBy(key, by).agg(F.max_by(entry, F.when(F.col("_at") <= F.col(by), F.col("_at"))).alias("lo"), F.min_by(entry, F.when(F.col("_at") >= F.col(by), F.col("_at"))).alias("hi"))
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    span = hi["_at"] - lo["_at"]
    t = F.when(span == 0, F.lit(0.0)).otherwise((F.col(by) - lo["_at"]) / span)
    out = ends.select(key, by, *[(lo[f"_{v}"] + t * (hi[f"_{v}"] - lo[f"_{v}"])).alias(v) for v in values])
    return probes.select(probe_id, key, by).join(out, [key, by], "left")


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left equi-join on a key without case."""
    t = table.withColumn("_k", F.upper(key)).drop(key)
    return rows.withColumn("_k", F.upper(key)).join(t, "_k", "left").drop("_k")


def calibration_groups(frames: DataFrame, key: list[str], ts: str = "ts", hours: int = 6) -> DataFrame:
    """``group_start``: frames of a key join the group of the first frame within ``hours`` of its start; null for a null time.

    Which frame starts a group depends on the start before it, so a key's distinct times are read in order, in one pass that
    holds a single start; no key is gathered.  Keys are told apart by all their values, nulls too.
    """
    span = hours * 3600
    named = frames.withColumn("_k", F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    times = named.where(F.col(ts).isNotNull()).select("_k", F.col(ts).cast("long").alias("_t")).distinct()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = None, 0
        for batch in batches:
            out = []
            for k, t in zip(batch["_k"].to_pylist(), batch["_t"].to_pylist(), strict=True):
                if k != known or t - start > span:
                    known, start = k, t
                out.append(start)
            yield pa.RecordBatch.from_arrays([batch["_k"], batch["_t"], pa.array(out, pa.int64())], names=["_k", "_t", "group_start"])

    starts = times.repartition("_k").sortWithinPartitions("_k", "_t").mapInArrow(fold, "_k string, _t long, group_start long")
    rows = named.join(starts, (named["_k"] == starts["_k"]) & (named[ts].cast("long") == starts["_t"]), "left")
    return rows.select(*[named[c] for c in frames.columns], "group_start")
