"""Incremental recomputation: edit events, stage masks, coalescing and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stage_masks(events: DataFrame, actions: DataFrame, key: str = "event") -> DataFrame:
    """``mask`` of each event; unknown events have none (0).  The action table is a small dimension."""
    return events.join(actions, key, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def coalesce_edits(masked: DataFrame, image: str = "image", seq: str = "seq", params: str = "params") -> DataFrame:
    """One run an image: the union of the pending masks with the latest parameters; partial aggregates before the
    exchange, so a hot image is one row a task."""
    return masked.groupBy(image).agg(F.bit_or("mask").alias("mask"), F.max_by(params, seq).alias("params"), F.max(seq).alias("last_seq"), F.count("*").alias("n_edits"))


def collapse_history(edits: DataFrame, image: str = "image", seq: str = "seq", event: str = "event", keep: tuple = ()) -> DataFrame:
    """Runs of the same event become their last edit; events in ``keep`` never collapse."""
    w = W.partitionBy(image).orderBy(seq)
    last = F.lead(event).over(w)
    ends = last.isNull() | (last != F.col(event))
    return edits.withColumn("_ends", (ends | F.col(event).isin(*keep)) if keep else ends).where("_ends").drop("_ends")


def undo_position(position: int, size: int) -> int:
    return max(0, position - 1) if position >= 0 else max(0, size - 2)


def redo_position(position: int, size: int) -> int:
    return min(size - 1, position + 1) if position >= 0 else max(0, size - 2)


def job_order(jobs: DataFrame, batch: str) -> DataFrame:
    """Order inside a batch: priority jobs, then first-time jobs, then upgrades, each by arrival; repeated files once."""
    unique = jobs.dropDuplicates([batch, "folder", "file"])
    w = W.partitionBy(batch).orderBy(F.col("priority").desc(), "upgrade", "seq")
    return unique.withColumn("position", F.row_number().over(w))


def lru_keep(accesses: DataFrame, cache: str, key: str, seq: str, size: int) -> DataFrame:
    """The keys a least-recently-used cache of ``size`` entries holds after all accesses."""
    last = accesses.groupBy(cache, key).agg(F.max(seq).alias("last_access"))
    return last.withColumn("_r", F.row_number().over(W.partitionBy(cache).orderBy(F.desc("last_access")))).where(F.col("_r") <= size).drop("_r")


def stages_of(mask: Column, stages: dict[str, int]) -> Column:
    """Names of the stages whose bits a mask sets."""
    return F.filter(F.array(*[F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in stages.items()]), lambda s: s.isNotNull())
