"""Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import catalog


def watch_folder(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream.  Removals don't show; compare listings for them (``catalog.listing_changes``)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def coalesced(events: DataFrame, actions: DataFrame) -> DataFrame:
    """Running coalesced mask and latest edit of each image: a stateful aggregate for complete or update mode."""
    masked = events.join(F.broadcast(actions), "event", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))  # one row an event kind
    return masked.groupBy("image").agg(F.bit_or("mask").alias("mask"), F.max("seq").alias("last_seq"), F.count("*").alias("n_edits"))


def running_facets(shots: DataFrame, *by: str) -> DataFrame:
    """The catalog's facets over what has arrived so far; for complete mode."""
    return catalog.facets(shots, *by)


def history(events: DataFrame) -> DataFrame:
    """Collapsed history as a stream: when an image's event kind changes, the finished run's last edit is emitted; the
    open run stays in state (its last edit)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, event in zip(rows["seq"], rows["event"], strict=True):
            if last and event != last[1]:
                out.append((key[0], last[0], last[1]))
            last = [int(seq), event]
        if last:
            state.update(tuple(last))
        yield pd.DataFrame(out, columns=["image", "seq", "event"])

    return events.groupBy("image").applyInPandasWithState(step, "image long, seq long, event string", "seq long, event string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now and gives the result: the batch queue's loop until it is empty.

    Each micro-batch is written under its number in the shared folder ``path``; the result of complete mode is the last one, of
    append mode all of them, of update mode all versions with their ``batch``.
    """
    spark, written = stream.sparkSession, []

    def write(batch: DataFrame, number: int) -> None:
        written.append(number)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:  # nothing was there
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(path)
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows if mode == "update" else rows.drop("batch")


def sink_batches(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Each micro-batch written once under its own number: a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
