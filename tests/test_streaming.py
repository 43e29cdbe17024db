"""Streams over files against the batch operators."""

from pyspark.sql import functions as F

from lumicat.operators import edits
from lumicat.plans import tables as T
from lumicat.streaming import edits as streaming


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    batch = T.table(spark, sf_dir, T.EDITS)
    src = str(tmp_path / "in")
    for i in range(3):
        batch.where(F.col("seq") % 3 == i).write.mode("append").parquet(src)
    actions = spark.createDataFrame([("click", 1), ("view", 2)], "event string, mask int")
    stream = streaming.watch_folder(spark, src, "image long, seq long, event string, params double", per_batch=2)
    got = streaming.drain(streaming.coalesced(stream, actions), "complete", str(tmp_path / "o1"), str(tmp_path / "c1"))
    want = edits.coalesce_edits(edits.stage_masks(batch, actions)).select("image", "mask", "last_seq", "n_edits")
    key = lambda df: sorted(tuple(r) for r in df.select("image", "mask", "last_seq", "n_edits").collect())
    assert key(got) == key(want)


def test_history_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    events = ["exp", "exp", "wb", "exp", "exp", "crop"]
    for i, e in enumerate(events):
        spark.createDataFrame([(1, i, e)], "image long, seq long, event string").coalesce(1).write.mode("append").parquet(src)
    stream = streaming.watch_folder(spark, src, "image long, seq long, event string", per_batch=100)
    got = streaming.drain(streaming.history(stream), "append", str(tmp_path / "o"), str(tmp_path / "c"))
    assert [r.seq for r in got.orderBy("seq").collect()] == [1, 2, 4]


def test_batches_are_written_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string").write.parquet(src)
    stream = streaming.watch_folder(spark, src, "k long, v string")
    streaming.sink_batches(stream, str(tmp_path / "out"), "k", str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_draining_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = streaming.watch_folder(spark, str(tmp_path / "in"), "image long, seq long, event string")
    got = streaming.drain(stream, "append", str(tmp_path / "out"), str(tmp_path / "c"))
    assert got.count() == 0 and got.columns == ["image", "seq", "event"]
