"""What shows on larger tables only: keys past a million, and what a task holds."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumicat import queries as catalog
from lumicat.operators import frames, match, tiles

from .compare import connect, difference


def test_cache_upsert_past_a_million(spark, sf_dir, tmp_path):
    """Numbers that added shots get are then taken by shots of the table."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    both = part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1000000))
    both.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.QUERIES["cache_upsert"](spark, str(tmp_path))
    assert difference(df, connect(str(tmp_path)), catalog.ORACLE_SQL["cache_upsert"]) == ""


def test_nearest_settings_hold_no_pairs(spark):
    """Pairs of settings go through hash aggregates of a row a setting; none are sorted or gathered."""
    r = random.Random(21)
    row = lambda i: (i, r.choice("ab"), "m", r.choice([100, 200, 300, 400, 800]), r.choice([0.5, 0.25, 0.125, 0.3]), r.choice([None, r.randint(0, 300_000)]))
    probes, darks = [row(i) for i in range(200)], [row(i) for i in range(14)]
    schema = "shot_id long, make string, model string, iso int, shutter double, ts long"
    df = match.dark_frames(spark.createDataFrame(probes, schema), spark.createDataFrame(darks, schema).withColumnRenamed("shot_id", "frame_id"))
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    got = {x.shot_id: (x.frame_id, x.distance) for x in df.collect()}
    assert len(got) == len(probes) == df.count()
    for i, make, _, iso, shutter, ts in probes:
        timed = [(abs(ts - d[5]), d[0]) for d in darks if d[1:5] == (make, "m", iso, shutter) and d[5] is not None] if ts is not None else []
        near = [(math.hypot(math.log2(iso / d[3]), math.log2(shutter / d[4])), d[0]) for d in darks if d[1] == make]
        least = min(near)[0]
        want = (min(timed)[1], 0.0) if timed else (min(j for d, j in near if d - least < 1e-9), pytest.approx(least, abs=1e-9))
        assert got[i] == want


def test_tiles_get_pieces_not_pixels(spark):
    """Pixels reach their tiles as pieces of many samples, and in any order of the rows the tiles are the same."""
    px = spark.range(2 * 3000).select((F.col("id") / 3000).cast("long").alias("frame"), (F.col("id") % 3000 / 50).cast("long").alias("y"), (F.col("id") % 50).alias("x"), (F.col("id") * 7919 % 997).cast("double").alias("v"))
    df = tiles.apply_kernel(px, ["v"], lambda a: {"o": tiles.gaussian(a, 2.0)}, ["o"], 16, 6)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    pieces = tiles.halo_tiles(px.coalesce(1), ["v"], 16, 6).selectExpr("length(at) div 4 as n", "length(samples) div 8 as m").collect()
    lines = lambda n: sum(k // 16 * 16 - 6 <= c < k // 16 * 16 + 22 for c in range(n) for k in range(0, n + 6, 16))
    assert sum(p.n for p in pieces) == sum(p.m for p in pieces) == 2 * lines(60) * lines(50)
    assert len(pieces) < 2 * 3000 / 20
    mixed = tiles.apply_kernel(px.orderBy(F.hash("frame", "y", "x")), ["v"], lambda a: {"o": tiles.gaussian(a, 2.0)}, ["o"], 16, 6)
    assert df.count() == 6000 and df.exceptAll(mixed).count() == 0
    assert tiles.apply_kernel(px.where("v < 0"), ["v"], lambda a: {"o": a}, ["o"], 16, 6).count() == 0


def test_quantile_counts_have_short_keys(spark):
    """Counts of magnitudes are kept under two numbers; no name of a column goes with each of them."""
    values = [0.0, 5e-324, 1e-300, 3.0, -3.0, 7.0, 1.7e308, float("inf"), None]
    px = spark.createDataFrame([(f, v, -2.0 * f) for f in range(2) for v in values], "frame long, a double, b double")
    df = frames.quantiles(px, ["a", "b"], 0.5, "_q")
    keys = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_count" in line]
    assert keys and all(line.partition("keys=[")[2].partition("]")[0].count(",") == 1 for line in keys)
    assert {r.frame: (r.a_q, r.b_q) for r in df.collect()} == {0: (pytest.approx(3, rel=0.002), 0.0), 1: (pytest.approx(3, rel=0.002), pytest.approx(2, rel=0.002))}
    assert frames.quantiles(px, ["a"], 1.0, "_q").first().a_q == float("inf")


@pytest.mark.parametrize("name", ["tile_wavelet", "tile_shrinkage", "tile_retinex"])
def test_whole_frame_queries_send_no_pixel_rows_to_tiles(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["tile_wavelet", "tile_shrinkage"])
def test_noise_is_counted_where_tiles_are(spark, sf_dir, name):
    """No row a pixel and level reaches a hash aggregate; a frame's bins travel as arrays, and its pixels meet one row unsorted."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" not in plan and "Generate" not in plan and "Window" not in plan
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_tile_quantiles_are_those_of_the_pixels(spark):
    """Zeros, both signs, ends of the range, missing numbers, a ragged frame and one of a pixel."""
    r = random.Random(5)
    odd = [0.0, 1.0, -8.0, 0.25, 5e-324, 1e-300, 1.7e308, math.inf, -math.inf, math.nan]
    rows = [(f, i // 40, i % 40, r.choice(odd) if i % 3 == f % 3 else r.gauss(0, 900)) for f, n in enumerate([1600, 1600, 1333, 1]) for i in range(n)]
    px = spark.createDataFrame(rows, "frame long, y long, x long, a double").repartition(5)
    pieces = tiles.tile_pieces(px, ["a"], 16, 6)
    for share in (0.001, 0.5, 1.0):
        df = frames.tile_quantiles(pieces, lambda a: {"a": a, "b": -2 * a, "z": 0 * a}, ["a", "b"], share, "_q", 16, 6)
        got, want = ({x.frame: (x.a_q, x.b_q) for x in d.collect()} for d in (df, frames.quantiles(px.withColumn("b", -2 * px.a), ["a", "b"], share, "_q")))
        assert len(got) == 4 and got == want
    assert frames.tile_quantiles(tiles.tile_pieces(px.where("y < 0"), ["a"], 16, 6), lambda a: {"a": a}, ["a"], 0.5, "_q", 16, 6).count() == 0


@pytest.mark.parametrize("ordered", [True, False])
def test_merged_counts_hold_a_bounded_number(monkeypatch, ordered):
    monkeypatch.setattr(frames, "HELD", 400)
    r = random.Random(6)
    rows = [(r.randrange(40), (r.randrange(3) << 20) + r.randrange(30), r.randrange(1, 5)) for _ in range(6000)]
    rows = sorted(rows) if ordered else rows
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 100], strict=True)], names=["frame", "at", "n"]) for k in range(0, 6000, 100)]
    want, got, pieces, most = collections.Counter(), collections.Counter(), 0, 0
    for f, a, n in rows:
        want[f, a] += n
    for b in frames._merged(iter([*batches[:7], batches[0].slice(0, 0), *batches[7:]])):
        pieces += b.num_rows
        entries = 0
        for f, c, a, n in zip(*(b[k].to_pylist() for k in ("frame", "c", "at", "n")), strict=True):
            at, counts = np.frombuffer(a, np.int32).tolist(), np.frombuffer(n, np.int64).tolist()
            assert len(at) == len(counts) == len(set(at)) and {k >> 20 for k in at} == {c}
            entries += len(at)
            for k, m in zip(at, counts, strict=True):
                got[f, k] += m
        most = max(most, entries)
    assert got == want and most <= 500
    assert pieces <= (3 * 40 + 60 if ordered else 6000)
    assert list(frames._merged(iter([]))) == []
