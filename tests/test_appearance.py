"""Published values and inverses of the staged models; profiles."""

import numpy as np
from pyspark.sql import functions as F

from lumicat.functions import appearance
from lumicat.operators import profiles


def test_ciecam02_published_value(spark):
    v = appearance.Viewing((95.05, 100.0, 108.88), 318.31, 20.0, "average")
    df = spark.createDataFrame([(19.01, 20.0, 21.78)], "x double, y double, z double")
    r = appearance.staged(df, appearance.ciecam02(v, "x", "y", "z")).first()
    assert np.allclose([r.J, r.C, r.h, r.Q, r.M, r.s], [41.73, 0.1047, 219.05, 195.37, 0.1088, 2.36], atol=0.01)


def test_ciecam02_inverse(spark):
    v = appearance.Viewing(adapting=60.0, surround="dim")
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(5, 90, (200, 3))], "x double, y double, z double")
    df = df.where("abs(x - y) < 30 and abs(z - y) < 40")
    out = appearance.staged(appearance.staged(df, appearance.ciecam02(v, "x", "y", "z")), appearance.xyz_from_ciecam02(v, "J", "C", "h")).toPandas()
    assert len(out) > 20 and np.allclose(out[["x", "y", "z"]], out[["out_x", "out_y", "out_z"]], rtol=1e-6)


def test_adaptation_maps_white_to_white():
    white, target = (109.85, 100.0, 35.58), (95.047, 100.0, 108.883)
    m = appearance.cat02(white, target)
    assert np.allclose(np.array(m) @ white, target)
    assert np.allclose(appearance.cat02(white, target, 0.0), np.eye(3), atol=1e-9)


def test_gamma_parameters_are_continuous():
    p = appearance.gamma_parameters(2.4, 12.92)
    t, o, s = p["threshold"], p["offset"], p["slope"]
    assert abs((1 + o) * t ** (1 / 2.4) - o - s * t) < 1e-6 and abs(t - 0.00304) < 2e-4


def test_chroma_reduction(spark):
    df = spark.createDataFrame([(16000.0, 100.0, 100.0), (16000.0, 40000.0, 0.0)], "l double, a double, b double")
    got = [r.share for r in appearance.staged(df, appearance.reduce_chroma("l", "a", "b")).collect()]
    assert got[0] == 1.0 and 0.05 < got[1] < 0.9


def test_bw_mixer():
    assert np.isclose(sum(appearance.bw_mixer(43, 33, 30, "red")), 1)
    assert appearance.bw_mixer(100, 0, 0, "cyan", normalise=False)[0] == 0.05


def test_profiles(spark):
    s = spark.createDataFrame([(1, None), (1, 1)], "a int, b int")
    pair = s.select(F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b")).alias("p"), F.struct("a", "b").alias("q"))
    assert [r.c for r in pair.select(profiles.changed(F.col("p"), F.col("q"), ["a", "b"]).alias("c")).collect()] == [False, True]
    acts = spark.createDataFrame([("x", 1)], "event string, mask int")
    assert sorted(tuple(r) for r in profiles.register_action(profiles.register_action(acts, "y", 2), "x", 5).collect()) == [("x", 5), ("y", 2)]
    shots = spark.createDataFrame([(1, "M A"), (2, "M B"), (3, "M C")], "shot_id int, camera string")
    std = spark.createDataFrame([("m a", "/std/a")], "camera string, path string")
    files = spark.createDataFrame([("/d/M B.dcp",), ("/d/M C.txt",)], "path string")
    assert {r.shot_id: r.path for r in profiles.standard_profile(shots, std, files).collect()} == {1: "/std/a", 2: "/d/M B.dcp", 3: None}
    built = profiles.build_profiles(shots, lambda p: p.assign(v=p.shot_id * 2)[["shot_id", "v"]], "shot_id int, v int")
    assert sorted(r.v for r in built.collect()) == [2, 4, 6]


def test_neutral_hue_table_is_identity(spark):
    df = spark.createDataFrame([(0.1, 0.5, 0.7), (0.95, 1.0, 0.2)], "h double, s double, v double")
    out = df.select(*profiles.hue_sat_table(F.col("h"), F.col("s"), F.col("v"), [(0.0, 1.0, 1.0)] * 12, 4, 3)).collect()
    assert np.allclose([tuple(r) for r in out], [(0.1, 0.5, 0.7), (0.95, 1.0, 0.2)])
