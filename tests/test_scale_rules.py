"""Operators whose plans must not meet all pairs or hold a group at once, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lumicat.operators import histogram, match, tone


def test_nearest_in_time_over_spans(spark):
    r = random.Random(4)
    frames = [(f"k{r.randint(0, 3)}", i, r.choice([0, 50, 86_400, r.randint(0, 900_000)])) for i in range(80)]
    probes = [(i, f"k{r.randint(0, 4)}", r.choice([None, 25, 86_399, 86_400, r.randint(0, 1_000_000)])) for i in range(300)]
    p = spark.createDataFrame(probes, "shot_id long, _key string, _t long")
    f = spark.createDataFrame(frames, "_key string, _f long, _t long")
    for span in (86_400, 1_000, 10_000_000):
        got = {x.shot_id: x.frame_id for x in match.nearest_in_time(p, f, "shot_id", span).collect()}
        want = {}
        for i, k, t in probes:
            if t is not None and (near := [(abs(t - u), j) for key, j, u in frames if key == k]):
                want[i] = min(near)[1]
        assert got == want


def test_nearest_calibration_with_nulls(spark):
    probes = spark.createDataFrame([(1, "A", "m", 100, 0.5, 10), (2, "a", "M", 200, 0.5, 10), (3, "a", "m", None, 0.5, 10), (4, "b", "m", 100, 0.5, 10), (5, "a", "m", 200, 0.5, 99)], "shot_id long, make string, model string, iso int, shutter double, ts long")
    darks = spark.createDataFrame([(7, "a", "m", 100, 0.5, 0), (8, "a", "m", 100, 0.5, 19), (9, "a", "m", 400, 0.5, 0)], "frame_id long, make string, model string, iso int, shutter double, ts long")
    got = {x.shot_id: (x.frame_id, x.distance) for x in match.dark_frames(probes, darks).collect()}
    assert got == {1: (8, 0.0), 2: (7, 1.0), 3: (None, None), 4: (None, None), 5: (7, 1.0)}


def test_medians_are_exact(spark):
    r = random.Random(5)
    rows = [(f, y, x, *[r.choice([1.0, 2.0, 7.5, r.random()]) for _ in range(3)]) for f in range(2) for y in range(9 + f) for x in range(8)]
    px = spark.createDataFrame(rows, "frame long, y int, x int, r double, g double, b double")
    got = {x.frame: (x.r, x.g, x.b) for x in histogram.channel_medians(px, 0.0, 8, 10).collect()}
    for f in range(2):
        for k in range(3):
            v = sorted(row[3 + k] for row in rows if row[0] == f)
            assert got[f][k] == pytest.approx((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)


def test_spots_in_layers_and_in_order(spark):
    r = random.Random(6)
    px = {(y, x): float(r.randint(0, 999)) for y in range(40) for x in range(40)}
    spots = [{"source": (r.randint(4, 35), r.randint(4, 35)), "target": (r.randint(4, 35), r.randint(4, 35)), "radius": r.choice([2, 3]), "feather": r.choice([0.0, 0.5]), "opacity": r.choice([1.0, 0.6])} for _ in range(7)]
    spots.append({"source": spots[0]["target"], "target": (20, 20), "radius": 2})
    layers = tone._spot_layers(spots)
    assert sum(map(len, layers)) == len(spots) and 1 < len(layers) <= len(spots)
    df = spark.createDataFrame([(1, y, x, v) for (y, x), v in px.items()], "frame long, y long, x long, v double")
    got = {(q.y, q.x): q.v for q in tone.remove_spots(df, spots, ["v"]).collect()}
    for s in spots:
        (sx, sy), (tx, ty), rad = s["source"], s["target"], s["radius"]
        hard, most, old = rad * (1 - s.get("feather", 0.0)), s.get("opacity", 1.0), dict(px)
        for y in range(ty - rad, ty + rad + 1):
            for x in range(tx - rad, tx + rad + 1):
                d = ((x - tx) ** 2 + (y - ty) ** 2) ** 0.5
                if (y, x) in px and (src := (y + sy - ty, x + sx - tx)) in old and d <= rad:
                    w = most if d <= hard else most * (rad - d) / max(rad - hard, 1e-9)
                    px[y, x] = w * old[src] + (1 - w) * old[y, x]
    assert got.keys() == px.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in px.items())
    assert df.exceptAll(tone.remove_spots(df, [], ["v"])).count() == 0


def test_probes_and_frames_are_not_joined(spark):
    """The nearest match joins no frame with a probe of its key."""
    p = spark.createDataFrame([(1, "k", 5)], "shot_id long, _key string, _t long")
    f = spark.createDataFrame([("k", 1, 2)], "_key string, _f long, _t long")
    df = match.nearest_in_time(p, f, "shot_id")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and df.select(F.count("*")).first()[0] == 1


def test_cubes_by_cells_equal_literal_tables(spark):
    from lumicat.functions import curves

    r = random.Random(9)
    level = 4
    table = [(r.random(), r.random(), r.random()) for _ in range(level**3)]
    nodes = spark.createDataFrame([(i % level, i // level % level, i // level**2, *[65535 * v for v in t]) for i, t in enumerate(table)], "ri long, gi long, bi long, r double, g double, b double")
    rows = [(i, *[r.choice([0.0, 65535.0, -5.0, 70000.0, 65535 * r.random()]) for _ in range(3)], "x") for i in range(200)]
    px = spark.createDataFrame(rows, "id long, r double, g double, b double, ci string")
    px = px.withColumnRenamed("ci", "note")
    got = {x.id: x for x in curves.apply_cube(px, nodes, level).collect()}
    assert len(got) == 200 and px.columns == curves.apply_cube(px, nodes, level).columns
    want = px.select("id", *[c.alias(n) for n, c in zip("rgb", curves.cube_lookup(F.col("r") / 65535, F.col("g") / 65535, F.col("b") / 65535, table, level), strict=True)])
    for x in want.collect():
        assert (got[x.id].r, got[x.id].g, got[x.id].b) == pytest.approx((65535 * x.r, 65535 * x.g, 65535 * x.b), abs=1e-6)
    plan = curves.apply_cube(px, nodes, level)._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHint" in plan or "broadcast" in plan.lower()


def test_calibration_groups_in_one_pass(spark):
    r = random.Random(12)
    rows = [(r.choice(["a", "b", None]), r.choice([100, 200]), r.choice([None, r.randint(0, 400_000), 7_200 * r.randint(0, 50)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "make string, iso int, ts long, id long")
    got = {x.id: x.group_start for x in match.calibration_groups(df, ["make", "iso"]).collect()}
    want = {}
    for k in {row[:2] for row in rows}:
        start = None
        for t, i in sorted((t, i) for *key, t, i in rows if tuple(key) == k and t is not None):
            if start is None or t - start > 6 * 3600:
                start = t
            want[i] = start
    assert got == {i: want.get(i) for *_, i in rows}
