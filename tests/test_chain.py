"""Chains of stages against plain scalar versions, curves against their definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumicat.functions import curves
from lumicat.functions import formulas as S
from lumicat.operators import chain as C


def colors(n=60, seed=2):
    r = random.Random(seed)
    rows = [(i, *(r.uniform(0, 65535) for _ in range(3))) for i in range(n)]
    return rows + [(n, 0.0, 0.0, 0.0), (n + 1, 65535.0, 65535.0, 65535.0), (n + 2, 30000.0, 30000.0, 30000.0), (n + 3, 70000.0, 100.0, -50.0), (n + 4, 70000.0, 80000.0, 90000.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, r double, g double, b double").withColumn("_chain0_h", F.lit("mine"))


def run(spark, stages, rows=None):
    rows = rows or colors()
    out = C.develop(frame(spark, rows), stages)
    assert out.columns == ["id", "r", "g", "b", "_chain0_h"]
    got = {x.id: (x.r, x.g, x.b) for x in out.collect()}
    return [(row[1:], got[row[0]]) for row in rows]


def cut(curve, u, n=255):
    """A table's value: straight lines between n + 1 samples of the curve."""
    u = min(1.0, max(0.0, u)) * n
    k = min(int(u), n - 1)
    return curve(k / n) + (u - k) * (curve((k + 1) / n) - curve(k / n))


def test_no_stages_and_masks(spark):
    assert all(a == pytest.approx(b) for a, b in run(spark, []))
    rows = colors()
    halved = C.Mix(((0.5, 0, 0), (0, 0.5, 0), (0, 0, 0.5)), where="id % 3 = 0")
    for i, (a, b) in enumerate(run(spark, [halved, C.Exposure(1.0)], rows)):
        assert b == pytest.approx(tuple(v * (1.0 if i % 3 == 0 else 2.0) for v in a))
    never = C.Mix(((0, 0, 0),) * 3, where="nullif(id, id) = 1")
    assert all(a == pytest.approx(b) for a, b in run(spark, [never]))


def test_nulls_and_odd_names(spark):
    df = spark.createDataFrame([(1, None, 2.0, 3.0)], "y long, r double, g double, b double")
    got = C.develop(df, [C.Exposure(1), C.Tone(lambda t: t), C.LabCurves(chroma=10)]).first()
    assert got.y == 1 and got.r is None
    named = spark.createDataFrame([(1.0, 2.0, 3.0)], "red double, green double, blue double")
    assert tuple(C.develop(named, [C.Exposure(1)], "red", "green", "blue").first()) == (2.0, 4.0, 6.0)


def test_tone_modes(spark):
    curve = lambda t: t * (1.5 - 0.5 * t)
    at = lambda v: 65535 * cut(curve, v / 65535)
    for a, b in run(spark, [C.Tone(curve)]):
        some = any(0 <= v <= 65535 for v in a)
        assert b == pytest.approx(tuple(at(v) if some else v for v in a))
    for a, b in run(spark, [C.Tone(curve, mode="film")]):
        low, top = min(a), max(a)
        assert b == pytest.approx(tuple(at(low) + (at(top) - at(low)) * ((v - low) / (top - low) if top > low else 0) for v in a))
    for a, b in run(spark, [C.Tone(curve, mode="luminance")]):
        y = 0.2126729 * a[0] + 0.7151521 * a[1] + 0.0721750 * a[2]
        assert b == pytest.approx(tuple(v * at(y) / y if y > 1e-5 else v for v in a))
    with pytest.raises(ValueError, match="mode"):
        run(spark, [C.Tone(curve, mode="other")])


def test_the_perceptual_tone_curve_keeps_colours(spark):
    inside = [row for row in colors() if 0 <= min(row[1:]) and max(row[1:]) <= 65535]
    for a, b in run(spark, [C.Tone(lambda t: t, mode="perceptual")], inside):
        assert b == pytest.approx(a, rel=1e-5, abs=0.05)
    darker = run(spark, [C.Tone(lambda t: t * (0.6 + 0.4 * t), mode="perceptual")], inside)
    y = lambda v: 0.2126729 * v[0] + 0.7151521 * v[1] + 0.0721750 * v[2]
    # greys follow the curve; all colours get darker
    for a, b in darker:
        assert y(b) <= y(a) + 1e-6
        if a[0] == a[1] == a[2]:
            assert b[1] == pytest.approx(65535 * cut(lambda t: t * (0.6 + 0.4 * t), a[1] / 65535), rel=2e-3, abs=1)


def test_curves_and_lightness(spark):
    up = lambda t: math.sqrt(t)
    for a, b in run(spark, [C.Curves(red=up, blue=up)]):
        at = lambda v: 65535 * cut(up, v / 65535) if 0 <= v <= 65535 else v
        assert b == pytest.approx((at(a[0]), a[1], at(a[2])))
    greys = [(i, v, v, v) for i, v in enumerate((0.0, 500.0, 20000.0, 65535.0))]
    for a, b in run(spark, [C.Curves(up, up, up, lightness=True)], greys):
        want = 65535 * cut(up, a[0] / 65535)
        assert b == pytest.approx((want,) * 3, rel=1e-3, abs=2)


def test_hue_saturation_value(spark):
    import colorsys

    inside = [row for row in colors() if 0 <= min(row[1:]) and max(row[1:]) <= 65535]
    neutral = C.HueSaturationValue(hue=lambda h: 0.5, sat=lambda h: 0.5, value=lambda h: 0.5)
    for a, b in run(spark, [neutral], inside):
        assert b == pytest.approx(a, rel=1e-6, abs=1e-3)
    for amount in (-60, 40):
        stage = C.HueSaturationValue(saturation=amount, hue=lambda h: 0.55, sat=lambda h: 0.3, value=lambda h: 0.8)
        for a, b in run(spark, [stage], inside):
            h, s, v = colorsys.rgb_to_hsv(*(c / 65535 for c in a))
            if max(a) - min(a) < 1:
                h = s = 0.0
            s = max(0.0, amount / 100 * (1 - (1 - s) ** 4) + (1 - amount / 100) * s) if amount > 0 else s * (1 + amount / 100)
            h = (h + 0.1) % 1
            s *= 1 - 0.4
            p = 0.3 * (1 - (1 - min(s, 1)) ** 4)
            v = (1 - p) * v + p * (1 - (1 - min(v, 1)) ** 2) if p > 1e-5 else v
            assert b == pytest.approx(tuple(c * 65535 for c in colorsys.hsv_to_rgb(h, s, v)), rel=1e-6, abs=0.01)


def lab(rgb):
    f = lambda t: t ** (1 / 3) if t > 216 / 24389 else (24389 / 27 * t + 16) / 116
    x, y, z = (sum(m * c for m, c in zip(row, rgb, strict=True)) / 65535 / w for row, w in zip(S.XYZ_FROM_SRGB, S.D50, strict=True))
    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def test_lab_curves_one_by_one(spark):
    inside = [row for row in colors() if 500 <= min(row[1:]) and max(row[1:]) <= 65535]

    def moved(**kw):
        return [(lab(a), lab(b)) for a, b in run(spark, [C.LabCurves(**kw)], inside)]

    for a, b in moved():
        assert b == pytest.approx(a, abs=1e-4)
    for a, b in moved(lightness=lambda t: t * t):
        assert b == pytest.approx((100 * cut(lambda t: t * t, a[0] / 100), a[1], a[2]), abs=1e-3)
    for a, b in moved(a=lambda t: 0.5 + (t - 0.5) * 0.8, chroma=-50):
        assert b == pytest.approx((a[0], a[1] * 0.4, a[2] * 0.5), abs=0.05)
    for a, b in moved(chroma=30, protect=100):
        ratio = math.hypot(*b[1:]) / max(math.hypot(*a[1:]), 1e-9)
        hue = math.atan2(a[2], a[1])
        if math.hypot(*a[1:]) > 1:
            assert ratio == pytest.approx(1.0 if -0.05 <= hue <= 1.6 else 1.3, abs=0.01) or -0.45 < hue < 2.0
    for a, b in moved(chroma_by_hue=lambda h: 0.75, hue_by_hue=lambda h: 0.5 + 0.1 / 1.7):
        if math.hypot(*a[1:]) > 1:
            assert math.hypot(*b[1:]) == pytest.approx(1.5 * math.hypot(*a[1:]), rel=1e-4)
            assert math.remainder(math.atan2(b[2], b[1]) - math.atan2(a[2], a[1]) - 0.1, 2 * math.pi) == pytest.approx(0, abs=1e-4)
    for a, b in moved(lightness_by_hue=lambda h: 0.4):
        c = math.hypot(*a[1:])
        assert b[0] == pytest.approx(a[0] * (1 - 0.1 * 1.9 * c / 40), abs=1e-3)
    for a, b in moved(chroma_by_lightness=lambda t: 0.5 * t):
        assert b == pytest.approx((a[0], a[1] / 2, a[2] / 2), abs=1e-3)


def test_hue_circle_is_continuous_enough(spark):
    got = spark.range(-314, 315).select((F.col("id") / 100.0).alias("h"), C.hue_position(F.col("id") / 100.0).alias("p"), C.hue_position(F.col("id") / 100.0 + 2 * math.pi).alias("q")).collect()
    steps = [abs(math.remainder(b.p - a.p, 1.0)) for a, b in zip(got, got[1:], strict=False)]
    assert all(0 <= x.p < 1 for x in got) and max(steps) < 0.02
    assert all(abs(math.remainder(x.p - x.q, 1.0)) < 0.01 for x in got[100:])


def test_a_chain_is_one_span_of_generated_code(spark):
    from lumicat.plans.develop import STAGES

    df = C.develop(spark.range(1000).select(F.col("id").alias("frame"), *[(F.col("id") * k % 65536).cast("double").alias(c) for k, c in ((7, "r"), (31, "g"), (101, "b"))]), STAGES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert set(part.split(")")[0] for part in plan.split("*(")[1:]) == {"1"}


def test_highlights_in_lab(spark):
    rows = colors()
    df = frame(spark, rows)
    for step in S.highlight_lab("r", "g", "b", S.num(40000)):
        df = df.withColumns({n: F.expr(e) for n, e in step.items()})
    f = lambda t: math.copysign(abs(t) ** (1 / 3), t) if t > 216 / 24389 else (24389 / 27 * t + 16) / 116
    for x in df.collect():
        old, new = (x.r, x.g, x.b), (x.out_r, x.out_g, x.out_b)
        if max(old) <= 40000:
            assert old == new
            continue
        xyz = lambda v: [sum(m * c for m, c in zip(row, v, strict=True)) / 65535 for row in S.XYZ_FROM_SRGB]
        a, b, c = (list(map(f, xyz(v))) for v in (old, [min(v, 40000) for v in old], new))
        assert xyz(new)[1] == pytest.approx(xyz(old)[1], rel=1e-4) and c[0] - c[1] == pytest.approx(b[0] - b[1], abs=1e-4) and c[1] - c[2] == pytest.approx(b[1] - b[2], abs=1e-4)


# ---------------------------------------------------------------- curves


def de_boor(points, weights, degree, u):
    """The recursion on homogeneous control points."""
    n = len(points)
    knots = [0.0] * (degree + 1) + [float(i) for i in range(1, n - degree)] + [float(n - degree)] * (degree + 1)
    k = max(i for i in range(degree, n) if knots[i] <= u)
    d = [(x * w, y * w, w) for (x, y), w in zip(points[k - degree : k + 1], weights[k - degree : k + 1], strict=True)]
    for r in range(1, degree + 1):
        for j in range(degree, r - 1, -1):
            i = j + k - degree
            a = (u - knots[i]) / (knots[i + degree - r + 1] - knots[i])
            d[j] = tuple((1 - a) * p + a * q for p, q in zip(d[j - 1], d[j], strict=True))
    return d[degree][0] / d[degree][2], d[degree][1] / d[degree][2]


@pytest.mark.parametrize("degree", (2, 3))
def test_b_splines_match_de_boor(degree):
    r = random.Random(degree)
    for n in (3, 4, 5, 9):
        if n <= degree:
            continue
        xs = sorted(r.uniform(0, 1) for _ in range(n))
        points = [(x, r.uniform(0, 1)) for x in xs]
        for weights in ([1.0] * n, [r.uniform(0.5, 3) for _ in range(n)]):
            curve = curves.b_spline(points, weights, degree)
            for i in range(1, 40):
                x, y = de_boor(points, weights, degree, (n - degree) * i / 40)
                assert curve(x) == pytest.approx(y, abs=1e-9)
    # joints of the uniform quadratic curve lie halfway between inner controls
    curve = curves.b_spline([(0, 0), (0.2, 0.5), (0.6, 0.3), (1, 1)])
    assert curve(0.4) == pytest.approx(0.4) and curve(-1) == 0 and curve(2) == 1
    assert curves.b_spline([(0, 0), (1, 1)])(0.3) == pytest.approx(0.3)


def test_parametric_curve():
    assert curves.parametric(0, 0, 0, 0)(0.37) == 0.37
    for sliders in ((40, -30, 20, -10), (-100, 100, -100, 100), (100, 100, 100, 100), (0, 0, 1, 0)):
        for splits in ((0.25, 0.5, 0.75), (0.1, 0.3, 0.9), (0.001, 0.5, 0.99)):
            f = curves.parametric(*sliders, splits)
            values = [f(i / 500) for i in range(501)]
            assert values[0] == 0 and values[-1] == pytest.approx(1, abs=1e-6)
            assert all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False)) and all(-1e-9 <= v <= 1 + 1e-9 for v in values)
            assert max(abs(b - a) for a, b in zip(values, values[1:], strict=False)) < 0.12
    # raised shadows lift the low part alone
    f, base = curves.parametric(0, 10, -10, 60), curves.parametric(0, 10, -10, 0)
    assert f(0.1) > base(0.1) and f(0.8) == pytest.approx(base(0.8))
    g = curves.parametric(60, 10, -10, 0)
    assert g(0.8) > base(0.8) and g(0.2) == pytest.approx(base(0.2))
    # the same four sliders up and down mirror each other where the splits do
    up, down = curves.parametric(20, 30, 40, 50), curves.parametric(-50, -40, -30, -20)
    assert all(up(i / 20) == pytest.approx(1 - down(1 - i / 20), abs=1e-9) for i in range(1, 20) if i != 10)


def test_filters_on_results_stay_above_the_chain(spark):
    from lumicat.plans.develop import STAGES

    df = C.develop(spark.range(200).select(F.col("id").alias("frame"), *[(F.col("id") * k % 65536).cast("double").alias(c) for k, c in ((700, "r"), (310, "g"), (101, "b"))]), STAGES)
    kept = df.where("r > 5000 and frame < 100")
    assert kept.count() == sum(x.r > 5000 and x.frame < 100 for x in df.collect())
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 300_000
