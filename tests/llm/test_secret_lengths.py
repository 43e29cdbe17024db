"""Secret scans of long candidates and of texts with many matches; the added spans against brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumicat.llm import secrets

from .test_operators import brute_secrets, entropy, frame

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"


def brute_added(text):
    base = [tuple(map(int, x.split(":")[1:])) for x in brute_secrets(text).split(",") if x]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        c = m[0]
        if any(a < m.end() and m.start() < b for a, b in base) or not re.search(r"[0-9]", c) or not re.search(r"[A-Za-z]", c):
            continue
        if any(re.search(p, c) for p in secrets.ALLOWED):
            continue
        window, least = next((w, e) for p, w, e in secrets.CLASSES.values() if re.search(p, c))
        if entropy(c, window) >= least:
            out.append((m.start(), m.end()))
    return out


def test_added_spans_match_brute_force(spark):
    r = random.Random(8)
    bits = [" ", "\n", "é", "password=", "secret: ", "deadbeef0123", "AKIA", "abcabc1", "xxxx", "EXAMPLE", "0000000", "12345678-1234-1234-1234-1234567890ab"]
    rows = []
    for i in range(250):
        parts = [r.choice(bits) if r.random() < 0.6 else "".join(r.choice(LETTERS[: r.choice((6, 16, 64))]) for _ in range(r.randint(5, 60))) for _ in range(r.randint(1, 14))]
        rows.append((i, "".join(parts)))
    got = {x.doc_id: [(s.start, s.stop) for s in x.added] for x in secrets.secret_spans(frame(spark, rows)).collect()}
    assert got == {i: brute_added(t) for i, t in rows}
    assert sum(map(len, got.values())) > 30


def test_entropy_of_all_lengths(spark):
    r = random.Random(9)
    rows = ["".join(r.choice(LETTERS[:k]) for _ in range(n)) for n in (1, 19, 20, 21, 199, 200, 201, 219, 220, 400, 401, 1000) for k in (2, 5, 30)]
    # the best window across the border of two pieces
    rows += ["a" * (200 - k) + LETTERS[:20] + "a" * 200 for k in (1, 10, 19)]
    got = spark.createDataFrame([(x,) for x in rows], "c string").select("c", secrets.best_entropy(F.col("c"), 20).alias("e")).collect()
    assert all(x.e == pytest.approx(entropy(x.c), abs=1e-9) for x in got)


def test_time_grows_with_the_length(spark):
    took = {}
    for n in (1_000, 10_000, 100_000):
        r = random.Random(n)
        # hardly random anywhere, so that every window is measured
        text = "".join(r.choice("ab1") for _ in range(n))
        df = secrets.secret_spans(frame(spark, [(1, text)]))
        assert df.first().added == []
        began = time.perf_counter()
        df.collect()
        took[n] = time.perf_counter() - began
    assert took[100_000] < 4 and took[100_000] < 40 * max(took[10_000], 0.05)


def test_many_matches_in_one_text(spark):
    r = random.Random(3)
    text = "é ".join(f"token={r.choice(('abc', 'abcdef'))}{i}" + "0123456789abcdef01234567" * (i % 3 == 0) for i in range(3000))
    x = secrets.secret_spans(frame(spark, [(1, text)])).select(secrets.joined(F.col("base")).alias("b"), F.size("added").alias("n")).first()
    assert x.b == brute_secrets(text) and x.n == 0


def test_no_python_in_the_plan(spark):
    plan = secrets.secret_spans(frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
