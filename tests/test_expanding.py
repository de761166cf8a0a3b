"""Medians of beginnings and nearer counts against plain loops."""

import random
from statistics import median

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratawave.functions.expanding import beginning_medians, nearer_after
from stratawave.operators import predict

VALUES = st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6).map(lambda x: round(x, 3))), max_size=40)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.booleans())
def test_medians_and_counts(v, strict):
    n = len(v)
    pre, post = beginning_medians(v), beginning_medians(v[::-1])[::-1]
    assert pre[1:] == [median(v[:m]) for m in range(1, n + 1)]
    assert post[:n] == [median(v[i:]) for i in range(n)]
    got = nearer_after(v, pre[:n], post[:n], strict)
    for i in range(1, n):
        near = [abs(x - post[i]) < abs(x - pre[i]) if strict else abs(x - post[i]) <= abs(x - pre[i]) for x in v[i:]]
        assert got[i] == sum(near)


def test_boundaries_of_series(spark):
    rng = random.Random(4)
    rows = []
    for pid in range(30):
        day = 0
        for e in range(rng.choice([3, 7, 8, 40])):
            day += rng.choice([6, 12, 200])
            rows.append((f"s{pid}", day, e, None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else round(rng.gauss(0, 1) + (3 if e > 20 else 0), 1)))
    points = spark.createDataFrame(rows, "pid string, day int, epoch int, y double").select("pid", F.date_add(F.lit("2020-01-01"), F.col("day")).alias("d"), "epoch", "y")
    for strict in (False, True):
        want = set()
        for pid in {r[0] for r in rows}:
            own = sorted((day, e, y) for p, day, e, y in rows if p == pid and y is not None and y == y)
            days, ys = [o[0] for o in own], [o[2] for o in own]
            for i in range(2, len(ys) - 5 + 1):
                a, b = median(ys[:i]), median(ys[i:])
                near = [abs(x - b) < abs(x - a) if strict else abs(x - b) <= abs(x - a) for x in ys[i:]]
                if days[i] - days[i - 1] <= 120:
                    want.add((pid, i, days[i] - days[i - 1], a, b, b - a, abs(ys[i] - ys[i - 1]), sum(near) / len(near)))
        got = predict.split_scan(points, 2, 5, 120, strict).drop("d").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_long_series_is_quick():
    import time

    rng = random.Random(1)
    v = [rng.gauss(0, 1) for _ in range(100_000)]
    start = time.process_time()
    pre, post = beginning_medians(v), beginning_medians(v[::-1])[::-1]
    nearer_after(v, pre[:-1], post[:-1], False)
    assert time.process_time() - start < 20
