"""Components of error points against brute force."""

import random

import numpy as np
import pytest

from stratawave import queries as q
from stratawave.operators import spatial

TASKS = {"B1_seasonality_present": ("seasonal", "nonseasonal", "B1_false_seasonal"), "C1_step_time": ("step", "no_step", "C1_step_time_false_step"), "C2_step_mag": ("step", "no_step", "C2_step_mag_false_step")}


def components(at, limit):
    left, sizes = set(range(len(at))), []
    while left:
        todo, size = [left.pop()], 0
        while todo:
            a, size = todo.pop(), size + 1
            near = {b for b in left if limit > 0 and np.sum((at[a] - at[b]) ** 2) <= limit**2}
            left -= near
            todo += near
        sizes.append(size)
    return sorted(sizes, reverse=True)


def brute(rows, k=8):
    profile, ranks = {}, {}
    for task, tile in sorted({r[:2] for r in rows}):
        own = [r for r in rows if r[:2] == (task, tile)]
        at = np.array([r[3:5] for r in own])
        d2 = np.sum((at[:, None] - at[None]) ** 2, axis=2)
        np.fill_diagonal(d2, np.inf)
        near = np.argsort(d2, axis=1, kind="stable")
        limit = np.sqrt(np.median(np.sort(d2, axis=1)[:, min(k, len(own) - 1) - 1])) if len(own) > 1 else 0.0
        yes, _, false = TASKS[task]
        hits = {f"{task}_anomaly": [], false: []}
        for i, r in enumerate(own):
            if len(own) > k:
                labels = [own[j][5] for j in near[i, :k]]
                top = min(set(labels), key=lambda x: (-labels.count(x), x))
                if r[5] == top != r[6]:
                    hits[f"{task}_anomaly"].append(i)
            if r[5] != yes == r[6]:
                hits[false].append(i)
        for kind, found in hits.items():
            sizes = components(at[found], limit)
            profile[task, tile, kind] = (pytest.approx(limit), len(found), len(sizes), sizes.count(1), max(sizes, default=0), pytest.approx(sizes.count(1) / len(found)) if found else None, pytest.approx(np.mean(sizes)) if sizes else None)
            ranks |= {(task, tile, kind, n): size for n, size in enumerate(sizes, 1)}
    return profile, ranks


def test_error_components_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for task, (yes, no, _) in TASKS.items():
        for tile, n in (("a", 90), ("b", 5), ("c", 1)):
            for i in range(n):
                x, y = rng.random(), rng.random()
                gold = yes if x < 0.5 else no
                rows.append((task, tile, i, x, y, gold, gold if rng.random() < 0.6 else yes if gold == no else no))
    rows += [("C1_step_time", "d", i, 1.0, 2.0, "no_step", "step") for i in range(3)]  # threshold 0
    points = spark.createDataFrame(rows, "task_name string, tile string, id long, x double, y double, gold string, pred string")
    profile, ranks = spatial.error_components(points)
    want, sizes = brute(rows)
    assert any(p[4] > 2 for p in want.values()) and any(p[1] == 0 for p in want.values())
    assert {tuple(r)[:3]: tuple(r)[3:] for r in profile.collect()} == want
    assert {tuple(r)[:4]: r["size"] for r in ranks.collect()} == sizes


def test_queries_are_registered():
    assert {"error_cluster_profile", "error_cluster_ranks"} <= set(q.QUERIES)
