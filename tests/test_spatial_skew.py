"""Neighbours, distance graphs and medians on crowded points, against plain loops and with what their tasks read."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawave.operators import quantile, spatial

SCHEMA = "task_name string, tile string, id long, x double, y double"


def crowded(n, seed=1):
    """Nine tenths in a thousandth of the box, some in one place, some on a line, two tiles."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        u = rng.random()
        x, y = rng.random() * 1000, rng.random() * 1000
        if u < 0.7:
            x, y = 400 + rng.random(), 700 + rng.random()
        elif u < 0.8:
            x, y = 400.5, 700.5
        elif u < 0.85:
            y = 700.25
        elif u < 0.9:
            x, y = 400 + rng.random() * 1e-4, 700 + rng.random() * 1e-4
        rows.append(("q", "a" if i % 5 else "b", i, x, y))
    return rows


def nearest(rows, k):
    want = {}
    for tile in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == tile]
        if len(own) <= k:
            continue
        at, ids = np.array([r[3:] for r in own]), np.array([r[2] for r in own])
        for j, r in enumerate(own):
            d2 = (r[3] - at[:, 0]) ** 2 + (r[4] - at[:, 1]) ** 2
            order = np.lexsort((ids, d2))
            want[tile, r[2]] = [(int(ids[o]), float(d2[o])) for o in order if o != j][:k]
    return want


@pytest.mark.parametrize("k", [1, 8])
def test_neighbours_of_crowded_points(spark, k):
    rows = crowded(1500) + [("q", "few", 9000 + i, float(i), 0.0) for i in range(k)] + [("q", "same", 9100 + i, 1.0, 1.0) for i in range(40)] + [("q", "a", 9999, None, 1.0)]
    got = {}
    for r in spatial.knn(spark.createDataFrame(rows, SCHEMA), k, cell_points=16).collect():
        got.setdefault((r["tile"], r["id"]), []).append((r["rank"], r["other"], r["d2"]))
    want = nearest([r for r in rows if r[3] is not None], k)
    assert {key: [(o, d) for _, o, d in sorted(v)] for key, v in got.items()} == want
    assert all([n for n, _, _ in sorted(v)] == list(range(1, k + 1)) for v in got.values())


def test_a_crowd_does_not_fill_a_leaf(spark):
    """Leaves hold at most capacity points (of a place at most k + 1), and a leaf's search meets few others."""
    rows = crowded(6000, seed=4)
    box = spark.createDataFrame(rows, SCHEMA).where("tile = 'a'")
    cell = lambda c, z: F.floor((F.col(c) - z) / 1000.0 * 2.0**spatial.DEPTH).cast("long")
    refs = box.dropDuplicates(["x", "y"]).withColumns({"ix": cell("x", 0.0), "iy": cell("y", 0.0)})
    nodes, placed = spatial.quadtree(refs, 32, spatial.scratch_folder(spark))
    leaves = placed.groupBy("leaf").count().collect()
    assert placed.count() == refs.count() and max(r["count"] for r in leaves) <= 32
    assert nodes.where("leaf").count() == len(leaves) < refs.count() / 4


def components(rows, limits):
    want = {}
    for tile in {r[1] for r in rows}:
        if tile not in limits:
            continue
        own = [r for r in rows if r[1] == tile]
        at, t2 = np.array([r[3:] for r in own]), limits[tile] ** 2
        label, left = {}, set(range(len(own)))
        while left:
            todo, group = [left.pop()], []
            while todo:
                j = todo.pop()
                group.append(j)
                near = {o for o in left if (at[j, 0] - at[o, 0]) ** 2 + (at[j, 1] - at[o, 1]) ** 2 <= t2}
                left -= near
                todo += near
            least = min(own[j][2] for j in group)
            label |= {(tile, own[j][2]): least for j in group}
        want |= label
    return want


@pytest.mark.parametrize("limit", [0.0, 1e-7, 0.02, 0.37, 400.0])
def test_components_without_pairs(spark, limit):
    rows = [r for r in crowded(700, seed=2)] + [("q", "grid", 5000 + i, float(i % 10) * 3, float(i // 10) * 4) for i in range(60)]
    limits = {"a": limit, "b": limit * 2, "grid": 3.0 if limit == 0.37 else limit}
    got = spatial.close_components(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("q", t, v) for t, v in limits.items()], "task_name string, tile string, threshold double")).collect()
    assert {(r["tile"], r["id"]): r["component"] for r in got} == components(rows, limits) and len(got) == len(rows)


def test_links_of_a_dense_cell_stay_few(spark, monkeypatch):
    """Two discs of 2000 points that nearly touch: what connected() is given, and every table between, is far from all pairs."""
    rng = random.Random(6)
    rows = []
    for i in range(4000):
        r, a = math.sqrt(rng.random()), rng.random() * 2 * math.pi
        rows.append(("q", "a", i, r * math.cos(a) + (2.05 if i % 2 else 0), r * math.sin(a)))
    seen = []
    real, kept = spatial.connected, spatial.stored
    monkeypatch.setattr(spatial, "connected", lambda cells, links, shared=None: seen.append(links.count()) or real(cells, links, shared))
    sizes = []
    monkeypatch.setattr(spatial, "stored", lambda df, name, folder=None: (out := kept(df, name, folder), sizes.append(out.count()))[0])
    limits = spark.createDataFrame([("q", "a", 0.5)], "task_name string, tile string, threshold double")
    labels = spatial.close_components(spark.createDataFrame(rows, SCHEMA), limits)
    assert labels.select("component").distinct().count() == 1
    at = np.array([r[3:] for r in rows])
    pairs = sum(int((((at[i] - at[i + 1 :]) ** 2).sum(1) <= 0.25).sum()) for i in range(len(at)))
    cells, links = sizes[1], sizes[2]
    assert seen[0] <= links <= 12 * cells and max(sizes) <= 16 * 16 * links and max(sizes) * 10 < pairs


def test_medians_by_refined_histograms(spark):
    rng = random.Random(8)
    rows = [("a", rng.random()) for _ in range(3001)] + [("b", rng.choice([1.0, 2.0])) for _ in range(2000)] + [("c", math.exp(rng.random() * 60)) for _ in range(2000)]
    rows += [("d", 5.0)] * 900 + [("d", 7.0)] * 900 + [("e", None), ("f", float("nan")), ("f", 3.0), ("g", -1.5), ("g", 2.5)]
    got = {r[0]: r[1] for r in quantile.median_by(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", buckets=16, limit=50).collect()}
    for k in "abcdefg":
        v = [x for key, x in rows if key == k and x is not None and x == x]
        assert got[k] == (pytest.approx(float(np.median(v)), rel=1e-12) if v else None)
