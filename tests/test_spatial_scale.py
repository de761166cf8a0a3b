"""What grows with the points: it is derived once, not collected for joins, and shrinks from round to round."""

import random

from pyspark.sql import functions as F

from stratawave.operators import quantile, spatial

POINTS = "task_name string, tile string, id long, x double, y double, gold string, pred string"


def counted(spark, rows, schema):
    """rows as a table, and how many of them have been derived so far."""
    seen = spark.sparkContext.accumulator(0)

    def pick(row):
        seen.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(pick), schema), seen


def cloud(n):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        gold = "step" if rng.random() < 0.5 else "no_step"
        rows.append(("C1_step_time", "a", i, rng.random(), rng.random(), gold, gold if rng.random() < 0.5 else "step"))
    return rows


def test_medians_derive_rows_once(spark):
    rng = random.Random(1)
    rows = [("a", rng.random()) for _ in range(2001)] + [("none", None)]
    df, seen = counted(spark, rows, "k string, v double")
    got = {r["k"]: r["median"] for r in quantile.median_by(df, ["k"], "v", buckets=4, limit=10).collect()}
    assert got == {"a": sorted(v for _, v in rows[:-1])[1000], "none": None}
    assert seen.value == len(rows)


def test_error_points_are_derived_once(spark, monkeypatch):
    rows = cloud(300)
    df, seen = counted(spark, rows, POINTS)
    asked = []
    real = spatial.error_points
    hit = F.udf(lambda i: asked_for.add(1) or i, "long").asNondeterministic()
    asked_for = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(spatial, "error_points", lambda points, edges: asked.append(real(points, edges)) or asked[0].withColumn("id", hit("id")))
    profile, ranks = spatial.error_components(df)
    assert profile.count() == 2 and ranks.count()
    assert seen.value == len(rows)
    assert asked_for.value == asked[0].count() > 0


def test_tables_of_points_are_not_broadcast(spark, monkeypatch):
    plans, kept = {}, spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, name, folder=None: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), kept(df, name, folder))[1])
    points = spark.createDataFrame(cloud(600), POINTS)
    limits = spark.createDataFrame([("C1_step_time", "a", 0.05)], "task_name string, tile string, threshold double")
    plans["knn"] = spatial.knn(points, 8)._jdf.queryExecution().executedPlan().toString()
    assert spatial.close_components(points, limits).count() == 600
    for name in ("there", "met-0", "knn", "told-0", "parts-1", "told-1"):
        if name in plans:
            assert "BroadcastHashJoin" not in plans[name], name
    assert {"there", "told-0", "parts-1"} <= set(plans)


def test_rounds_of_components_shrink(spark, monkeypatch):
    """A chain of rising ids, a star with the largest id in its middle, a ring and single points."""
    n = 2000
    pairs = [("q", "chain", i, i + 1) for i in range(n - 1)] + [("q", "star", i, 500) for i in range(500)] + [("q", "ring", i, (i + 1) % 50) for i in range(50)]
    ids = [("q", "chain", i) for i in range(n)] + [("q", "star", i) for i in range(501)] + [("q", "ring", i) for i in range(50)] + [("q", "alone", i) for i in range(5)] + [("q", "chain", n + 1)]
    sizes, kept = {}, spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, name, folder=None: (out := kept(df, name, folder), sizes.update({name: out.count()}))[0])
    got = spatial.connected(spark.createDataFrame(ids, "task_name string, tile string, id long"), spark.createDataFrame(pairs, "task_name string, tile string, a long, b long")).collect()
    want = {(tile, i): i if tile == "alone" or i == n + 1 else 0 for _, tile, i in ids}
    assert {(r["tile"], r["id"]): r["component"] for r in got} == want and len(got) == len(ids)
    ends = 2 * len(pairs)
    assert sum(sizes.values()) < 3 * ends + len(ids), sizes
