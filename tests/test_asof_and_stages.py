"""Nearest dates against loops, stages that restart, lines that are parsed only if their id is wanted."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from stratawave import queries as q
from stratawave.operators import asof
from stratawave.plans import hybrid, stages
from stratawave.sources import files, testbed

DAY = dt.date(2020, 1, 1)


@pytest.mark.parametrize("stretch", [1, 7, 512])
def test_nearest_dates(spark, stretch):
    rng = random.Random(stretch)
    grid = [(k, DAY + dt.timedelta(rng.randrange(400)), i) for k in "abc" for i in range(rng.choice([1, 40]))] + [("a", None, 5), ("d", DAY, 1), (None, DAY, 9)]
    rows = [(k, DAY + dt.timedelta(rng.randrange(-600, 900)), i, "x") for i in range(300) for k in [rng.choice("abcde")]] + [("a", None, 1, "x"), (None, DAY, 2, "x")]
    rows += [rows[0], ("b", grid[1][1], 7, "x")]
    want = []
    for k, day, i, x in rows:
        own = [(abs((d - day).days), d, n) for key, d, n in grid if key == k and d is not None] if k and day else []
        if own:
            gap, d, n = min(own)
            want.append((k, day, i, x, d, n, gap))
    left = spark.createDataFrame(rows, "k string, day date, i int, d string")
    got = asof.nearest_dates(left.withColumnRenamed("d", "x"), spark.createDataFrame(grid, "k string, d date, n int"), ["k"], "day", "d", ["n"], stretch).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    plan = asof.nearest_dates(left.drop("d"), spark.createDataFrame(grid, "k string, d date, n int"), ["k"], "day", "d")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_stages_run_only_what_changed(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    spark.range(3).write.parquet(str(tmp_path / "other"))
    sources, out = {"in": str(tmp_path / "in"), "other": str(tmp_path / "other")}, str(tmp_path / "out")

    def plus(df, n):
        return df.select((F.col("id") + n).alias("id"))

    def joined(a, b):
        return a.join(b, "id")

    def graph(n=1, m=2):
        return [stages.Stage("a", plus, ("in",), {"n": n}), stages.Stage("b", plus, ("other",), {"n": m}), stages.Stage("c", joined, ("a", "b")), stages.Stage("d", plus, ("a",), {"n": 5})]

    tables, ran = stages.run_stages(spark, out, graph(), sources)
    assert ran == ["a", "b", "c", "d"] and sorted(r.id for r in tables["c"].collect()) == [2, 3, 4]
    assert stages.run_stages(spark, out, graph(), sources)[1] == []
    tables, ran = stages.run_stages(spark, out, graph(m=9), sources)
    assert ran == ["b", "c"] and sorted(r.id for r in tables["c"].collect()) == [9, 10]
    assert stages.run_stages(spark, out, graph(), sources)[1] == []  # what was there before still counts
    (dead,) = [p for p in (tmp_path / "out" / "c").iterdir() if stages.run_stages(spark, out, graph(), sources)[0]["c"].inputFiles()[0].find(p.name) >= 0]
    (dead / "_SUCCESS").unlink()  # as if the job had died while it wrote
    assert stages.run_stages(spark, out, graph(), sources)[1] == ["c"]
    assert stages.run_stages(spark, str(tmp_path / "part"), graph(), sources, ["d"])[1] == ["a", "d"]
    spark.range(10, 12).write.mode("append").parquet(str(tmp_path / "other"))
    assert stages.run_stages(spark, out, graph(), sources)[1] == ["b", "c"]

    def broken(df):
        return df.select(F.raise_error(F.lit("no")).alias("id"))

    with pytest.raises(Exception, match="no"):
        stages.run_stages(spark, out, [*graph(), stages.Stage("e", broken, ("d",))], sources)
    with pytest.raises(ValueError):
        stages.run_stages(spark, out, [stages.Stage("x", plus, ("y",))], sources)


def test_the_hybrid_chain_in_stages(spark, tmp_path):
    """The registered chain, its stages, and the same merge and scores written out by plain joins."""
    sf = "/root/testdata/sf0.001"
    want = {r.system: r for r in q.QUERIES["hybrid_chain"](spark, sf).collect()}
    g, p = q.gold_rows(spark, sf), q.points(spark, sf)
    model = q.predictions(g).withColumn("_seq", F.lit(0))
    model = model.select("id", "task_name", "answer_parsed", "parse_error", "_seq")
    sources = {}
    for name, df in (("gold", g), ("points", p), ("statics", testbed.statics(p)), ("model", model)):
        sources[name] = str(tmp_path / name)
        df.write.parquet(sources[name])
    out = str(tmp_path / "out")
    tables, ran = stages.run_stages(spark, out, hybrid.hybrid_stages(), sources)
    assert ran == ["b1_rules", "hybrid", "compared"]
    got = {r.system: r for r in tables["compared"].collect()}
    assert set(got) == {"model", "hybrid"} == set(want)
    for name, r in got.items():
        assert {c: pytest.approx(v, abs=1e-6) if isinstance(v, float) else v for c, v in r.asDict().items()} == want[name].asDict()
    own = {(r.id, r.task_name): r.answer_parsed for r in tables["hybrid"].collect()}
    rules = {r.pid: r.answer for r in tables["b1_rules"].collect()}
    tile = {r.pid: r.tile for r in p.select("pid", "tile").distinct().collect()}
    assert all(own[f"{tile[i]}_{i}_B1_seasonality_present", "B1_seasonality_present"] == a for i, a in rules.items()) and rules
    config = hybrid.ChainConfig(b1={"amp": 0.9, "snr": 1.3})
    assert stages.run_stages(spark, out, hybrid.hybrid_stages(config), sources)[1][:2] == ["b1_rules", "hybrid"]


def test_lines_are_parsed_after_the_semi_join(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({("qid" if i % 2 else "id"): f"k{i}", "v": i}) for i in range(100)) + '\n{"v": 3}\nbroken\n\n')
    ids = spark.createDataFrame([("k3",), ("k50",), ("k3",), ("none",)], "id string")
    got = files.restricted_json_lines(spark, str(tmp_path), "id string, qid string, v int", ids)
    assert sorted((r.v, r.id, r.qid) for r in got.collect()) == [(3, None, "k3"), (50, "k50", None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("from_json") < plan.index("LeftSemi")  # plans are printed from the top


def test_nearest_dates_tasks_grow_with_the_rows(spark, monkeypatch):
    assert asof.tasks_for(spark, 10) == 4 and asof.tasks_for(spark, 50 * asof.PER_TASK + 1) == 51
    counted, own = [], asof.tasks_for
    monkeypatch.setattr(asof, "tasks_for", lambda s, n: counted.append(n) or own(s, n, 10))
    rows = spark.createDataFrame([("a", DAY + dt.timedelta(i)) for i in range(300)], "k string, day date")
    got = asof.nearest_dates(rows, spark.createDataFrame([("a", DAY)], "k string, d date"), ["k"], "day", "d", stretch=8)
    assert counted == [301] and got.count() == 300
    assert ", 31)" in got._jdf.queryExecution().executedPlan().toString()


def test_hybrid_chain_derives_its_points_once(spark):
    assert not [f for f in q.hybrid_chain(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]
